"""Readers: curve points, run results, vector and raster figures as tables with explicit schemas."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("time", T.DoubleType()), T.StructField("survival", T.DoubleType())])

_CURVE = T.StructType(
    [
        T.StructField("curve_id", T.IntegerType()), T.StructField("n_points", T.LongType()), T.StructField("original_points", T.LongType()),
        T.StructField("quality_score", T.DoubleType()), T.StructField("validation_warnings", T.ArrayType(T.StringType())), T.StructField("curve_direction", T.StringType()),
    ]
)
_FIGURE = T.StructType(
    [
        T.StructField("figure_id", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("panel_index", T.IntegerType()), T.StructField("n_curves", T.IntegerType()),
        T.StructField("calibration_valid", T.BooleanType()), T.StructField("calibration_reason", T.StringType()), T.StructField("curves", T.ArrayType(_CURVE)),
    ]
)
RESULT = T.StructType([T.StructField("pdf_name", T.StringType()), T.StructField("figures", T.ArrayType(_FIGURE)), T.StructField("errors", T.ArrayType(T.StringType()))])

#: How a curve file is named.
NAME = r"([^/]*)_p([0-9]+)_f([0-9]+)_curve([0-9]+)\.csv$"


def _finite(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def read_curve_points(spark: SparkSession, path: str) -> DataFrame:
    """All curve files under ``path`` as one table; document, page, figure and curve come from the names."""
    raw = spark.read.schema(POINT).option("header", True).csv(path).withColumn("__f", F.col("_metadata.file_name"))
    part = lambda i: F.regexp_extract("__f", NAME, i)
    return _finite(
        raw.select(part(1).alias("doc_id"), part(2).cast("int").alias("page"), part(3).cast("int").alias("figure_id"), (part(4).cast("int") - 1).alias("curve_id"), "time", "survival")
    )


def read_results(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Nested run results, one document a row; ``lines`` if each line of a file is a document, as our own writer has it."""
    return spark.read.schema(RESULT).option("multiLine", not lines).json(path)


def flatten_results(results: DataFrame) -> DataFrame:
    """One row a curve, with its figure and document."""
    figures = results.select("pdf_name", F.explode("figures").alias("f"))
    return figures.select("pdf_name", "f.figure_id", "f.page", "f.calibration_valid", "f.calibration_reason", F.explode("f.curves").alias("c")).select(
        "pdf_name", "figure_id", "page", "calibration_valid", "calibration_reason", "c.*"
    )


def consolidate_curves(spark: SparkSession, glob: str, schema: T.StructType) -> DataFrame:
    """Point files of many documents as one table; the parent folder names the document, unreadable rows and files are skipped."""
    raw = spark.read.schema(schema).option("header", True).option("mode", "DROPMALFORMED").option("ignoreCorruptFiles", True).csv(glob)
    return _finite(raw.withColumn("source_pdf", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)))


_TOKEN = r"""(?s)(<!--.*?-->|<!\[CDATA\[.*?\]\]>|<(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^<]++)"""
#: The entities of XML; the ampersand last.
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def _cut(batches: Iterator[pa.RecordBatch], most: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Tokens of whole files in their order, passed on ``most`` at a time, so a file's tokens are never held together."""
    token = re.compile(_TOKEN)
    for batch in batches:
        for name, text in zip(batch.column(0), batch.column(1)):
            found = enumerate(m.group(1) for m in token.finditer(text.as_py()))
            while part := list(islice(found, most)):
                pos, tokens = zip(*part)
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(part), pa.string()), pa.array(pos, pa.int32()), pa.array(tokens, pa.string())], names=["doc_id", "pos", "token"])


def svg_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Tags and texts of SVG files in order: ``doc_id, pos, token, tag, kind, level, in_defs``.

    ``kind`` is open, close, single or text; ``level`` is how deep an element
    lies, the same for its two tags. Depth is a running sum over a file.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("doc_id"), "value")
    rows = files.mapInArrow(_cut, "doc_id string, pos int, token string")
    tag = F.regexp_extract("token", r"^</?\s*([A-Za-z_][A-Za-z0-9_:.-]*)", 1)
    name = F.regexp_replace(tag, "^.*:", "")
    kind = (
        F.when(~F.col("token").startswith("<") | F.col("token").startswith("<![CDATA["), "text").when(F.col("token").startswith("</"), "close")
        .when(name == "", None).when(F.col("token").endswith("/>"), "single").otherwise("open")
    )
    rows = rows.withColumn("tag", name).withColumn("kind", kind).filter("kind is not null")
    upto = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    inside = lambda t: F.sum(F.when(F.col("tag") == t, step).otherwise(0)).over(upto) > 0
    rows = rows.withColumn("in_defs", inside("defs")).withColumn("in_text", inside("text")).withColumn("__deep", F.sum(step).over(upto))
    return rows.withColumn("level", F.when(F.col("kind").isin("close", "single"), F.col("__deep") + 1).otherwise(F.col("__deep"))).drop("__deep")


def _svg(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """Drawn elements of a kind, definitions left out: ``doc_id, element_id, e, transform``.

    ``transform`` holds those of the groups around an element and its own, from
    the outermost on. An element asks at each level above it for the last tag
    opened there, so rows grow with depth, not with the number of groups.
    """
    tokens = svg_tokens(spark, path).withColumn("e", F.col("token"))
    own = _attr("transform")
    found = tokens.filter((F.col("tag") == tag) & F.col("kind").isin("open", "single") & ~F.col("in_defs"))
    opened = tokens.filter("kind = 'open'").select("doc_id", "pos", "level", F.struct(own.alias("t")).alias("open"), F.lit(False).alias("asks"))
    asked = found.filter("level > 1").select("doc_id", "pos", F.explode(F.sequence(F.lit(1), F.col("level") - 1)).alias("level"), F.lit(None).cast("struct<t:string>").alias("open"), F.lit(True).alias("asks"))
    last = Window.partitionBy("doc_id", "level").orderBy("pos", "asks").rowsBetween(Window.unboundedPreceding, 0)
    above = opened.unionByName(asked).withColumn("open", F.last("open", ignorenulls=True).over(last)).filter("asks and open.t is not null")
    chain = above.groupBy("doc_id", "pos").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("level", "open.t"))), lambda x: x["t"]), " ").alias("around"))
    return found.join(chain, ["doc_id", "pos"], "left").select("doc_id", F.col("pos").alias("element_id"), "e", F.nullif(F.concat_ws(" ", "around", own), F.lit("")).alias("transform"))


def _attr(name: str) -> Column:
    either = [F.regexp_extract("e", rf"\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", i) for i in (1, 2)]
    return F.nullif(F.concat(*either), F.lit(""))


def read_svg_lines(spark: SparkSession, path: str) -> DataFrame:
    n = lambda a: F.coalesce(_attr(a).try_cast("double"), F.lit(0.0))
    return _svg(spark, path, "line").select(
        "doc_id", F.col("element_id").alias("line_id"), *[n(c).alias(c) for c in ("x1", "y1", "x2", "y2")],
        _attr("stroke").alias("stroke"), _attr("stroke-width").try_cast("double").alias("sw"), _attr("stroke-dasharray").alias("dash"), "transform",
    )


def read_svg_texts(spark: SparkSession, path: str) -> DataFrame:
    """Texts with what their spans hold; a text without a place takes that of its first span."""
    tokens = svg_tokens(spark, path).withColumn("e", F.col("token"))
    upto = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    start = F.last(F.when((F.col("tag") == "text") & (F.col("kind") == "open"), F.col("pos")), ignorenulls=True).over(upto)
    inside = tokens.withColumn("element_id", start).filter("in_text and not in_defs")
    plain = F.regexp_replace("token", r"(?s)^<!\[CDATA\[(.*)\]\]>$", "$1")
    for entity, c in _ENTITIES:
        plain = F.replace(plain, F.lit(entity), F.lit(c))
    piece = F.when(F.col("kind") == "text", F.struct("pos", plain.alias("t")))
    span = (F.col("tag") == "tspan") & (F.col("kind") == "open")
    parts = inside.groupBy("doc_id", "element_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda p: p["t"]), "").alias("text"),
        *[F.min_by(_attr(c), F.when(span & _attr(c).isNotNull(), F.col("pos"))).alias(f"span_{c}") for c in "xy"],
    )
    rows = _svg(spark, path, "text").join(parts, ["doc_id", "element_id"])
    place = [F.coalesce(_attr(c), F.col(f"span_{c}")).try_cast("double").alias(c) for c in "xy"]
    return rows.select("doc_id", "element_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"), *place, "transform").filter("text <> ''")


def read_svg_paths(spark: SparkSession, path: str) -> DataFrame:
    """Paths that are stroked and not filled."""
    rows = _svg(spark, path, "path").select("doc_id", F.col("element_id").alias("path_id"), _attr("d").alias("d"), _attr("stroke").alias("stroke"), _attr("fill").alias("fill"), "transform")
    return rows.filter("d is not null and stroke is not null and stroke <> 'none' and coalesce(fill, 'none') = 'none'").drop("fill")


def read_svg_polylines(spark: SparkSession, path: str) -> DataFrame:
    numbers = F.transform(F.regexp_extract_all(_attr("points"), F.lit(r"(-?[0-9.]+)"), F.lit(1)), lambda x: x.try_cast("double"))
    rows = _svg(spark, path, "polyline").select("doc_id", F.col("element_id").alias("path_id"), numbers.alias("n"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("n") / 2).cast("int") - 1), lambda i: F.struct(F.get("n", i * 2).alias("px"), F.get("n", i * 2 + 1).alias("py")))
    return rows.filter(F.size("n") >= 2).select("doc_id", "path_id", F.posexplode(pairs).alias("idx", "p")).select("doc_id", "path_id", "idx", "p.px", "p.py")


def read_image_pixels(spark: SparkSession, path: str) -> DataFrame:
    """Pixels of three-channel images: ``figure_id, x, y, r, g, b``. The decoder gives blue, green, red.

    A row of pixels is one slice of the bytes, so an image explodes into rows of
    a bounded size first.
    """
    img = spark.read.format("image").load(path).select("image.*").filter("nChannels = 3")
    name = F.regexp_extract("origin", r"([^/]+)$", 1)
    rows = img.select(name.alias("figure_id"), "width", F.hex("data").alias("h"), F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    line = rows.select("figure_id", "width", "y", F.substring("h", (F.col("y") * F.col("width") * 6 + 1).cast("int"), (F.col("width") * 6).cast("int")).alias("h"))
    px = line.select("figure_id", "y", "h", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    byte = lambda k: F.conv(F.substring("h", (F.col("x") * 6 + 1 + 2 * k).cast("int"), F.lit(2)), 16, 10).cast("int")
    return px.select("figure_id", "x", "y", byte(2).alias("r"), byte(1).alias("g"), byte(0).alias("b"))


def bind_pages(*pages: DataFrame) -> DataFrame:
    """Tables of pages stacked; missing columns become null."""
    out = pages[0]
    for p in pages[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
