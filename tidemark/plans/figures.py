"""Registered queries over vector figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators import spatial
from tidemark.plans import adapters
from tidemark.registry import query

_L = "WITH " + adapters.LINES
_AXES = _L + """, m AS (SELECT *, CASE WHEN abs(y2 - y1) < 1 THEN 'h' WHEN abs(x2 - x1) < 1 THEN 'v' END AS direction, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS length FROM lines),
 axes AS (SELECT *, row_number() OVER (PARTITION BY doc_id, direction ORDER BY length DESC, line_id)::INT AS rank FROM m WHERE direction IS NOT NULL AND length >= 50)"""


def _axes(spark, sf_dir):
    return spatial.axis_lines(adapters.lines(spark, sf_dir), ["doc_id"])


@query("axis_lines", _AXES + " SELECT doc_id, line_id, direction, length, rank FROM axes")
def axis_lines(spark, sf_dir):
    return _axes(spark, sf_dir).select("doc_id", "line_id", "direction", "length", "rank")


_PANELS = _AXES + """, hz AS (SELECT doc_id, y1 AS hy, least(x1, x2) AS hx1, greatest(x1, x2) AS hx2 FROM axes WHERE direction = 'h' AND rank <= 12),
 vt AS (SELECT doc_id, line_id, x1 AS vx, least(y1, y2) AS vy FROM axes WHERE direction = 'v' AND rank <= 12),
 bx AS (SELECT DISTINCT a.doc_id, a.vx AS xmin, b.vx AS xmax, least(a.vy, b.vy) AS ymin, hy AS ymax FROM vt a JOIN vt b ON a.doc_id = b.doc_id AND b.vx - a.vx >= 30
  JOIN hz ON hz.doc_id = a.doc_id AND hy > greatest(a.vy, b.vy) AND hx1 <= a.vx + 5 AND hx2 >= b.vx - 5 WHERE b.vx - a.vx >= 50),
 panels AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY xmin, ymin, xmax, ymax)::INT AS panel_id FROM bx)"""


def _panels(spark, sf_dir):
    return spatial.build_panels(_axes(spark, sf_dir), ["doc_id"], top=12)


@query("build_panels", _PANELS + " SELECT * FROM panels")
def build_panels(spark, sf_dir):
    return _panels(spark, sf_dir)


@query(
    "flag_insets",
    _PANELS + """, s AS (SELECT *, (xmax - xmin) * (ymax - ymin) AS area FROM panels)
 SELECT doc_id, panel_id, area, area <= 0.25 * max(area) OVER (PARTITION BY doc_id) AND EXISTS (SELECT 1 FROM panels o WHERE o.doc_id = s.doc_id AND o.panel_id <> s.panel_id
 AND s.xmin >= o.xmin AND s.xmax <= o.xmax AND s.ymin >= o.ymin AND s.ymax <= o.ymax) AS is_inset FROM s""",
)
def flag_insets(spark, sf_dir):
    return spatial.flag_insets(_panels(spark, sf_dir), ["doc_id"]).select("doc_id", "panel_id", "area", "is_inset")


@query(
    "score_panels",
    _PANELS + """, s AS (SELECT *, (xmax - xmin) * (ymax - ymin) AS area, -abs(1.0 + (panel_id % 5) / 10.0 - 1.0) AS f, panel_id % 4 = 0 AS nar FROM panels),
 u AS (SELECT doc_id, panel_id, CASE WHEN max(area) OVER w = min(area) OVER w THEN 0.5 ELSE (area - min(area) OVER w) / (max(area) OVER w - min(area) OVER w) END
 + CASE WHEN max(f) OVER w = min(f) OVER w THEN 0.5 ELSE (f - min(f) OVER w) / (max(f) OVER w - min(f) OVER w) END + CASE WHEN nar THEN 0.25 ELSE 0.0 END AS score FROM s WINDOW w AS (PARTITION BY doc_id))
 SELECT doc_id, panel_id, round(score, 6) AS panel_score FROM u""",
)
def score_panels(spark, sf_dir):
    p = _panels(spark, sf_dir).withColumn("y_max", 1.0 + (F.col("panel_id") % 5) / 10.0).withColumn("nar_hit", F.col("panel_id") % 4 == 0)
    return spatial.score_panels(p, ["doc_id"]).select("doc_id", "panel_id", F.round("panel_score", 6).alias("panel_score"))


@query(
    "choose_panels",
    _PANELS + """, s AS (SELECT *, (xmax - xmin) * (ymax - ymin) AS area FROM panels) SELECT doc_id, panel_id, area FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY area DESC, panel_id) = 1""",
)
def choose_panels(spark, sf_dir):
    p = _panels(spark, sf_dir).withColumn("y_max", F.lit(1.0)).withColumn("nar_hit", F.lit(False))
    largest = spatial.choose_panels(spatial.score_panels(p, ["doc_id"]), ["doc_id"], "largest")
    return largest.select("doc_id", "panel_id", ((F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))).alias("area"))


@query(
    "axis_candidates",
    _AXES + """, w AS (SELECT doc_id, line_id AS word_id, (line_id % 97)::DOUBLE AS value, x1 + 3.0 AS left_, y1 + 4.0 AS top FROM lines WHERE line_id % 97 <> 13)
 SELECT w.doc_id, a.line_id AS axis_id, count(*) AS n, sum(value)::BIGINT AS total FROM w JOIN axes a ON a.doc_id = w.doc_id AND a.direction = 'h' AND a.rank <= 6
 WHERE top BETWEEN a.y1 - 100 AND a.y1 + 20 AND left_ BETWEEN least(a.x1, a.x2) - 50 AND greatest(a.x1, a.x2) + 500 GROUP BY ALL""",
)
def axis_candidates(spark, sf_dir):
    from tidemark.operators.calibrate import axis_candidates as op

    found = op(_page_words(spark, sf_dir), _axes(spark, sf_dir).filter("rank <= 6"), ["doc_id"])
    return found.groupBy("doc_id", "axis_id").agg(F.count("*").alias("n"), F.sum("value").cast("long").alias("total"))


def _page_words(spark, sf_dir):
    """A word beside each line: a number, but for some."""
    n = F.col("line_id") % 97
    return adapters.lines(spark, sf_dir).select("doc_id", F.col("line_id").alias("word_id"), F.when(n == 13, "axis").otherwise(n.cast("string")).alias("text"), (F.col("x1") + 3.0).alias("left"), (F.col("y1") + 4.0).alias("top"))


@query(
    "panel_confidence",
    _PANELS + """, b AS (SELECT doc_id, panel_id, xmax - xmin AS w, ymax - ymin AS h, 0.6 + (panel_id % 5) / 10.0 AS rect, 0.05 * (panel_id % 12) AS share, (panel_id % 10) / 10.0 AS border FROM panels),
 c AS (SELECT *, 0.3 * least(rect / 0.95, 1.0) + 0.3 * greatest(0.0, 1.0 - abs(w / h - 1.3) / 2.0) + 0.4 * border AS confidence FROM b)
 SELECT doc_id, panel_id, round(confidence, 6) AS confidence FROM c WHERE share BETWEEN 0.05 AND 0.5 AND w / h BETWEEN 0.5 AND 2.5 AND rect >= 0.7 AND confidence >= 0.5""",
)
def panel_confidence(spark, sf_dir):
    p, k = _panels(spark, sf_dir), F.col("panel_id")
    boxes = p.select("doc_id", "panel_id", (F.col("xmax") - F.col("xmin")).alias("w"), (F.col("ymax") - F.col("ymin")).alias("h"), (0.6 + (k % 5) / 10.0).alias("rect"), (0.05 * (k % 12)).alias("share"), ((k % 10) / 10.0).alias("border"))
    return spatial.panel_confidence(boxes).select("doc_id", "panel_id", F.round("confidence", 6).alias("confidence"))


@query("at_risk_region", _PANELS + " SELECT doc_id, panel_id, xmin AS ar_xmin, xmax AS ar_xmax, ymax + 10 AS ar_ymin, ymax + 210 AS ar_ymax FROM panels")
def at_risk_region(spark, sf_dir):
    return spatial.at_risk_region(_panels(spark, sf_dir)).select("doc_id", "panel_id", "ar_xmin", "ar_xmax", "ar_ymin", "ar_ymax")


_STYLE = "CASE WHEN dash IS NULL OR dash IN ('', 'none') THEN 'solid' ELSE regexp_replace(dash, '[^0-9.]+', '-', 'g') END"


@query("style_key", _L + f" SELECT doc_id, lower(stroke) || '|' || {_STYLE} || '|' || sw::INT::VARCHAR AS style_key, count(*) AS n FROM lines GROUP BY ALL")
def style_key(spark, sf_dir):
    key = scalar.style_key(F.col("stroke"), F.col("dash"), F.col("sw"))
    return adapters.lines(spark, sf_dir).groupBy("doc_id", key.alias("style_key")).agg(F.count("*").alias("n"))


@query("curve_numbering", _L + f", s AS (SELECT doc_id, lower(stroke) || '|' || {_STYLE} || '|' || sw::INT::VARCHAR AS k FROM lines) SELECT DISTINCT doc_id, k AS style_key, dense_rank() OVER (PARTITION BY doc_id ORDER BY k)::INT AS curve_id FROM s")
def curve_numbering(spark, sf_dir):
    from tidemark.operators.cluster import curve_numbering as op

    styled = adapters.lines(spark, sf_dir).select("doc_id", scalar.style_key(F.col("stroke"), F.col("dash"), F.col("sw")).alias("style_key"))
    return op(styled, ["doc_id"], "style_key").distinct()


@query("line_geometry", _L + " SELECT doc_id, line_id, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS length, (x1 + x2) / 2.0 AS mx, (y1 + y2) / 2.0 AS my FROM lines")
def line_geometry(spark, sf_dir):
    c = [F.col(x) for x in ("x1", "y1", "x2", "y2")]
    mx, my = scalar.line_midpoint(*c)
    return adapters.lines(spark, sf_dir).select("doc_id", "line_id", scalar.line_length(*c).alias("length"), mx.alias("mx"), my.alias("my"))


@query(
    "affine_transform",
    _L + """ SELECT doc_id, line_id, round(CASE WHEN line_id % 5 = 0 THEN x1 ELSE 0.5 * x1 + 0.0 * y1 + 10.0 END, 6) AS tx, round(CASE WHEN line_id % 5 = 0 THEN y1 ELSE 0.0 * x1 + -2.0 * y1 + 300.0 END, 6) AS ty FROM lines""",
)
def affine_transform(spark, sf_dir):
    m = F.when(F.col("line_id") % 5 == 0, F.lit("rotate(30)")).otherwise(F.lit("matrix(0.5 0 0 -2 10 300)"))
    x, y = scalar.affine_transform(F.col("x1"), F.col("y1"), m)
    return adapters.lines(spark, sf_dir).select("doc_id", "line_id", F.round(x, 6).alias("tx"), F.round(y, 6).alias("ty"))


_SW = _L + f""", sw AS (SELECT doc_id, line_id, (x1 + x2) / 2.0 AS mx, (y1 + y2) / 2.0 AS my, lower(stroke) || '|' || {_STYLE} || '|' || sw::INT::VARCHAR AS style_key FROM lines WHERE sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) BETWEEN 1e-9 AND 40),
 tx AS (SELECT doc_id, 'label' || (line_id % 97)::VARCHAR AS label, x1 + 3.0 AS tx, y1 + 4.0 AS ty FROM lines)"""


@query(
    "nearest_label",
    _PANELS + _SW.removeprefix(_L) + """, d AS (SELECT sw.doc_id, line_id, style_key, label, sqrt((mx - tx) * (mx - tx) + (my - ty) * (my - ty)) AS dist FROM sw JOIN tx ON sw.doc_id = tx.doc_id
  WHERE NOT EXISTS (SELECT 1 FROM panels p WHERE p.doc_id = sw.doc_id AND mx BETWEEN xmin AND xmax AND my BETWEEN ymin AND ymax)),
 n AS (SELECT * FROM d WHERE dist <= 25 QUALIFY row_number() OVER (PARTITION BY doc_id, line_id ORDER BY dist, label) = 1)
 SELECT doc_id, style_key, arg_min(label, (length(label), label)) AS label FROM n GROUP BY ALL""",
)
def nearest_label(spark, sf_dir):
    lines = adapters.lines(spark, sf_dir)
    swatches = lines.withColumn("style_key", scalar.style_key(F.col("stroke"), F.col("dash"), F.col("sw")))
    texts = lines.select("doc_id", F.concat(F.lit("label"), (F.col("line_id") % 97).cast("string")).alias("label"), (F.col("x1") + 3.0).alias("tx"), (F.col("y1") + 4.0).alias("ty"))
    return spatial.nearest_label(swatches, texts, ["doc_id"], panels=_panels(spark, sf_dir))


@query(
    "attach_legend",
    _SW + f""", lg AS (SELECT doc_id, style_key, min(label) AS label FROM sw JOIN (SELECT doc_id, min(label) AS label FROM tx GROUP BY doc_id) USING (doc_id) GROUP BY ALL),
 st AS (SELECT doc_id, lower(stroke) || '|' || {_STYLE} || '|' || sw::INT::VARCHAR AS style_key FROM lines)
 SELECT st.doc_id, style_key, label, count(*) AS n FROM st LEFT JOIN lg USING (doc_id, style_key) GROUP BY ALL""",
)
def attach_legend(spark, sf_dir):
    lines = adapters.lines(spark, sf_dir).withColumn("style_key", scalar.style_key(F.col("stroke"), F.col("dash"), F.col("sw")))
    low = lines.groupBy("doc_id").agg(F.min(F.concat(F.lit("label"), (F.col("line_id") % 97).cast("string"))).alias("label"))
    short = scalar.line_length(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]).between(1e-9, 40)
    legend = lines.filter(short).select("doc_id", "style_key").distinct().join(low, "doc_id")
    return spatial.attach_legend(lines.select("doc_id", "style_key"), legend, ["doc_id"]).groupBy("doc_id", "style_key", "label").agg(F.count("*").alias("n"))


_PTS = _L + ", pt AS (SELECT doc_id, (line_id % 3)::INT AS curve_id, x2 AS px, y2 AS py FROM lines)"


@query(
    "assign_censor_ticks",
    _PANELS + _PTS.removeprefix(_L) + """, t AS (SELECT doc_id, line_id, (x1 + x2) / 2.0 AS mx, (y1 + y2) / 2.0 AS my, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS length FROM lines),
 d AS (SELECT t.doc_id, line_id, curve_id, px, py, sqrt((mx - px) * (mx - px) + (my - py) * (my - py)) AS dist FROM t JOIN pt ON t.doc_id = pt.doc_id WHERE length BETWEEN 2 AND 8
  AND EXISTS (SELECT 1 FROM panels p WHERE p.doc_id = t.doc_id AND mx BETWEEN xmin AND xmax AND my BETWEEN ymin AND ymax))
 SELECT doc_id, line_id, curve_id, round(dist, 6) AS dist FROM d WHERE dist <= 4 QUALIFY row_number() OVER (PARTITION BY doc_id, line_id ORDER BY dist, curve_id, px, py) = 1""",
)
def assign_censor_ticks(spark, sf_dir):
    lines = adapters.lines(spark, sf_dir)
    pts = lines.select("doc_id", (F.col("line_id") % 3).cast("int").alias("curve_id"), F.col("x2").alias("px"), F.col("y2").alias("py"))
    return spatial.assign_censor_ticks(lines, pts, ["doc_id"], panels=_panels(spark, sf_dir)).select("doc_id", "line_id", "curve_id", F.round("dist", 6).alias("dist"))


@query(
    "clip_to_panel",
    _PANELS + ", pt AS (SELECT doc_id, line_id, x2 AS px, y2 AS py FROM lines) SELECT p.doc_id, panel_id, count(*) AS n FROM pt JOIN panels p ON p.doc_id = pt.doc_id AND px BETWEEN xmin AND xmax AND py BETWEEN ymin AND ymax GROUP BY ALL",
)
def clip_to_panel(spark, sf_dir):
    pts = adapters.lines(spark, sf_dir).select("doc_id", "line_id", F.col("x2").alias("px"), F.col("y2").alias("py"))
    return spatial.clip_to_panel(pts, _panels(spark, sf_dir), ["doc_id"]).groupBy("doc_id", "panel_id").agg(F.count("*").alias("n"))


@query(
    "text_in_region",
    _L + """, w AS (SELECT doc_id, 'w' || (line_id % 50)::VARCHAR AS text, x1 AS left_, y1 AS top FROM lines)
 SELECT doc_id, r AS region_id, string_agg(text, ' ' ORDER BY top, left_, text) AS text FROM w, (SELECT unnest([0, 1]) AS r)
 WHERE left_ < 500 AND left_ + 20 > 0 AND top < 60 + 340 * r AND top + 8 > 340 * r GROUP BY ALL""",
)
def text_in_region(spark, sf_dir):
    lines = adapters.lines(spark, sf_dir)
    words = lines.select("doc_id", F.concat(F.lit("w"), (F.col("line_id") % 50).cast("string")).alias("text"), F.col("x1").alias("left"), F.col("y1").alias("top"), F.lit(20.0).alias("width"), F.lit(8.0).alias("height"))
    r = F.explode(F.array(*[F.struct(F.lit(i).alias("region_id"), F.lit(0.0).alias("rx1"), F.lit(500.0).alias("rx2"), F.lit(340.0 * i).alias("ry1"), F.lit(60.0 + 340 * i).alias("ry2")) for i in (0, 1)]))
    regions = lines.select("doc_id").distinct().select("doc_id", r.alias("r")).select("doc_id", "r.*")
    return spatial.text_in_region(words, regions, ["doc_id"])


_PATH = "WITH " + adapters.POINTS + """, k AS (SELECT figure_id, curve_id, seq, floor(time * 8)::INT AS x, floor((1.0 - survival) * 400.0)::INT AS y FROM points)"""


def _paths(spark, sf_dir):
    """One path for each curve."""
    p = adapters.points(spark, sf_dir)
    xy = p.select("figure_id", "curve_id", "seq", F.floor(F.col("time") * 8).cast("int").alias("x"), F.floor((F.lit(1.0) - F.col("survival")) * 400.0).cast("int").alias("y"))
    part = F.when(F.col("seq") == 0, F.concat(F.lit("M "), F.col("x").cast("string"), F.lit(" "), F.col("y").cast("string"))).otherwise(
        F.concat(F.lit("H "), F.col("x").cast("string"), F.lit(" V "), F.col("y").cast("string"))
    )
    return xy.groupBy("figure_id", "curve_id").agg(F.sort_array(F.collect_list(F.struct("seq", part.alias("t")))).alias("ts")).select(
        "figure_id", "curve_id", F.array_join(F.transform("ts", lambda t: t["t"]), " ").alias("d")
    )


@query(
    "flatten_path",
    _PATH + """ SELECT figure_id, curve_id, CASE WHEN seq = 0 THEN 0 ELSE 2 * seq - 1 END::INT AS idx, x::DOUBLE AS px, CASE WHEN seq = 0 THEN y ELSE lag(y) OVER w END::DOUBLE AS py FROM k WINDOW w AS (PARTITION BY figure_id, curve_id ORDER BY seq)
 UNION ALL SELECT figure_id, curve_id, (2 * seq)::INT, x::DOUBLE, y::DOUBLE FROM k WHERE seq > 0""",
)
def flatten_path(spark, sf_dir):
    return spatial.flatten_path(_paths(spark, sf_dir), ["figure_id", "curve_id"])


@query("path_candidates", _PATH + " SELECT figure_id, curve_id, 2 * (count(*) - 1) AS segments FROM k GROUP BY ALL HAVING 2 * (count(*) - 1) >= 20")
def path_candidates(spark, sf_dir):
    c = spatial.path_candidates(_paths(spark, sf_dir), ["figure_id", "curve_id"])
    return c.select("figure_id", "curve_id", F.regexp_count("d", F.lit("[LHVlhv]")).cast("long").alias("segments"))
