"""Curves ingested as files arrive: each file is validated, decimated and catalogued once.

A batch writes verdicts, points and its part of the catalogue into folders of its
own, and then a line of the log. Readers see the batches that the log names, so
what a batch left when it was killed between two writes is never seen; the batch
is tried again and writes its folders anew. A batch that is in the log is not
written a second time, even if it ended before the checkpoint knew of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import shape, validate
from tidemark.sources.curves import NAME, POINT
from tidemark.sources.sinks import curve_file

KEYS = ["doc_id", "page", "figure_id", "curve_id"]
TABLES = ("verdicts", "points", "catalog")
_LOG = "batch long, curves long, valid long"
_PARTS = "doc_id string, page int, figure_id int, curve_id int"


def stream_points(spark: SparkSession, path: str, files: int = 1000, named: bool = True) -> DataFrame:
    """The file source of curve points, ``files`` a batch; a curve's keys are in its file's name, or if not ``named`` in its folders' names."""
    source = spark.readStream.option("header", True).option("maxFilesPerTrigger", files)
    if not named:
        return source.schema("time double, survival double, " + _PARTS).csv(path).select(*KEYS, "time", "survival")
    f = source.schema(POINT).csv(path).withColumn("__f", F.col("_metadata.file_name"))
    part = lambda i: F.regexp_extract("__f", NAME, i)
    return f.select(part(1).alias("doc_id"), part(2).cast("int").alias("page"), part(3).cast("int").alias("figure_id"), (part(4).cast("int") - 1).alias("curve_id"), "time", "survival")


def committed(spark: SparkSession, out: str) -> DataFrame:
    """The log: one row for each whole batch."""
    return spark.read.schema(_LOG).parquet(f"{out}/log")


def read_committed(spark: SparkSession, out: str, table: str) -> DataFrame:
    """A table of the output (``verdicts``, ``points`` or ``catalog``), of whole batches only."""
    if table not in TABLES:
        raise ValueError(f"no such table: {table}")
    batches = sorted(r.batch for r in committed(spark, out).select("batch").distinct().collect())  # a number for each batch
    if not batches:
        return spark.createDataFrame([], "batch long")
    return spark.read.option("basePath", f"{out}/{table}").parquet(*[f"{out}/{table}/batch={b}" for b in batches])


def _commit(spark: SparkSession, out: str, epoch: int, verdicts: DataFrame) -> None:
    total = verdicts.agg(F.count("*").alias("curves"), F.count_if("is_valid").alias("valid"))
    total.select(F.lit(epoch).cast("long").alias("batch"), "curves", "valid").coalesce(1).write.mode("append").parquet(f"{out}/log")


def incremental_curves(spark: SparkSession, path: str, out: str, checkpoint: str, min_points: int = 0, files: int = 1000, named: bool = True) -> StreamingQuery:
    """Runs until the folder is read (``availableNow``): verdicts, points of good curves and the catalogue, by batch.

    The checkpoint remembers files, so each file counts once.
    """
    spark.createDataFrame([], _LOG).write.mode("ignore").parquet(f"{out}/log")

    def batch(points: DataFrame, epoch: int) -> None:
        own = points.sparkSession
        if not committed(own, out).filter(F.col("batch") == epoch).isEmpty():
            return
        order = Window.partitionBy(*KEYS).orderBy("time", "survival")
        rows = points.withColumn("seq", (F.row_number().over(order) - 1).cast("int"))
        place = lambda table: f"{out}/{table}/batch={epoch}"
        validate.validate_curve(rows, KEYS, min_points, fallback=True).write.mode("overwrite").parquet(place("verdicts"))
        good = validate.filter_curves(rows, keys=KEYS, min_points=min_points)
        shape.decimate(good, 500, keys=KEYS).write.mode("overwrite").parquet(place("points"))
        verdicts = own.read.parquet(place("verdicts"))
        listed = points.groupBy(*KEYS).agg(F.count("*").alias("n_points")).join(verdicts.select(*KEYS, F.col("is_valid").alias("calibration_valid")), KEYS, "left")
        name = curve_file(F.col("doc_id"), F.col("page"), F.concat(F.lit("f"), F.col("figure_id")), F.col("curve_id"))
        listed.select(*KEYS, "n_points", name.alias("csv_path"), "calibration_valid").write.mode("overwrite").parquet(place("catalog"))
        _commit(own, out, epoch, verdicts)

    source = stream_points(spark, path, files, named)
    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
