"""Views over the test tables in the shapes the operators take, and their SQL twins.

Each view is plain expressions over one or two tables, so both engines compute
the same rows: integer arithmetic before division, and times as whole numbers
wherever possible.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ipd_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patient records with negative follow-up and repeated subjects left in."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_orderpriority").alias("study_id"),
        F.col("l_returnflag").alias("arm"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("subject_id"),
        F.lit(0.0).alias("time_start"),
        F.date_diff("l_shipdate", "o_orderdate").cast("double").alias("time_end"),
        (F.col("l_linestatus") == "F").cast("int").alias("event"),
    )


IPD_RAW = """ipd_raw AS (SELECT o_orderpriority AS study_id, l_returnflag AS arm, l_orderkey * 10 + l_linenumber AS subject_id,
 0.0::DOUBLE AS time_start, date_diff('day', o_orderdate::DATE, l_shipdate::DATE)::DOUBLE AS time_end,
 (l_linestatus = 'F')::INT AS event FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def ipd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patient records in whole months of 30 days."""
    raw = ipd_raw(spark, sf_dir).filter("time_end >= 0")
    return raw.withColumn("time", F.floor(F.col("time_end") / 30).cast("double")).drop("time_end")


IPD = IPD_RAW + """, ipd AS (SELECT study_id, arm, subject_id, time_start, event, floor(time_end / 30)::DOUBLE AS time FROM ipd_raw WHERE time_end >= 0)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curve points: ten figures of one curve for each event type."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    kinds = events.select("event_type").distinct()
    numbered = kinds.select("event_type", (F.row_number().over(Window.orderBy("event_type")) - 1).cast("int").alias("curve_id"))
    time = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)).cast("double") / 43200000000.0
    out = events.join(numbered, "event_type").select(
        (F.col("user_id") % 10).cast("int").alias("figure_id"), "curve_id", "event_id", F.round(time, 6).alias("time"), "value"
    )
    survival = F.least(F.lit(1.0), F.lit(1.0) - F.col("time") / 75.0 + (F.col("value") / 500.0 - 0.2) * 0.1)
    seq = F.row_number().over(Window.partitionBy("figure_id", "curve_id").orderBy("time", "event_id")) - 1
    return out.select("figure_id", "curve_id", seq.cast("int").alias("seq"), "time", F.round(survival, 6).alias("survival"))


POINTS = """kinds AS (SELECT event_type, (row_number() OVER (ORDER BY event_type) - 1)::INT AS curve_id FROM (SELECT DISTINCT event_type FROM events)),
ev AS (SELECT (user_id % 10)::INT AS figure_id, curve_id, event_id, round((epoch_us(ts) - 1704067200000000)::DOUBLE / 43200000000.0, 6) AS time, value
 FROM events JOIN kinds USING (event_type)),
points AS (SELECT figure_id, curve_id, (row_number() OVER (PARTITION BY figure_id, curve_id ORDER BY time, event_id) - 1)::INT AS seq, time,
 round(least(1.0, 1.0 - time / 75.0 + (value / 500.0 - 0.2) * 0.1), 6) AS survival FROM ev)"""


def points_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in which figure 7 lies too high, figure 8 is short and figure 9 runs backward."""
    p = points(spark, sf_dir).filter("figure_id <> 8 or seq < 20")
    return p.withColumn("survival", F.when(F.col("figure_id") == 7, F.round(F.col("survival") + 0.5, 6)).otherwise(F.col("survival"))).withColumn(
        "time", F.when(F.col("figure_id") == 9, F.round(F.lit(100.0) - F.col("time"), 6)).otherwise(F.col("time"))
    )


POINTS_DIRTY = POINTS + """, dirty AS (SELECT figure_id, curve_id, seq, CASE WHEN figure_id = 9 THEN round(100.0 - time, 6) ELSE time END AS time,
 CASE WHEN figure_id = 7 THEN round(survival + 0.5, 6) ELSE survival END AS survival FROM points WHERE figure_id <> 8 OR seq < 20)"""


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each figure; every third has a percent axis, every fifth is a fallback."""
    f = table(spark, sf_dir, "events").select((F.col("user_id") % 10).cast("int").alias("figure_id")).distinct()
    third = F.col("figure_id") % 3 == 0
    return f.select(
        "figure_id",
        F.lit(0.0).alias("x_lo"),
        F.lit(60.0).alias("x_hi"),
        F.lit(0.0).alias("y_lo"),
        F.when(third, F.lit(100.0)).otherwise(F.lit(1.0)).alias("y_hi"),
        F.lit("months").alias("x_unit"),
        F.when(third, F.lit("percentage")).otherwise(F.lit("probability")).alias("y_unit"),
        (F.col("figure_id") % 5 == 0).alias("fallback"),
    )


CALIBRATION = """calibration AS (SELECT figure_id, 0.0::DOUBLE AS x_lo, 60.0::DOUBLE AS x_hi, 0.0::DOUBLE AS y_lo,
 (CASE WHEN figure_id % 3 = 0 THEN 100.0 ELSE 1.0 END)::DOUBLE AS y_hi, 'months' AS x_unit,
 CASE WHEN figure_id % 3 = 0 THEN 'percentage' ELSE 'probability' END AS y_unit, figure_id % 5 = 0 AS fallback
 FROM (SELECT DISTINCT (user_id % 10)::INT AS figure_id FROM events))"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of ten panels of 640 x 480."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 10).cast("int").alias("figure_id"),
        (F.col("l_partkey") % 640).cast("int").alias("x"),
        (F.col("l_orderkey") % 480).cast("int").alias("y"),
        (F.col("l_partkey") * 37 % 256).cast("int").alias("r"),
        (F.col("l_suppkey") * 53 % 256).cast("int").alias("g"),
        (F.col("l_orderkey") * 91 % 256).cast("int").alias("b"),
    )


PIXELS = """pixels AS (SELECT (l_suppkey % 10)::INT AS figure_id, (l_partkey % 640)::INT AS x, (l_orderkey % 480)::INT AS y,
 (l_partkey * 37 % 256)::INT AS r, (l_suppkey * 53 % 256)::INT AS g, (l_orderkey * 91 % 256)::INT AS b FROM lineitem)"""


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curves of ``points`` drawn as solid steps of one pixel, each pixel by the first curve that covers it."""
    p = points(spark, sf_dir).select("figure_id", "curve_id", F.floor(F.col("time") * 10).cast("int").alias("x"), (F.floor((F.lit(1.0) - F.col("survival")) * 300.0).cast("int") + 40 + F.col("curve_id") * 30).alias("y"))
    w = Window.partitionBy("figure_id", "curve_id").orderBy("x")
    top = p.groupBy("figure_id", "curve_id", "x").agg(F.max("y").alias("y")).withColumn("y", F.max("y").over(w))
    ends = top.withColumn("last_y", F.coalesce(F.lag("y").over(w), "y")).withColumn("next_x", F.coalesce(F.lead("x").over(w), F.col("x") + 1))
    up = ends.select("figure_id", "curve_id", "x", F.explode(F.sequence("last_y", "y")).alias("y"))
    along = ends.select("figure_id", "curve_id", F.explode(F.sequence("x", F.col("next_x") - 1)).alias("x"), "y")
    return up.union(along).groupBy("figure_id", "x", "y").agg(F.min("curve_id").alias("curve_id"))


RASTER = POINTS + """, rp AS (SELECT figure_id, curve_id, floor(time * 10)::INT AS x, floor((1.0 - survival) * 300.0)::INT + 40 + curve_id * 30 AS y FROM points),
rt AS (SELECT figure_id, curve_id, x, max(max(y)) OVER (PARTITION BY figure_id, curve_id ORDER BY x) AS y FROM rp GROUP BY figure_id, curve_id, x),
re AS (SELECT *, coalesce(lag(y) OVER w, y) AS last_y, coalesce(lead(x) OVER w, x + 1) AS next_x FROM rt WINDOW w AS (PARTITION BY figure_id, curve_id ORDER BY x)),
rr AS (SELECT figure_id, curve_id, x, unnest(range(last_y, y + 1))::INT AS y FROM re UNION ALL SELECT figure_id, curve_id, unnest(range(x, next_x))::INT AS x, y FROM re),
raster AS (SELECT figure_id, x, y, min(curve_id) AS curve_id FROM rr GROUP BY ALL)"""


def painted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raster`` with a colour for each curve."""
    colours = F.array(*[F.array(*map(F.lit, c)) for c in ((215, 25, 28), (26, 150, 65), (43, 60, 200), (150, 40, 160), (10, 140, 150), (200, 140, 10))])
    c = F.get(colours, F.col("curve_id") % 6)
    return raster(spark, sf_dir).select("figure_id", "x", "y", *[F.get(c, F.lit(i)).alias(n) for i, n in enumerate("rgb")])


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector lines of twenty documents."""
    flat = F.col("o_orderkey") % 2 == 0
    size = (F.col("o_orderkey") % 400).cast("double")
    x, y = (F.col("o_custkey") % 500).cast("double"), (F.col("o_custkey") * 7 % 400).cast("double")
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 20).cast("int").alias("doc_id"),
        F.col("o_orderkey").alias("line_id"),
        x.alias("x1"),
        y.alias("y1"),
        F.when(flat, x + size).otherwise(x).alias("x2"),
        F.when(flat, y).otherwise(y + size).alias("y2"),
        F.col("o_orderstatus").alias("stroke"),
        F.col("o_orderpriority").alias("dash"),
        (F.col("o_orderkey") % 3).cast("double").alias("sw"),
    )


LINES = """lines AS (SELECT (o_custkey % 20)::INT AS doc_id, o_orderkey AS line_id, (o_custkey % 500)::DOUBLE AS x1, (o_custkey * 7 % 400)::DOUBLE AS y1,
 (o_custkey % 500 + CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 400 ELSE 0 END)::DOUBLE AS x2,
 (o_custkey * 7 % 400 + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE o_orderkey % 400 END)::DOUBLE AS y2,
 o_orderstatus AS stroke, o_orderpriority AS dash, (o_orderkey % 3)::DOUBLE AS sw FROM orders)"""


def nma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of ten two-arm studies over five treatments (market segments)."""
    lines_ = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    segments = customer.select("c_mktsegment").distinct().select("c_mktsegment", (F.row_number().over(Window.orderBy("c_mktsegment")) - 1).alias("k"))
    rows = (
        lines_.join(orders, lines_.l_orderkey == orders.o_orderkey)
        .join(customer, orders.o_custkey == customer.c_custkey)
        .join(segments, "c_mktsegment")
        .withColumn("study_no", (F.col("o_custkey") % 10).cast("int"))
    )
    one = F.element_at(F.array(*map(F.lit, (0, 0, 0, 0, 1, 1, 1, 2, 2, 3))), F.col("study_no") + 1)
    two = F.element_at(F.array(*map(F.lit, (1, 2, 3, 4, 2, 3, 4, 3, 4, 4))), F.col("study_no") + 1)
    days = F.date_diff("l_shipdate", "o_orderdate")
    return rows.filter((F.col("k") == one) | (F.col("k") == two)).filter(days >= 0).select(
        F.concat(F.lit("S"), F.col("study_no").cast("string")).alias("study_id"),
        F.col("c_mktsegment").alias("arm"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("subject_id"),
        F.floor(days / 30).cast("double").alias("time"),
        (F.col("l_linestatus") == "F").cast("int").alias("event"),
    )


NMA = """segs AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS k FROM (SELECT DISTINCT c_mktsegment FROM customer)),
nma AS (SELECT 'S' || (o_custkey % 10)::VARCHAR AS study_id, c_mktsegment AS arm, l_orderkey * 10 + l_linenumber AS subject_id,
 floor(date_diff('day', o_orderdate::DATE, l_shipdate::DATE) / 30)::DOUBLE AS time, (l_linestatus = 'F')::INT AS event
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN segs USING (c_mktsegment)
 WHERE k IN ([0,0,0,0,1,1,1,2,2,3][o_custkey % 10 + 1], [1,2,3,4,2,3,4,3,4,4][o_custkey % 10 + 1])
 AND date_diff('day', o_orderdate::DATE, l_shipdate::DATE) >= 0)"""
