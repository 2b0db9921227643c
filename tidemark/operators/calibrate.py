"""Axis calibration from tick labels, words and fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators.spatial import in_boxes

KEYS = ["figure_id", "curve_id"]


def calibrate_extent(pixels: DataFrame, calibration: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Calibration scaled by the curve's own extent; null where it has none."""
    w = Window.partitionBy(*keys)
    part = lambda c: (F.col(c) - F.min(c).over(w)) / F.nullif(F.max(c).over(w) - F.min(c).over(w), F.lit(0.0))
    at = pixels.withColumn("__fx", part("x")).withColumn("__fy", part("y"))
    rows = at.join(calibration, "figure_id")
    time = F.col("x_lo") + F.col("__fx") * (F.col("x_hi") - F.col("x_lo"))
    survival = F.col("y_hi") - F.col("__fy") * (F.col("y_hi") - F.col("y_lo"))
    return rows.select(*keys, "seq", time.alias("time"), survival.alias("survival"))


def fit_axis_linear(ticks: DataFrame, keys: list[str]) -> DataFrame:
    """Least squares of ``value`` on ``pos`` for each axis; a warning where r2 is under 0.95; at least 2 ticks."""
    fit = ticks.groupBy(*keys).agg(
        F.count("*").alias("n"), F.regr_slope("value", "pos").alias("slope"), F.regr_intercept("value", "pos").alias("intercept"), F.regr_r2("value", "pos").alias("r2")
    )
    return fit.filter("n >= 2").withColumn("warning", F.coalesce(F.col("r2") < 0.95, F.lit(True)))


def fit_axis_robust(ticks: DataFrame, keys: list[str], rounds: int = 20, bend: float = 1.345) -> DataFrame:
    """The same with Huber weights, from ``rounds`` rounds of weighted least squares.

    Ticks of an axis are few; they travel as one array and the rounds are a fold
    over it, so all axes are fitted in one pass.
    """
    pts = ticks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("pos").cast("double").alias("x"), F.col("value").cast("double").alias("y")))).alias("p")).filter(F.size("p") >= 2)

    def total(p: Column, f) -> Column:
        return F.aggregate(F.transform(p, f), F.lit(0.0), lambda a, b: a + b)

    def once(state: Column) -> Column:
        res = lambda t: t["y"] - state["a"] - state["b"] * t["x"]
        return F.element_at(
            F.transform(
                F.array(F.greatest(_median(F.transform(F.col("p"), lambda t: F.abs(res(t)))) / 0.6745, F.lit(1e-9))),
                lambda scale: _weighted(F.col("p"), lambda t: F.least(F.lit(1.0), bend * scale / F.greatest(F.abs(res(t)), F.lit(1e-12))), total),
            ),
            1,
        )

    start = _weighted(F.col("p"), lambda t: F.lit(1.0), total)
    out = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda s, _: once(s))
    return pts.select(*keys, out.alias("f")).select(*keys, F.col("f.b").alias("slope"), F.col("f.a").alias("intercept"))


def _median(values: Column) -> Column:
    ordered = F.array_sort(values)
    n = F.size(values)
    return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2.0


def _weighted(p: Column, w, total) -> Column:
    sums = F.struct(
        total(p, w).alias("w"), total(p, lambda t: w(t) * t["x"]).alias("x"), total(p, lambda t: w(t) * t["y"]).alias("y"),
        total(p, lambda t: w(t) * t["x"] * t["x"]).alias("xx"), total(p, lambda t: w(t) * t["x"] * t["y"]).alias("xy"),
    )

    def line(s: Column) -> Column:
        det = s["w"] * s["xx"] - s["x"] * s["x"]
        b = F.when(F.abs(det) > 1e-12, (s["w"] * s["xy"] - s["x"] * s["y"]) / det).otherwise(F.lit(0.0))
        return F.struct(((s["y"] - b * s["x"]) / s["w"]).alias("a"), b.alias("b"))

    return F.element_at(F.transform(F.array(sums), line), 1)


def fit_axis_two_point(ticks: DataFrame, keys: list[str]) -> DataFrame:
    """Slope and intercept through the first and last label by position."""
    ends = ticks.groupBy(*keys).agg(F.min(F.struct("pos", "value")).alias("a"), F.max(F.struct("pos", "value")).alias("b"), F.count("*").alias("n"))
    slope = (F.col("b.value") - F.col("a.value")) / F.nullif(F.col("b.pos") - F.col("a.pos"), F.lit(0.0))
    return ends.filter("n >= 2").select(*keys, "n", slope.alias("slope"), (F.col("a.value") - slope * F.col("a.pos")).alias("intercept"))


def detect_tick_row(words: DataFrame, keys: list[str], band: float = 10.0) -> DataFrame:
    """The row of x tick labels: numbers in [0, 150] in a band of y, at least 3, rising from left to right.

    ``keys, row_id, n, y``; the rows with the most labels win, then the rightmost.
    """
    from tidemark.operators.cluster import cluster_rows_gap

    numbers = words.withColumn("value", scalar.word_number(F.col("text"))).filter(F.col("value").between(0, 150))
    rows = cluster_rows_gap(numbers, keys, "top", band)
    w = Window.partitionBy(*keys, "row_id").orderBy("left", "value")
    rise = rows.withColumn("__d", F.col("value") - F.lag("value").over(w)).withColumn("__rl", F.rank().over(Window.partitionBy(*keys, "row_id").orderBy("left"))).withColumn(
        "__rv", F.rank().over(Window.partitionBy(*keys, "row_id").orderBy("value"))
    )
    found = rise.groupBy(*keys, "row_id").agg(
        F.count("*").alias("n"), F.avg("top").alias("y"), F.min("__d").alias("least"), F.corr(F.col("__rl").cast("double"), F.col("__rv").cast("double")).alias("rho"), F.max("left").alias("right")
    ).filter("n >= 3 and least > 0 and rho > 0.9")
    best = Window.partitionBy(*keys).orderBy(F.desc("n"), F.desc("right"), "row_id")
    return found.withColumn("__k", F.row_number().over(best)).filter("__k = 1").select(*keys, "row_id", "n", "y")


def axis_candidates(words: DataFrame, axes: DataFrame, keys: list[str], above: float = 100.0, below: float = 20.0, left: float = 50.0, right: float = 500.0) -> DataFrame:
    """Words that are numbers (``value``) in a band around a horizontal axis line (``axis_id``)."""
    y, a, b = F.col("y1"), F.least("x1", "x2"), F.greatest("x1", "x2")
    zones = axes.filter("direction = 'h'").select(*keys, F.col("line_id").alias("axis_id"), (a - left).alias("__a"), (b + right).alias("__b"), (y - above).alias("__c"), (y + below).alias("__d"))
    numbers = words.withColumn("value", F.col("text").try_cast("double")).filter("value is not null")
    return in_boxes(numbers, zones, keys, "left", "top", ("__a", "__b", "__c", "__d")).drop("__a", "__b", "__c", "__d")


def even_sequence(texts: DataFrame, keys: list[str], tolerance: float = 0.05) -> DataFrame:
    """The best evenly spaced run of at least 3 of the numbers ``nums`` (a sorted array).

    Each start and each later number give a first interval; a run takes every
    next number within ``tolerance`` intervals of where it should be. Scores: 100
    a tick, 500 if it starts at 0, 300 times the share of the range it covers,
    and 200 more for any run; the first of the best runs is taken.
    """
    pairs = texts.filter(F.size("nums") >= 3).select(*keys, "nums", F.posexplode("nums").alias("i", "first")).select(
        "*", F.posexplode(F.slice("nums", F.col("i") + 2, F.size("nums"))).alias("j", "second")
    )
    step = F.col("second") - F.col("first")
    run = F.aggregate(
        F.col("nums"),
        F.struct(F.array(F.col("first")).alias("seq"), F.col("second").alias("next")),
        lambda a, v: F.when(F.abs(v - a["next"]) <= step * tolerance, F.struct(F.array_append(a["seq"], v).alias("seq"), (v + step).alias("next"))).otherwise(a),
        lambda a: a["seq"],
    )
    spread = F.nullif(F.array_max("nums") - F.array_min("nums"), F.lit(0.0))
    scored = pairs.filter(step > 0).withColumn("seq", run).filter(F.size("seq") >= 3)
    cover = (F.array_max("seq") - F.array_min("seq")) / spread
    score = F.size("seq") * 100 + F.when(F.col("first") == 0, 500).otherwise(0) + F.coalesce(cover, F.lit(0.0)) * 300 + 200
    best = F.max_by(F.struct("seq", "score"), F.struct(F.col("score"), -F.col("i"), -F.col("j")))
    return scored.withColumn("score", score).groupBy(*keys).agg(best.alias("b")).select(*keys, "b.seq", "b.score")


def axis_from_text(texts: DataFrame, keys: list[str], axis: str) -> DataFrame:
    """Range, unit and confidence of an axis from its text; null range with fewer than 2 numbers."""
    nums = scalar.extract_numbers(F.col("text"), axis)
    rows = texts.withColumn("nums", nums)
    ok = F.size("nums") >= 2
    return rows.select(
        *keys,
        F.when(ok, F.array_min("nums")).alias("lo"),
        F.when(ok, F.array_max("nums")).alias("hi"),
        F.size("nums").alias("n"),
        scalar.detect_unit(F.col("text"), axis).alias("unit"),
        F.when(ok, F.lit(0.95)).otherwise(F.lit(0.0)).alias("confidence"),
    )


def axis_from_word_positions(words: DataFrame, keys: list[str], axis: str) -> DataFrame:
    """Tick values with their pixels, in order along the axis."""
    pos = (F.col("left") + F.col("width") / 2.0) if axis == "x" else (F.col("top") + F.col("height") / 2.0)
    ticks = words.select(*keys, pos.alias("pos"), scalar.word_number(F.col("text")).alias("value")).filter("value is not null")
    return ticks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("ticks")).select(
        *keys, F.transform("ticks", lambda t: t["value"]).alias("tick_values"), F.transform("ticks", lambda t: t["pos"]).alias("tick_positions")
    )


def calibration_ladder(figures: DataFrame, text: DataFrame, table: DataFrame, risk: DataFrame) -> DataFrame:
    """The first acceptable source for each figure: text, table, at-risk times for x, or the defaults 0-60 and 0-1.

    Sources have ``figure_id, x_lo, x_hi, y_lo, y_hi, x_conf, y_conf``; ``risk``
    has ``figure_id, x_lo, x_hi``.
    """
    def named(df: DataFrame, tag: str) -> DataFrame:
        return df.select("figure_id", *[F.col(c).alias(f"{tag}_{c}") for c in df.columns if c != "figure_id"])

    at = figures.select("figure_id").join(named(text, "t"), "figure_id", "left").join(named(table, "o"), "figure_id", "left").join(named(risk, "r"), "figure_id", "left")
    by_text = F.coalesce((F.col("t_x_conf") >= 0.5) & (F.col("t_y_conf") >= 0.5), F.lit(False))
    by_table = ~by_text & F.col("o_x_conf").isNotNull()
    by_risk = by_table & (F.col("o_x_conf") < 0.8) & F.col("r_x_hi").isNotNull()

    def pick(c: str, default: float) -> Column:
        risk_value = F.col(f"r_{c}") if c.startswith("x") else F.lit(None).cast("double")
        return F.when(by_text, F.col(f"t_{c}")).when(by_risk & risk_value.isNotNull(), risk_value).when(by_table, F.col(f"o_{c}")).otherwise(F.lit(default)).alias(c)

    method = F.when(by_text, "text").when(by_risk, "risk table").when(by_table, "ocr").otherwise("fallback")
    return at.select("figure_id", pick("x_lo", 0.0), pick("x_hi", 60.0), pick("y_lo", 0.0), pick("y_hi", 1.0), method.alias("method"), (method == "fallback").alias("fallback"))
