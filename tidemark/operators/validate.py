"""Rules over curves, at-risk tables and axes. Every rule set is one aggregation and a CASE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import shape

KEYS = shape.KEYS


def _moves(points: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("seq")
    return points.withColumn("ds", F.col("survival") - F.lag("survival").over(w)).withColumn("dt", F.col("time") - F.lag("time").over(w))


def curve_direction(points: DataFrame, keys: list[str] = KEYS, least: float = 0.01) -> DataFrame:
    """``direction``: where more changes fall than rise decreasing, the reverse increasing, else mixed."""
    n = _moves(points, keys).groupBy(*keys).agg(F.count_if(F.col("ds") < -least).alias("down"), F.count_if(F.col("ds") > least).alias("up"))
    return n.withColumn("direction", _direction())


def _direction() -> Column:
    return F.when(F.col("down") > F.col("up"), "decreasing").when(F.col("up") > F.col("down"), "increasing").otherwise("mixed")


def validate_curve(points: DataFrame, keys: list[str] = KEYS, min_points: int = 100, fallback: bool = False) -> DataFrame:
    """One row a curve: ``is_valid, quality_score, reason, warnings, direction``.

    Rejections in order, then 100 less deductions. ``min_points`` becomes 5 for
    curves of fewer than 50 points, as in batch use, if it is given as 0.
    """
    s = _moves(points, keys).groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("time").alias("t_lo"), F.max("time").alias("t_hi"), F.min("survival").alias("s_lo"), F.max("survival").alias("s_hi"),
        F.count_if(F.col("dt") < -0.5).alias("back"), F.count_if(F.col("ds") < -0.01).alias("down"), F.count_if(F.col("ds") > 0.01).alias("up"),
    )
    least = F.when(F.col("n") < 50, F.lit(5)).otherwise(F.lit(100)) if min_points == 0 else F.lit(min_points)
    t, v = F.col("t_hi") - F.col("t_lo"), F.col("s_hi") - F.col("s_lo")
    reason = (
        F.when(F.col("n") < least, "too few points")
        .when(F.col("n") > 500_000, "too many points")
        .when(t < 5, "time range too small")
        .when(v < 0.15, "survival range too small")
        .when(F.col("s_lo") < -0.01, "survival below 0")
        .when(F.col("s_hi") > 1.01, "survival above 1")
        .when(F.col("t_lo") < -1, "starts before 0")
        .when(F.col("back") > 0, "time runs backward")
    )
    direction = _direction()
    n = F.col("n")
    deduct = [
        (t < 12, 10, "short time range"),
        (v < 0.3, 10, "low survival range"),
        (n > 10_000, 20, "very dense curve"),
        ((n > 5_000) & (n <= 10_000), 10, "dense curve"),
        (n < 200, 5, "sparse curve"),
        (F.lit(fallback), 5, "fallback calibration"),
    ]
    score = F.lit(100)
    for cond, points_, _ in deduct:
        score = score - F.when(cond, points_).otherwise(0)
    score = score + F.when((t > 36) & (v > 0.5), 5).otherwise(0)
    warnings = F.filter(F.array(*[F.when(cond, F.lit(text)) for cond, _, text in deduct]), lambda x: x.isNotNull())
    return s.select(
        *keys,
        "n",
        reason.isNull().alias("is_valid"),
        F.when(reason.isNotNull(), F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), score))).cast("int").alias("quality_score"),
        reason.alias("reason"),
        F.when(reason.isNotNull(), F.array().cast("array<string>")).otherwise(warnings).alias("warnings"),
        direction.alias("direction"),
    )


def filter_curves(points: DataFrame, least_score: int = 70, keys: list[str] = KEYS, min_points: int = 100) -> DataFrame:
    """Points of curves that pass with a score of ``least_score``; curves of over 2,000 points are decimated to 1,000."""
    good = validate_curve(points, keys, min_points, fallback=True).filter(F.col("is_valid") & (F.col("quality_score") >= least_score)).select(*keys, "n")
    rows = points.join(good, keys)
    return rows.filter("n <= 2000").drop("n").unionByName(shape.decimate(rows.filter("n > 2000").drop("n"), 1000, keys=keys))


def rejection_report(points: DataFrame, keys: list[str] = KEYS, min_points: int = 100) -> DataFrame:
    """Number and share of curves by reason, most first."""
    v = validate_curve(points, keys, min_points, fallback=True).groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))
    return v.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())).orderBy(F.desc("n"), "reason")


def validate_monotone(points: DataFrame, tolerance: float = 0.01, keys: list[str] = KEYS) -> DataFrame:
    """Whether no rise exceeds ``tolerance``; the number of points."""
    w = Window.partitionBy(*keys).orderBy("time", "seq")
    rise = points.withColumn("ds", F.col("survival") - F.lag("survival").over(w))
    return rise.groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.bool_and(F.col("ds") <= tolerance), F.lit(True)).alias("monotone"))


def validate_at_risk(table: DataFrame, keys: list[str], expected_groups: int) -> DataFrame:
    """First failing reason of an at-risk table ``keys, group_id, col, time, n_risk``."""
    w = Window.partitionBy(*keys, "group_id").orderBy("col")
    at = table.withColumn("dn", F.col("n_risk") - F.lag("n_risk").over(w)).withColumn("dt", F.col("time") - F.lag("time").over(w))
    group = at.groupBy(*keys, "group_id").agg(F.count("n_risk").alias("n"), F.max("dn").alias("dn"), F.min("dt").alias("dt"))
    s = group.groupBy(*keys).agg(F.count("*").alias("groups"), F.min("n").alias("n_lo"), F.max("n").alias("n_hi"), F.max("dn").alias("dn"), F.min("dt").alias("dt"))
    reason = (
        F.when(F.col("groups") != expected_groups, "unexpected number of groups")
        .when(F.col("n_lo") == 0, "empty group")
        .when(F.col("n_lo") != F.col("n_hi"), "groups differ in length")
        .when(F.col("dn") > 0, "numbers at risk rise")
        .when(F.col("dt") <= 0, "times do not rise")
    )
    return s.select(*keys, reason.isNull().alias("is_valid"), reason.alias("reason"))


def at_risk_agreement(table: DataFrame, curves: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Root mean square and largest difference between n / n0 and the curve at the table's times."""
    w = Window.partitionBy(*keys).orderBy("time")
    expected = table.withColumn("expected", F.col("n_risk") / F.first("n_risk").over(w))
    seen = shape.sample_step(curves, table.select(*keys, F.col("time").alias("grid_time")), keys)
    diff = expected.join(seen, (expected.time == seen.grid_time) & _same(expected, seen, keys)).select(*[expected[k] for k in keys], (expected.expected - seen.survival).alias("d"))
    return diff.groupBy(*keys).agg(F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"), F.max(F.abs("d")).alias("max_error"), F.count("*").alias("n"))


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & (a[k] == b[k])
    return out


def curve_agreement(a: DataFrame, b: DataFrame, upto: float, keys: list[str] = KEYS, n: int = 100) -> DataFrame:
    """RMSE, MAE, largest difference and Kendall's tau of two curves on a grid of ``n`` times, and their medians' difference."""
    step = upto / (n - 1)
    grid = shape.grid_for(a, step, upto, keys)
    x = shape.sample_step(a, grid, keys).withColumnRenamed("survival", "s1")
    y = shape.sample_step(b, grid, keys).withColumnRenamed("survival", "s2")
    both = x.join(y, [*keys, "grid_time"]).filter("s1 is not null and s2 is not null")
    d = F.col("s1") - F.col("s2")
    half = lambda c: F.min(F.when(F.col(c) <= 0.5, F.col("grid_time")))
    errors = both.groupBy(*keys).agg(
        F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), F.max(F.abs(d)).alias("max_error"), (half("s1") - half("s2")).alias("median_error")
    )
    p, q = (both.select(*keys, *[F.col(c).alias(f"{c}_{k}") for c in ("grid_time", "s1", "s2")]) for k in "pq")
    sign = F.signum((F.col("s1_p") - F.col("s1_q")) * (F.col("s2_p") - F.col("s2_q")))
    tau = p.join(q, keys).filter("grid_time_p < grid_time_q").groupBy(*keys).agg((F.sum(sign) / F.count("*")).alias("tau"))
    return errors.join(tau, keys)


def ks_distance(a: DataFrame, b: DataFrame, keys: list[str] = KEYS, column: str = "survival") -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance of the values of ``column``."""
    both = a.select(*keys, column, F.lit(1).alias("a")).unionByName(b.select(*keys, column, F.lit(0).alias("a")))
    at = both.groupBy(*keys, column).agg(F.sum("a").alias("na"), F.sum(1 - F.col("a")).alias("nb"))
    upto, whole = Window.partitionBy(*keys).orderBy(column), Window.partitionBy(*keys)
    gap = F.abs(F.sum("na").over(upto) / F.nullif(F.sum("na").over(whole), F.lit(0)) - F.sum("nb").over(upto) / F.nullif(F.sum("nb").over(whole), F.lit(0)))
    return at.withColumn("gap", gap).groupBy(*keys).agg(F.max("gap").alias("ks"))


def outlier_fence(points: DataFrame, k: float = 3.0, keys: list[str] = KEYS) -> DataFrame:
    """Points whose survival lies within Tukey's fence of their curve."""
    q = points.groupBy(*keys).agg(F.percentile("survival", F.lit(0.25)).alias("__q1"), F.percentile("survival", F.lit(0.75)).alias("__q3"))
    reach = (F.col("__q3") - F.col("__q1")) * k
    return points.join(q, keys).filter(F.col("survival").between(F.col("__q1") - reach, F.col("__q3") + reach)).drop("__q1", "__q3")


def monotone_repair(table: DataFrame, keys: list[str]) -> DataFrame:
    """At-risk numbers made non-increasing over ``col``; ``edited`` marks changes."""
    w = Window.partitionBy(*keys).orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    return table.withColumn("__n", F.min("n_risk").over(w)).withColumn("edited", F.col("__n") != F.col("n_risk")).withColumn("n_risk", F.col("__n")).drop("__n")


def qc_best(attempts: DataFrame, keys: list[str], quality: str, tie: str) -> DataFrame:
    """The attempt of the best quality for each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(quality), tie)
    return attempts.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def validate_axis(axis: DataFrame, variant: str = "ocr") -> DataFrame:
    """``ok`` and ``reason`` of axes ``x_lo, x_hi, y_lo, y_hi, y_unit, confidence, n_x, n_y, hough``.

    ``text`` asks for two ticks on each axis and narrow ranges, ``ocr`` for a
    probability within its range, ``ocr2`` takes any usual range, even at low
    confidence where lines were found.
    """
    x_lo, x_hi, y_lo, y_hi, conf = (F.col(c) for c in ("x_lo", "x_hi", "y_lo", "y_hi", "confidence"))
    empty = [(x_lo >= x_hi, "empty x range"), (y_lo >= y_hi, "empty y range")]
    if variant == "text":
        rules = [
            *empty,
            ((F.col("n_x") < 2) | (F.col("n_y") < 2), "too few ticks"),
            (conf < 0.5, "low confidence"),
            ((x_hi > 300) | (x_lo < -1), "x out of range"),
            ((y_hi > 1.5) | (y_lo < -0.1), "y out of range"),
        ]
    elif variant == "ocr":
        chance = F.col("y_unit") == "probability"
        rules = [empty[0], (x_lo < 0, "negative x"), empty[1], (chance & ((y_lo < -0.1) | (y_hi > 1.1)), "probability out of range"), (conf < 0.3, "low confidence")]
    elif variant == "ocr2":
        usual = (y_lo.between(0, 0.1) & y_hi.between(0.9, 1.1)) | (y_lo.between(0, 10) & y_hi.between(90, 110))
        rules = [((x_lo < 0) | (x_hi > 1000), "x out of range"), (x_hi - x_lo < 1, "empty x range"), (~usual, "y out of range"), (y_hi - y_lo < 0.1, "empty y range"), ((conf <= 0.2) & ~F.col("hough"), "low confidence")]
    else:
        raise ValueError(f"unknown variant {variant}")
    reason = F.lit(None).cast("string")
    for cond, text in reversed(rules):
        reason = F.when(cond, text).otherwise(reason)
    return axis.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())
