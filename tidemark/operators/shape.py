"""Shaping curves: envelopes, bins, steps, folds, resampling.

A curve is the rows of one value of ``keys`` in the order (time, seq). Windows
are always partitioned by the curve; folds that depend on the last kept point
walk once over a curve's rows in order, in an Arrow function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.shared import written

KEYS = ["figure_id", "curve_id"]
ORDER = ["time", "seq"]


def _w(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*ORDER)


def monotone_envelope(points: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Survival replaced by its running minimum."""
    return points.withColumn("survival", F.min("survival").over(_w(keys).rowsBetween(Window.unboundedPreceding, 0)))


def bin_points(points: DataFrame, width: int, method: str = "median", truncate: bool = False, keys: list[str] = KEYS) -> DataFrame:
    """One y for each x-bin of ``width`` pixels from floor(min x); x is the bin's centre.

    ``mode`` is the smallest of the most frequent values of y, rounded half to
    even, or cut off with ``truncate``. Curves of fewer than 2 points stay.
    """
    whole = Window.partitionBy(*keys)
    at = points.withColumn("__x0", F.floor(F.min("x").over(whole))).withColumn("__n", F.count("*").over(whole))
    bin_ = F.floor((F.col("x") - F.col("__x0")) / width)
    if method == "mode":
        y = F.floor("y") if truncate else F.bround("y", 0)
        counts = at.groupBy(*keys, "__x0", "__n", bin_.alias("bin"), y.cast("double").alias("y")).agg(F.count("*").alias("c"))
        value = F.min_by("y", F.struct(-F.col("c"), F.col("y")))
        binned = counts.groupBy(*keys, "__x0", "__n", "bin").agg(value.alias("y"))
    elif method in ("median", "mean"):
        value = F.median("y") if method == "median" else F.avg("y")
        binned = at.groupBy(*keys, "__x0", "__n", bin_.alias("bin")).agg(value.alias("y"), F.min("x").alias("__only"))
    else:
        raise ValueError(f"unknown method {method}")
    centre = F.col("__x0") + F.col("bin") * width + F.lit(width / 2.0)
    if "__only" in binned.columns:
        centre = F.when(F.col("__n") < 2, F.col("__only")).otherwise(centre)
    return binned.select(*keys, centre.alias("x"), "y")


def bin_time(points: DataFrame, step: float = 1.0, drop_last_edge: bool = False, keys: list[str] = KEYS) -> DataFrame:
    """Median survival per time bin, labelled by its left edge.

    ``drop_last_edge`` leaves out points that lie exactly on the upper edge of
    the whole range.
    """
    rows = points
    if drop_last_edge:
        top = F.ceil(F.max("time").over(Window.partitionBy(*keys)))
        rows = rows.withColumn("__top", top).filter(F.col("time") < F.col("__top")).drop("__top")
    left = F.floor(F.col("time") / step) * step
    return rows.groupBy(*keys, left.cast("double").alias("time")).agg(F.median("survival").alias("survival"))


def _by_curve(points: DataFrame, fields: list[str], fold: Callable[[pa.Table], pa.Table], keys: list[str]) -> DataFrame:
    """``fold`` over the rows of each curve in order; time and memory grow with a curve's points, not with their square."""
    names = list(dict.fromkeys([*keys, *ORDER, *fields]))
    rows = points.select(*names)
    order = [(c, "ascending") for c in names if c not in keys]

    def run(curve: pa.Table) -> pa.Table:
        return fold(curve.take(pc.sort_indices(curve, sort_keys=order, null_placement="at_start"))).select(names)

    return rows.groupBy(*keys).applyInArrow(run, rows.schema)


def _values(curve: pa.Table, name: str) -> list[float]:
    """A column as numbers; a null is a NaN."""
    return curve.column(name).cast(pa.float64()).to_numpy().tolist()


def keep_significant(points: DataFrame, threshold: float = 0.005, keys: list[str] = KEYS) -> DataFrame:
    """Points whose survival differs from the last kept one by more than ``threshold``; the first point stays."""

    def fold(curve: pa.Table) -> pa.Table:
        kept, last = [], 0.0
        for i, s in enumerate(_values(curve, "survival")):
            if not kept or abs(s - last) > threshold:
                kept.append(i)
                last = s
        return curve.take(kept)

    return _by_curve(points, ["survival"], fold, keys)


def detect_level_changes(points: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Changes of survival rounded to 5 places, by more than 1e-4 from the last kept level."""
    return keep_significant(points.withColumn("survival", F.round("survival", 5)), 1e-4, keys)


def dedupe_consecutive(points: DataFrame, tolerance: float = 0.01, keys: list[str] = KEYS) -> DataFrame:
    """Drops a point that lies within ``tolerance`` of the last kept one in both directions."""

    def fold(curve: pa.Table) -> pa.Table:
        kept, at = [], (0.0, 0.0)
        for i, p in enumerate(zip(_values(curve, "time"), _values(curve, "survival"))):
            if not kept or abs(p[0] - at[0]) >= tolerance or abs(p[1] - at[1]) >= tolerance:
                kept.append(i)
                at = p
        return curve.take(kept)

    return _by_curve(points, ["survival"], fold, keys)


def step_regularize(points: DataFrame, tolerance: float, keys: list[str] = KEYS) -> DataFrame:
    """Turns near-horizontal and near-vertical moves into exact ones.

    From the last kept point, in the order of ``seq``: a point that moved less
    than ``tolerance`` in both directions is dropped, else the smaller of its two
    moves is undone. Curves pass in one stream, so a curve of few points costs
    no call of its own and a long one is never held whole.
    """

    names, at = [*keys, *ORDER, "survival"], Window.partitionBy(*keys).orderBy("seq", "time", "survival")
    curves = points.select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # curves follow each other in order of their points; all that is carried on is the last kept point
        px = py = 0.0
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            kept, times, levels = [], [], []
            for i, (new, x, y) in enumerate(zip(rows.column("__new").to_pylist(), _values(rows, "time"), _values(rows, "survival"))):
                if not new:
                    dx, dy = abs(x - px), abs(y - py)
                    if dx < tolerance and dy < tolerance:
                        continue
                    x, y = (px, y) if dx < dy else (x, py)
                px, py = x, y
                kept.append(i)
                times.append(x)
                levels.append(y)
            out = rows.select(names).take(kept)
            for name, values in (("time", times), ("survival", levels)):
                out = out.set_column(out.schema.get_field_index(name), out.schema.field(name), pa.array(values, pa.float64()).cast(out.schema.field(name).type))
            yield from out.to_batches()

    return curves.withColumn("__new", F.row_number().over(at) == 1).mapInArrow(run, curves.schema)


def detect_steps(points: DataFrame, least_change: float = 0.01, keys: list[str] = KEYS) -> DataFrame:
    """Adds ``is_step``: a fall steeper than the curve's 75 % quantile of slopes, or any change above ``least_change``.

    The flag stands on the point before the change; curves of fewer than 5
    points have none.
    """
    w, whole = _w(keys), Window.partitionBy(*keys)
    change = F.lead("survival").over(w) - F.col("survival")
    gap = F.lead("time").over(w) - F.col("time")
    slopes = points.withColumn("__ds", change).withColumn("__slope", change / F.when(gap == 0, F.lit(1e-10)).otherwise(gap)).withColumn("__n", F.count("*").over(whole))
    limit = slopes.groupBy(*keys).agg(F.percentile(F.abs("__slope"), F.lit(0.75)).alias("__p75"))
    flag = (F.col("__n") >= 5) & F.col("__ds").isNotNull() & ((F.col("__slope") < -F.col("__p75")) | (F.abs("__ds") > least_change))
    return slopes.join(limit, keys).withColumn("is_step", F.coalesce(flag, F.lit(False))).drop("__ds", "__slope", "__n", "__p75")


def segment_plateaus(points: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """``keys, segment, t_start, t_end, level``: runs between steps, at their median; runs of one point are dropped."""
    w = _w(keys)
    flagged = detect_steps(points, keys=keys)
    before = F.coalesce(F.lag(F.col("is_step").cast("int")).over(w), F.lit(0))
    runs = flagged.withColumn("__before", before).withColumn("segment", F.sum("__before").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        runs.groupBy(*keys, "segment")
        .agg(F.min("time").alias("t_start"), F.max("time").alias("t_end"), F.median("survival").alias("level"), F.count("*").alias("n"))
        .filter("n >= 2")
        .drop("n")
    )


def reconstruct_steps(points: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Step function from plateaus: start of each, next level at its end, last point; falling, in [0, 1]."""
    w = Window.partitionBy(*keys).orderBy("segment")
    seg = segment_plateaus(points, keys).withColumn("next", F.lead("level").over(w))
    corner = lambda t, s, k: F.struct(F.col(t).alias("time"), F.col(s).alias("survival"), F.lit(k).alias("k"))
    corners = F.when(F.col("next").isNull(), F.array(corner("t_start", "level", 0), corner("t_end", "level", 1))).otherwise(
        F.array(corner("t_start", "level", 0), corner("t_end", "next", 1))
    )
    rows = seg.select(*keys, "segment", F.inline(corners)).withColumn("seq", (F.col("segment") * 2 + F.col("k")).cast("int"))
    flat = monotone_envelope(rows.select(*keys, "seq", "time", "survival"), keys)
    clipped = flat.withColumn("survival", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("survival"))))
    return keep_significant(clipped, 0.005, keys)


def enforce_km(points: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Falling, within [0, 1], without rows in which neither time nor survival changes by over 1e-6."""
    w = _w(keys)
    clean = monotone_envelope(points, keys).withColumn("survival", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("survival"))))
    dt, ds = F.col("time") - F.lag("time").over(w), F.lag("survival").over(w) - F.col("survival")
    return clean.withColumn("__keep", F.coalesce((dt > 1e-6) | (ds > 1e-6), F.lit(True))).filter("__keep").drop("__keep")


def step_function(points: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Steps detected, plateaus cut, function rebuilt and constrained."""
    return enforce_km(reconstruct_steps(points, keys), keys)


def classify_segments(points: DataFrame, least_drop: float = 0.001, nearest: float = 0.5, keys: list[str] = KEYS) -> DataFrame:
    """The first point and each vertical drop: a fall above ``least_drop`` within ``nearest`` time units."""
    w = _w(keys)
    drop = F.lag("survival").over(w) - F.col("survival")
    gap = F.abs(F.col("time") - F.lag("time").over(w))
    return points.withColumn("__keep", drop.isNull() | ((drop > least_drop) & (gap < nearest))).filter("__keep").drop("__keep")


def moving_average(points: DataFrame, window: int = 5, keys: list[str] = KEYS) -> DataFrame:
    """Centred mean, cut at the ends; curves shorter than the window stay."""
    half = window // 2
    mean = F.avg("survival").over(_w(keys).rowsBetween(-half, half))
    return points.withColumn("survival", F.when(F.count("*").over(Window.partitionBy(*keys)) < window, F.col("survival")).otherwise(mean))


def decimate(points: DataFrame, target: int, preserve_steps: bool = True, keys: list[str] = KEYS) -> DataFrame:
    """Every (n div target)-th point, the ends, and, if asked, points after a jump above 0.05."""
    w, whole = _w(keys), Window.partitionBy(*keys)
    n = F.count("*").over(whole)
    i = F.row_number().over(w) - 1
    jump = F.coalesce(F.abs(F.col("survival") - F.lag("survival").over(w)) > 0.05, F.lit(False)) if preserve_steps else F.lit(False)
    every = F.greatest(F.floor(F.col("__n") / target), F.lit(1))
    rows = points.withColumn("__n", n).withColumn("__i", i).withColumn("__jump", jump)
    keep = (F.col("__n") <= target) | (F.col("__i") % every == 0) | (F.col("__i") == F.col("__n") - 1) | F.col("__jump")
    return rows.filter(keep).drop("__n", "__i", "__jump")


def sample_step(points: DataFrame, grid: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Survival on a time grid by linear interpolation, constant beyond the ends.

    ``grid`` has ``keys`` and ``grid_time``. Equal times count with their last
    point. Neighbours on both sides come from two windows over the union of
    points and grid, so no pair of point and grid time is formed.
    """
    last = points.groupBy(*keys, "time").agg(F.max_by("survival", "seq").alias("survival"))
    both = last.select(*keys, F.col("time").alias("t"), "survival", F.lit(0).alias("g")).unionByName(
        grid.select(*keys, F.col("grid_time").alias("t"), F.lit(None).cast("double").alias("survival"), F.lit(1).alias("g"))
    )
    before = Window.partitionBy(*keys).orderBy("t", "g").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys).orderBy(F.desc("t"), "g").rowsBetween(Window.unboundedPreceding, 0)
    point = F.when(F.col("survival").isNotNull(), F.struct("t", "survival"))
    near = both.withColumn("a", F.last(point, ignorenulls=True).over(before)).withColumn("b", F.last(point, ignorenulls=True).over(after)).filter("g = 1")
    slope = (F.col("b.survival") - F.col("a.survival")) / (F.col("b.t") - F.col("a.t"))
    value = (
        F.when(F.col("a").isNull(), F.col("b.survival"))
        .when(F.col("b").isNull() | (F.col("a.t") == F.col("b.t")), F.col("a.survival"))
        .otherwise(F.col("a.survival") + slope * (F.col("t") - F.col("a.t")))
    )
    return near.select(*keys, F.col("t").alias("grid_time"), value.alias("survival"))


def grid_for(points: DataFrame, step: float, upto: float, keys: list[str] = KEYS) -> DataFrame:
    """A regular grid from 0 for every curve."""
    n = int(round(upto / step))
    return points.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(n))).alias("__i")).select(*keys, (F.col("__i") * F.lit(float(step))).alias("grid_time"))


def falling_fit(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted decreasing isotonic regression by pooling adjacent violators."""
    level, weight, size = [], [], []
    for a, b in zip(y, w):
        level.append(float(a))
        weight.append(float(b))
        size.append(1)
        while len(level) > 1 and level[-2] < level[-1]:
            total = weight[-2] + weight[-1]
            level[-2] = (level[-2] * weight[-2] + level[-1] * weight[-1]) / total
            weight[-2] = total
            size[-2] += size[-1]
            del level[-1], weight[-1], size[-1]
    return np.repeat(level, size)


def isotonic_clean(points: DataFrame, subsample: int = 3, min_step: float = 0.005, keys: list[str] = KEYS) -> DataFrame:
    """Every ``subsample``-th point, decreasing isotonic fit, clip to [0, 1], then significant moves only.

    Points of one time are averaged first with their number as weight. Curves
    of fewer than 3 points stay as they are. One curve is one group; a curve
    has at most some thousands of points after binning.
    """
    n = F.count("*").over(Window.partitionBy(*keys))
    i = F.row_number().over(_w(keys)) - 1
    rows = points.withColumn("__n", n).withColumn("__i", i).filter((F.col("__n") <= subsample) | (F.col("__i") % subsample == 0))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema if f.name in keys) + ", seq int, time double, survival double"

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["time", "seq"])
        if len(pdf) < 3:
            return pdf[[*keys, "seq", "time", "survival"]]
        g = pdf.groupby("time", sort=True).agg(seq=("seq", "min"), survival=("survival", "mean"), w=("survival", "size")).reset_index()
        g["survival"] = np.clip(falling_fit(g["survival"].to_numpy(), g["w"].to_numpy()), 0.0, 1.0)
        for k, v in zip(keys, key):
            g[k] = v
        return g[[*keys, "seq", "time", "survival"]]

    fitted = rows.groupBy(*keys).applyInPandas(fit, schema)
    return keep_significant(fitted, min_step, keys)


def isotonic_min_max(points: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The fit alone, one row for each time: min over i <= k of max over j >= k of mean(i..j), found by pooling."""
    mean = points.groupBy(*keys, "time").agg(F.avg("survival").cast("double").alias("survival"), F.count("*").alias("w"))

    def fit(curve: pa.Table) -> pa.Table:
        curve = curve.sort_by("time")
        fitted = falling_fit(curve.column("survival").to_numpy(), curve.column("w").to_numpy())
        return curve.set_column(curve.schema.get_field_index("survival"), "survival", pa.array(fitted, pa.float64())).drop_columns(["w"])

    return mean.groupBy(*keys).applyInArrow(fit, mean.drop("w").schema)


def parametric_fit(points: DataFrame, distribution: str = "weibull", rounds: int = 20, keys: list[str] = KEYS) -> DataFrame:
    """Least-squares Weibull (exp(-(t/lam)^k)) or exponential fit of every curve: ``keys, lam, k, sse``.

    Damped Gauss-Newton for all curves at once; a round is one aggregation of
    normal-equation sums per curve, and its small result is written so that plans
    do not grow. Starts at (median time, 1); lam > 0 and 0.1 <= k <= 10.
    """
    if distribution not in ("weibull", "exponential"):
        raise ValueError(f"unknown distribution {distribution}")
    pts = points.select(*keys, "time", "survival").filter("time > 0")
    fit = pts.groupBy(*keys).agg(F.greatest(F.median("time"), F.lit(1e-6)).alias("lam"), F.lit(1.0).alias("k"))
    free = distribution == "weibull"
    for _ in range(rounds):
        u = F.pow(F.col("time") / F.col("lam"), F.col("k"))
        s = F.exp(-u)
        rows = pts.join(fit, keys).withColumn("r", F.col("survival") - s).withColumn("g1", s * u * F.col("k")).withColumn(
            "g2", -s * u * F.log(F.col("time") / F.col("lam")) if free else F.lit(0.0)
        )
        sums = rows.groupBy(*keys, "lam", "k").agg(
            F.sum(F.col("g1") * F.col("g1")).alias("a"), F.sum(F.col("g1") * F.col("g2")).alias("b"), F.sum(F.col("g2") * F.col("g2")).alias("c"),
            F.sum(F.col("g1") * F.col("r")).alias("p"), F.sum(F.col("g2") * F.col("r")).alias("q"),
        )
        a, c = F.col("a") + 1e-9, F.col("c") + 1e-9
        det = a * c - F.col("b") * F.col("b")
        d1 = (c * F.col("p") - F.col("b") * F.col("q")) / det if free else F.col("p") / a
        d2 = (a * F.col("q") - F.col("b") * F.col("p")) / det if free else F.lit(0.0)
        bounded = lambda x, m: F.greatest(F.lit(-m), F.least(F.lit(m), F.coalesce(x, F.lit(0.0))))
        # the step is taken in log(lam), so lam stays positive
        fit = sums.select(*keys, (F.col("lam") * F.exp(bounded(d1, 0.5))).alias("lam"), F.greatest(F.lit(0.1), F.least(F.lit(10.0), F.col("k") + bounded(d2, 0.5))).alias("k"))
        fit = written(fit)
    u = F.pow(F.col("time") / F.col("lam"), F.col("k"))
    return pts.join(fit, keys).groupBy(*keys, "lam", "k").agg(F.sum(F.pow(F.col("survival") - F.exp(-u), F.lit(2.0))).alias("sse"))


def fitted_curve(points: DataFrame, fit: DataFrame, n: int = 100, keys: list[str] = KEYS) -> DataFrame:
    """``n`` evenly spaced points of exp(-(t/lam)^k) from the first to the last time of each curve."""
    span = points.groupBy(*keys).agg(F.min("time").alias("lo"), F.max("time").alias("hi")).join(fit.select(*keys, "lam", "k"), keys)
    at = span.withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("time", F.col("lo") + F.col("seq") * (F.col("hi") - F.col("lo")) / (n - 1))
    return at.select(*keys, "seq", "time", F.exp(-F.pow(F.col("time") / F.col("lam"), F.col("k"))).alias("survival"))
