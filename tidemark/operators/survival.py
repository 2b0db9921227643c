"""Time-to-event statistics over patient records.

All operators compress to one row per (stratum, distinct time) by a partial
aggregation first. Where times are continuous these rows are as many as the
patients, so risk sets are running sums in two levels (``scan``): one stratum is
spread over many tasks. ``strata`` is a list of columns; ``time`` and ``event``
(0 or 1) are columns of the records.
"""

from __future__ import annotations

from math import erfc, exp, lgamma, log, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scan import RANGE, running, same, spread
from tidemark.operators.shared import written

Z95 = 1.959963984540054


def life_table(ipd: DataFrame, strata: list[str], start: str | None = None) -> DataFrame:
    """``strata, time, n_risk, n_event, n_censor``; with ``start`` a subject is at risk in (start, time]."""
    return _life_table(ipd, strata, start).drop(RANGE)


def _life_table(ipd: DataFrame, strata: list[str], start: str | None) -> DataFrame:
    """The life table, in ranges of (strata, time)."""
    at = ipd.groupBy(*strata, "time").agg(F.sum("event").alias("n_event"), F.sum(1 - F.col("event")).alias("n_censor"))
    leave = F.col("n_event") + F.col("n_censor")
    if start is None:
        return running(spread(at, strata, "time"), strata, "time", {"n_risk": leave}, descending=True)
    zero = F.lit(0).cast("long")
    entries = ipd.groupBy(*strata, F.col(start).alias("time")).agg(F.count("*").alias("n_enter"))
    both = at.withColumn("n_enter", zero).unionByName(entries.select(*strata, "time", zero.alias("n_event"), zero.alias("n_censor"), "n_enter"))
    at = both.groupBy(*strata, "time").agg(*[F.sum(c).alias(c) for c in ("n_event", "n_censor", "n_enter")])
    at = running(spread(at, strata, "time"), strata, "time", {"n_risk": leave - F.col("n_enter")}, descending=True)
    return at.filter("n_event + n_censor > 0").drop("n_enter")


def _product(ipd: DataFrame, strata: list[str], start: str | None = None) -> DataFrame:
    """The life table with the product-limit estimate: ``log_s`` and ``var`` so far, ``survival`` at and ``before`` each time."""
    n, d = F.col("n_risk"), F.col("n_event")
    table = _life_table(ipd, strata, start).withColumn("hazard", F.when(d < n, F.log1p(-d / n)).otherwise(F.lit(0.0))).withColumn("last", (d >= n).cast("int"))
    green = F.when(d < n, d / (n * (n - d))).otherwise(F.lit(0.0))
    out = running(table, strata, "time", {"log_s": F.col("hazard"), "var": green, "ended": F.col("last")})
    zero = F.lit(0.0)
    return (
        out.withColumn("survival", F.when(F.col("ended") > 0, zero).otherwise(F.exp("log_s")))
        .withColumn("before", F.when(F.col("ended") > F.col("last"), zero).otherwise(F.exp(F.col("log_s") - F.col("hazard"))))
        .drop("hazard", "last", "ended", RANGE)
    )


def km_fit(ipd: DataFrame, strata: list[str], start: str | None = None) -> DataFrame:
    """Kaplan-Meier estimate with Greenwood's standard error and log confidence limits."""
    return (
        _product(ipd, strata, start)
        .withColumn("std_err", F.col("survival") * F.sqrt("var"))
        .withColumn("lower", F.when(F.col("survival") > 0, F.exp(F.col("log_s") - Z95 * F.sqrt("var"))))
        .withColumn("upper", F.when(F.col("survival") > 0, F.least(F.lit(1.0), F.exp(F.col("log_s") + Z95 * F.sqrt("var")))))
        .drop("log_s", "var", "before")
    )


def at_risk_table(ipd: DataFrame, strata: list[str], grid: list[float]) -> DataFrame:
    """Subjects with ``time`` at or after each grid time, for every stratum."""
    times = F.array(*[F.lit(float(g)) for g in grid])
    reached = ipd.groupBy(*strata, "time").agg(F.count("*").alias("n"))
    wide = reached.groupBy(*strata).agg(*[F.sum(F.when(F.col("time") >= g, F.col("n")).otherwise(F.lit(0))).alias(f"g{i}") for i, g in enumerate(grid)])
    return wide.select(*strata, F.posexplode(times).alias("i", "grid_time"), F.array(*[f"g{i}" for i in range(len(grid))]).alias("counts")).select(
        *strata, "grid_time", F.get("counts", F.col("i")).alias("n_risk")
    )


def survival_quantiles(ipd: DataFrame, strata: list[str], levels: tuple[float, ...] = (0.75, 0.5, 0.25)) -> DataFrame:
    """First time at which survival is at or below each level; null if it never is."""
    km = km_fit(ipd, strata)
    name = lambda q: f"q{round((1 - q) * 100)}"
    return km.groupBy(*strata).agg(*[F.min(F.when(F.col("survival") <= q + 1e-12, F.col("time"))).alias(name(q)) for q in levels])


def rmst(ipd: DataFrame, strata: list[str], taus: tuple[float, ...] = (12.0, 24.0, 36.0)) -> DataFrame:
    """Area under the survival curve up to each tau."""
    km = _product(ipd, strata)

    def area(tau: float) -> Column:
        # by parts: each drop of the curve counts up to its time, what is left up to tau
        drops = F.sum(F.when(F.col("time") < tau, (F.col("before") - F.col("survival")) * F.col("time")).otherwise(F.lit(0.0)))
        return drops + F.coalesce(F.min(F.when(F.col("time") < tau, F.col("survival"))), F.lit(1.0)) * tau

    return km.groupBy(*strata).agg(*[area(t).alias(f"rmst_{t:g}") for t in taus])


def logrank(ipd: DataFrame, strata: list[str], group: str) -> DataFrame:
    """Two-group log-rank test in each stratum: observed and expected events of the first group, variance, chi-square."""
    groups = ipd.groupBy(*strata).agg(F.min(group).alias("first_group"), F.countDistinct(group).alias("groups"))
    first = F.col(group) == F.col("first_group")
    table = ipd.join(groups.filter("groups = 2"), strata).groupBy(*strata, "time").agg(
        F.sum("event").alias("d"), F.count("*").alias("m"), F.sum(F.when(first, F.col("event")).otherwise(0)).alias("d1"), F.count(F.when(first, 1)).alias("m1")
    )
    at = running(spread(table, strata, "time"), strata, "time", {"n": F.col("m"), "n1": F.col("m1")}, descending=True)
    d, n, n1 = F.col("d"), F.col("n"), F.col("n1")
    var = F.when(n > 1, d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1)).otherwise(F.lit(0.0))
    sums = at.groupBy(*strata).agg(F.sum("d1").alias("observed"), F.sum(d * n1 / n).alias("expected"), F.sum(var).alias("variance"))
    return sums.join(groups.filter("groups = 2"), strata).withColumn(
        "chi2", F.when(F.col("variance") > 0, F.pow(F.col("observed") - F.col("expected"), F.lit(2.0)) / F.col("variance"))
    ).drop("groups")


def _at_risk(grid: DataFrame, keys: list[str]) -> DataFrame:
    """``n`` of the group and ``n_all`` of the stratum at risk at each time of a group's grid."""
    return running(spread(grid, keys, "time"), keys, "time", {"n": F.col("m"), "n_all": F.col("m_all")}, descending=True).drop(RANGE)


def logrank_terms(ipd: DataFrame, strata: list[str], group: str) -> DataFrame:
    """Observed minus expected events of every group, for tests of any number of groups."""
    table = ipd.groupBy(*strata, group, "time").agg(F.sum("event").alias("d"), F.count("*").alias("m"))
    total = table.groupBy(*strata, "time").agg(F.sum("d").alias("d_all"), F.sum("m").alias("m_all"))
    keys = table.select(*strata, group).distinct()
    grid = keys.join(total, strata).join(table, [*strata, group, "time"], "left").fillna(0, ["d", "m"])
    at = _at_risk(grid, [*strata, group])
    return at.groupBy(*strata, group).agg(F.sum("d").alias("observed"), F.sum(F.col("d_all") * F.col("n") / F.col("n_all")).alias("expected"))


def logrank_test(ipd: DataFrame, strata: list[str], group: str) -> DataFrame:
    """``strata, groups, chi2, df, p_value``: the log-rank test of any number of groups in each stratum.

    Rows are the groups of a stratum at its event times, twice for the
    covariance; meant for tens of groups. The matrix of a stratum is solved in one task.
    """
    table = ipd.groupBy(*strata, group, "time").agg(F.sum("event").alias("d"), F.count("*").alias("m"))
    total = table.groupBy(*strata, "time").agg(F.sum("d").alias("d_all"), F.sum("m").alias("m_all"))
    grid = table.select(*strata, group).distinct().join(total, strata).join(table, [*strata, group, "time"], "left").fillna(0, ["d", "m"])
    at = _at_risk(grid, [*strata, group]).filter("d_all > 0")
    other = at.select(*strata, "time", F.col(group).alias("other"), F.col("n").alias("n_other"))
    share = F.col("n") / F.col("n_all")
    same = F.when(F.col(group) == F.col("other"), F.lit(1.0)).otherwise(F.lit(0.0))
    spread = F.when(F.col("n_all") > 1, F.col("d_all") * (F.col("n_all") - F.col("d_all")) / (F.col("n_all") - 1)).otherwise(F.lit(0.0))
    cells = at.join(other, [*strata, "time"]).groupBy(*strata, group, "other").agg(
        F.sum(F.col("d") - F.col("d_all") * share).alias("gap"), F.sum(spread * share * (same - F.col("n_other") / F.col("n_all"))).alias("cov")
    )

    def solve(rows):
        import numpy as np
        import pandas as pd

        square = rows.pivot(index=group, columns="other", values="cov").sort_index().sort_index(axis=1).to_numpy()[:-1, :-1]
        gap = rows.groupby(group)["gap"].first().sort_index().to_numpy()[:-1]
        chi2 = float(gap @ np.linalg.pinv(square) @ gap) if len(gap) else 0.0
        return pd.DataFrame([[*rows[strata].iloc[0], len(gap) + 1, chi2, len(gap), chi2_tail(chi2, len(gap)) if len(gap) else 1.0]], columns=[*strata, "groups", "chi2", "df", "p_value"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ipd.select(*strata).schema)
    return cells.groupBy(*strata).applyInPandas(solve, f"{kinds}, groups int, chi2 double, df int, p_value double")


def chi2_tail(x: float, df: int) -> float:
    """P(chi-square with df degrees > x), for the few rows of a test result."""
    if x <= 0:
        return 1.0
    if df == 1:
        return erfc(sqrt(x / 2))
    if df == 2:
        return exp(-x / 2)
    return chi2_tail(x, df - 2) + exp((df / 2 - 1) * log(x / 2) - x / 2 - lgamma(df / 2))


def c_index(scored: DataFrame, strata: list[str], risk: str) -> DataFrame:
    """Concordance of ``risk`` with time to event: a subject with an event is comparable with every later one of its stratum.

    Times are halved again and again; two times meet exactly once as the earlier
    and the later half of a part. There running sums by risk count the pairs, so
    n cells cost n log n rows and no pair is formed.
    """
    cells = scored.groupBy(*strata, "time", risk).agg(F.sum("event").alias("d"), F.count("*").alias("m"))
    times = running(spread(cells.select(*strata, "time").distinct(), strata, "time"), strata, "time", {"__t": F.lit(1)}, strict=True).drop(RANGE)
    bits = times.groupBy(*strata).agg(F.length(F.bin(F.max("__t"))).alias("__bits"))
    ranked = same(same(cells, times, [*strata, "time"]), bits, strata)
    halves = ranked.withColumn("__level", F.explode(F.sequence(F.lit(0), F.col("__bits") - 1))).withColumn("__half", F.floor(F.col("__t") / F.pow(F.lit(2.0), F.col("__level"))).cast("long"))
    late = F.col("__half") % 2 == 1
    part = [*strata, "__level", "__part"]
    sums = halves.withColumn("__part", F.floor(F.col("__half") / 2)).groupBy(*part, risk).agg(F.sum(F.when(~late, F.col("d")).otherwise(0)).alias("d"), F.sum(F.when(late, F.col("m")).otherwise(0)).alias("m"))
    counted = running(spread(sums, part, risk), part, risk, {"below": F.col("m")}, strict=True).withColumn("won", F.col("d") * (F.col("below") + 0.5 * F.col("m")))
    parts = counted.groupBy(*part).agg((F.sum("d") * F.sum("m")).alias("pairs"), F.sum("won").alias("won"))
    return parts.groupBy(*strata).agg(F.sum("pairs").alias("pairs"), (F.sum("won") / F.nullif(F.sum("pairs"), F.lit(0))).alias("c_index")).filter("pairs > 0")


def time_auc(scored: DataFrame, strata: list[str], risk: str, horizon: float) -> DataFrame:
    """Share of (event by the horizon, event-free at it) pairs that ``risk`` orders rightly."""
    cells = scored.groupBy(*strata, risk).agg(
        F.sum(F.when((F.col("time") <= horizon) & (F.col("event") == 1), 1).otherwise(0)).alias("cases"),
        F.sum(F.when(F.col("time") > horizon, 1).otherwise(0)).alias("controls"),
    )
    ranked = running(spread(cells, strata, risk), strata, risk, {"below": F.col("controls")}, strict=True)
    return (
        ranked.withColumn("won", F.col("cases") * (F.col("below") + 0.5 * F.col("controls")))
        .groupBy(*strata)
        .agg(F.sum("cases").alias("cases"), F.sum("controls").alias("controls"), (F.sum("won") / F.nullif(F.sum("cases") * F.sum("controls"), F.lit(0))).alias("auc"))
    )


def reconstruct_ipd(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Patient records from ``keys, seq, time, survival, n_risk`` at interval starts.

    In each interval the events are the rounded drop n * (1 - S_next / S), and
    what is then missing to the next number at risk was censored:
    n_next = n - events - censored. Patients leave at the end of their interval.
    """
    w = Window.partitionBy(*keys).orderBy("seq")
    s, n = F.col("survival"), F.col("n_risk")
    at = steps.withColumn("s2", F.lead("survival").over(w)).withColumn("n2", F.lead("n_risk").over(w)).withColumn("t2", F.lead("time").over(w))
    events = F.when(F.col("s2").isNull() | (s <= 0), F.lit(0)).otherwise(F.least(n - F.col("n2"), F.greatest(F.lit(0), F.round(n * (1 - F.col("s2") / s))))).cast("int")
    counts = at.withColumn("events", events).withColumn("censored", F.when(F.col("n2").isNull(), n).otherwise(n - F.col("n2") - F.col("events")).cast("int"))
    leave = F.coalesce("t2", "time")
    each = F.concat(F.array_repeat(F.lit(1), F.greatest(F.col("events"), F.lit(0))), F.array_repeat(F.lit(0), F.greatest(F.col("censored"), F.lit(0))))
    return counts.select(*keys, "seq", leave.alias("time"), F.posexplode(each).alias("patient", "event"))


# ------------------------------------------------------------ records from a curve and numbers at risk


def _drops(time, survival, n: int, s: float, start: float, end: float, censored: int):
    """Events at each drop of the curve while ``censored`` patients leave evenly between ``start`` and ``end``.

    The estimate so far, not the curve, is compared with the next drop, so what
    rounding leaves is made up for later.
    """
    import numpy as np

    out = np.zeros(len(time), np.int64)
    span = end - start
    gone = 0
    for k in range(len(time)):
        away = min(censored, int(censored * (time[k] - start) / span + 0.5)) if span > 0 else censored
        at = n - gone - away
        if at <= 0 or s <= 0:
            break
        d = min(at, max(0, int(round(at * (1 - survival[k] / s)))))
        out[k] = d
        gone += d
        s *= 1 - d / at
    return out


def _solve(keys: list[str]):
    """Bisects the number censored in an interval, until its last number at risk (or its number of events) is met."""

    def run(rows):
        import numpy as np
        import pandas as pd

        r = rows.sort_values("time")
        one = r.iloc[0]
        known = r[r["survival"].notna()]
        time, survival = known["time"].to_numpy(), known["survival"].to_numpy()
        n, start, end, s = int(one["n0"]), float(one["t0"]), float(one["t1"]), float(one["s0"])
        after, target = one["n1"], one["target"]
        left = 0 if pd.isna(after) else int(after)

        def over(c: int) -> bool:
            """Whether more should be censored."""
            d = _drops(time, survival, n, s, start, end, c).sum()
            return d > target if pd.isna(after) else n - d - c > left

        lo, hi = 0, max(0, n - left)
        if not (pd.isna(after) and pd.isna(target)):
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (mid + 1, hi) if over(mid) else (lo, mid)
        d = _drops(time, survival, n, s, start, end, lo)
        # rounding may leave some events too many for the next number at risk: the latest go
        spare = int(d.sum()) - (n - left)
        for k in range(len(d) - 1, -1, -1):
            if spare > 0:
                less = min(spare, int(d[k]))
                d[k] -= less
                spare -= less
        c = n - left - int(d.sum())
        inside = min(c, lo) if pd.isna(after) else c
        # who leaves inside is one row here, however many they are
        out = pd.DataFrame(
            {
                "time": np.concatenate([time, [start, end]]), "event": np.concatenate([np.ones(len(time)), [0, 0]]).astype(np.int32),
                "n": np.concatenate([d, [inside, c - inside]]).astype(np.int64), "span": np.concatenate([np.zeros(len(time)), [end - start, 0.0]]),
            }
        )
        for k in keys:
            out[k] = one[k]
        return out[out["n"] > 0][[*keys, "time", "event", "n", "span"]]

    return run


def fit_ipd(points: DataFrame, risk: DataFrame, keys: list[str], totals: DataFrame | None = None) -> DataFrame:
    """Patient records ``keys, time, event`` from a survival curve and reported numbers at risk.

    ``points`` are ``keys, time, survival``; ``risk`` are ``keys, time, n_risk``
    (patients with time at or after it); ``totals`` may give ``keys, events``.
    Between two numbers at risk the number censored is searched until the events
    that the curve then shows leave exactly the next number. After the last one
    it is searched until the events add up to the total, and who is left is
    censored at the curve's end. Points before the first number at risk are not
    used. An interval is solved in one task from the curve's points
    in it; its patients are told apart afterwards, by all tasks.
    """
    w = Window.partitionBy(*keys).orderBy("time")
    steps = risk.withColumn("t1", F.lead("time").over(w)).withColumn("n1", F.lead("n_risk").over(w))
    known = steps.select(*keys, "time", F.lit(0).alias("__o"), F.struct(F.col("time").alias("t0"), F.col("n_risk").cast("double").alias("n0"), "t1", F.col("n1").cast("double").alias("n1")).alias("at"), F.lit(None).cast("double").alias("survival"))
    both = known.unionByName(points.select(*keys, "time", F.lit(1).alias("__o"), F.lit(None).cast(known.schema["at"].dataType).alias("at"), F.col("survival").cast("double").alias("survival")))
    # an interval begins with its number at risk; what drops at that time belongs to it
    upto = Window.partitionBy(*keys).orderBy("time", "__o").rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("at", F.last("at", ignorenulls=True).over(upto)).withColumn("s0", F.coalesce(F.last(F.when(F.col("__o") == 1, F.col("survival")), ignorenulls=True).over(upto), F.lit(1.0)))
    ends = points.groupBy(*keys).agg(F.max("time").alias("__end"))
    rows = placed.filter("at is not null").join(ends, keys, "left").select(
        *keys, "at.t0", "at.n0", F.coalesce("at.t1", F.greatest("at.t0", F.coalesce("__end", "at.t0"))).cast("double").alias("t1"), "at.n1", "s0", F.col("time").cast("double").alias("time"), "survival", "__o"
    )
    first = Window.partitionBy(*keys, "t0").orderBy("time", "__o")
    rows = rows.withColumn("s0", F.first("s0").over(first)).drop("__o")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.select(*keys).schema) + ", time double, event int, n long, span double"
    none = F.lit(None).cast("double")
    inner = written(rows.filter("n1 is not null").withColumn("target", none).groupBy(*keys, "t0").applyInPandas(_solve(keys), kinds))
    last = rows.filter("n1 is null")
    if totals is None:
        last = last.withColumn("target", none)
    else:
        seen = inner.filter("event = 1").groupBy(*keys).agg(F.sum("n").alias("__seen"))
        want = totals.join(seen, keys, "left").select(*keys, (F.col("events") - F.coalesce("__seen", F.lit(0))).cast("double").alias("target"))
        last = last.join(want, keys, "left")
    every = inner.unionByName(last.groupBy(*keys, "t0").applyInPandas(_solve(keys), kinds))
    return _patients(every, keys)


#: Patients that one row is told apart into at a time.
_BLOCK = 10_000


def _patients(counts: DataFrame, keys: list[str]) -> DataFrame:
    """``n`` patients for each row; those of a ``span`` leave evenly over it.

    Rows are cut into blocks that are dealt to all tasks before they become
    patients, so neither a task nor an array holds an interval's patients.
    """
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / _BLOCK).cast("long")))
    blocks = counts.withColumn("__block", first).withColumn("__from", F.col("__block") * _BLOCK).repartition(*keys, "time", "event", "__from")
    each = blocks.withColumn("__i", F.explode(F.sequence(F.col("__from"), F.least(F.col("__from") + _BLOCK, F.col("n")) - 1)))
    time = F.when(F.col("span") != 0, F.col("time") + (F.col("__i") + 0.5) / F.col("n") * F.col("span")).otherwise(F.col("time"))
    return each.select(*keys, time.alias("time"), "event")
