"""Network meta-analysis: treatment graph, pooled Cox model, ranking, league table."""

from __future__ import annotations

from collections.abc import Callable
from math import erfc, exp, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.scan import running, spread
from tidemark.operators.shared import written

Z95 = 1.96
#: Treatments that one model may hold.
MOST_ARMS = 60


def treatment_edges(ipd: DataFrame) -> DataFrame:
    """``t1 < t2`` and the number of studies that compare them."""
    arms = ipd.select("study_id", "arm").distinct()
    pairs = arms.join(arms.withColumnRenamed("arm", "other"), "study_id").filter("arm < other")
    return pairs.groupBy(F.col("arm").alias("t1"), F.col("other").alias("t2")).agg(F.count("*").alias("weight"))


def network_components(edges: DataFrame, vertices: DataFrame, rounds: int = 60) -> DataFrame:
    """``treatment, component``: the least treatment reachable; one component means the network is connected.

    A round takes the least label of a treatment and its neighbours, then the
    label of that label, so a chain of n treatments settles in about log n rounds.
    """
    both = edges.select("t1", "t2").union(edges.select("t2", "t1")).toDF("a", "b")
    labels = vertices.select("treatment", F.col("treatment").alias("component"))
    for _ in range(rounds):
        near = both.join(labels, both.b == labels.treatment).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels.treatment == near.a, "left").select("treatment", "component", F.least("component", F.coalesce("near", "component")).alias("next"))
        step = written(step)
        jump = step.select(F.col("treatment").alias("at"), F.col("next").alias("to"))
        after = written(step.join(jump, step.next == jump.at, "left").select("treatment", "component", F.coalesce("to", "next").alias("next")))
        moved = after.filter("next <> component").limit(1).count()
        labels = after.select("treatment", F.col("next").alias("component"))
        if not moved:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def known_arms(ipd: DataFrame) -> list[str]:
    """The treatments by name; at most ``MOST_ARMS``, as the model has (arms - 1)^2 / 2 sums."""
    arms = sorted((r[0] for r in ipd.select("arm").distinct().limit(MOST_ARMS + 1).collect()), key=lambda a: (a is None, a))
    if len(arms) > MOST_ARMS:
        raise ValueError(f"more than {MOST_ARMS} treatments")
    return arms


def cells_of(ipd: DataFrame, strata: list[str]) -> DataFrame:
    """``strata, arm, time, d, m``: events and patients that leave, all that an analysis asks of the records."""
    return ipd.groupBy(*strata, "arm", "time").agg(F.sum("event").alias("d"), F.count("*").alias("m"))


def risk_sets(ipd: DataFrame, strata: list[str]) -> DataFrame:
    """``strata, time, arm, d, n``: events and numbers at risk of every arm at every event time.

    A partial aggregation leaves one row per distinct (stratum, arm, time);
    numbers at risk are running sums in two levels over these. Without strata
    every arm meets every event time, for at most ``MOST_ARMS`` arms.
    """
    return risk_sets_of_cells(cells_of(ipd, strata), strata)


def risk_sets_of_cells(rows: DataFrame, strata: list[str]) -> DataFrame:
    """``risk_sets`` of records added up, one row or more for a (stratum, arm, time)."""
    cells = written(rows.groupBy(*strata, "arm", "time").agg(F.sum("d").alias("d"), F.sum("m").alias("m")))
    times = cells.groupBy(*strata, "time").agg(F.sum("d").alias("__d")).filter("__d > 0").select(*strata, "time")
    exits = cells.select(*strata, "arm", "time", "d", "m", F.lit(False).alias("__g"))
    if strata:
        grid = cells.select(*strata, "arm").distinct().join(times, strata)
    else:
        grid = times.withColumn("arm", F.explode(F.array(*[F.lit(a).cast("string") for a in known_arms(cells)])))
    grid = grid.select(*strata, "arm", "time", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("m"), F.lit(True).alias("__g"))
    every = exits.unionByName(grid).groupBy(*strata, "arm", "time").agg(F.sum("d").alias("d"), F.sum("m").alias("m"), F.bool_or("__g").alias("__g"))
    parts = [*strata, "arm"]
    at = running(spread(every, parts, "time"), parts, "time", {"n": F.col("m")}, descending=True)
    return at.filter("__g").select(*strata, "time", "arm", "d", "n")


#: Terms of a tie that are added one by one, before the series starts.
_SINGLE = 12


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)``, with the value computed once however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def tie_sums(y: Column, d: Column) -> Column:
    """Sums over ``y, y + 1, ..., y + d - 1`` of the reciprocal, its square and the logarithm, as ``h1, h2, logs``; ``y`` is at least 1.

    They are differences of digamma, trigamma and log-gamma. The first terms are
    added singly; from there the functions' asymptotic series are subtracted term
    by term, in forms that lose no digits where ``d`` is small beside ``y``.
    """
    zero = F.lit(0.0)

    def places(v: Column) -> Column:
        m = F.greatest(v["d"] - float(_SINGLE), zero)
        a = v["y"] + float(_SINGLE)
        return F.struct(v["y"].alias("y"), v["d"].alias("d"), m.alias("m"), a.alias("a"), F.log1p(m / a).alias("step"), (1 / a).alias("u"), (1 / (a + m)).alias("w"), (m / (a * (a + m))).alias("gap"))

    def powers(v: Column) -> Column:
        """What 1 / a^k and 1 / b^k differ by, for k from 1: the gap times the sum of u^i w^(k - 1 - i)."""
        falls = F.aggregate(
            F.sequence(F.lit(2), F.lit(9)),
            F.struct(F.array(v["gap"]).alias("all"), F.lit(1.0).alias("s"), F.lit(1.0).alias("up")),
            lambda r, k: bound(r["up"] * v["u"], lambda up: bound(r["s"] * v["w"] + up, lambda s: F.struct(F.array_append(r["all"], v["gap"] * s).alias("all"), s.alias("s"), up.alias("up")))),
            lambda r: r["all"],
        )
        return F.struct(v.alias("v"), falls.alias("f"))

    def sums(p: Column) -> Column:
        v = p["v"]
        fall = lambda k: F.get(p["f"], F.lit(k - 1))
        single = lambda f: sum((F.when(v["d"] > j, f(v["y"] + float(j))).otherwise(zero) for j in range(_SINGLE)), zero)
        # the Bernoulli numbers' coefficients
        one = v["step"] + fall(1) / 2 + fall(2) / 12 - fall(4) / 120 + fall(6) / 252 - fall(8) / 240
        two = fall(1) + fall(2) / 2 + fall(3) / 6 - fall(5) / 30 + fall(7) / 42 - fall(9) / 30
        logs = (v["a"] - 0.5) * v["step"] + v["m"] * F.log(v["a"] + v["m"]) - v["m"] - fall(1) / 12 + fall(3) / 360 - fall(5) / 1260 + fall(7) / 1680
        return F.struct((single(lambda x: 1 / x) + one).alias("h1"), (single(lambda x: 1 / (x * x)) + two).alias("h2"), (single(F.log) + logs).alias("logs"))

    return bound(bound(bound(F.struct(y.cast("double").alias("y"), d.cast("double").alias("d")), places), powers), sums)


def cox_hr(ipd: DataFrame, reference: str | None = None, stratify: bool = False, rounds: int = 25) -> DataFrame:
    """Hazard ratios of all treatments against the reference (the first by name), Efron ties, pooled or stratified by study.

    Risk sets are written once. A Newton step is one aggregation over them: the
    score and information sums of an event time need only the arms' d and n, so
    a step brings (p - 1) + (p - 1)^2 sums to the driver. The sums over the k-th of
    d tied events are taken in closed form, so a step reads one row for each
    distinct risk set however many events tie there. Steps are halved while the
    likelihood falls. A separated arm has null limits and a warning.
    """
    return cox_of_cells(written(cells_of(ipd, ["study_id"] if stratify else [])), reference, stratify, rounds)


def cox_of_cells(cells: DataFrame, reference: str | None = None, stratify: bool = False, rounds: int = 25) -> DataFrame:
    """``cox_hr`` of what ``cells_of`` gives; it reads ``cells`` three times."""
    spark = cells.sparkSession
    strata = ["study_id"] if stratify else []
    arms = known_arms(cells.filter("arm is not null"))
    ref = reference or (arms[0] if arms else None)
    free = [a for a in arms if a != ref]
    sets = written(
        risk_sets_of_cells(cells, strata).groupBy(*strata, "time").agg(F.map_from_entries(F.collect_list(F.struct("arm", F.struct(F.col("d").cast("double").alias("d"), F.col("n").cast("double").alias("n"))))).alias("at"))
    )
    pair = lambda a, f: F.coalesce(F.try_element_at("at", F.lit(a))[f], F.lit(0.0))
    wide = written(sets.select(*[pair(a, f).alias(f"{f}{i}") for i, a in enumerate([ref, *free]) for f in ("d", "n")]).groupBy(*[f"{f}{i}" for i in range(len(arms)) for f in ("d", "n")]).agg(F.count("*").alias("times"))) if arms else None
    p = len(free)
    beta = np.zeros(p)

    def sums(b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        theta = [1.0, *np.exp(b).tolist()]
        d = sum((F.col(f"d{i}") for i in range(p + 1)), F.lit(0.0))
        n = [F.col(f"n{i}") * theta[i] for i in range(p + 1)]
        e = [F.col(f"d{i}") * theta[i] for i in range(p + 1)]
        q = wide.withColumns({"died": d, "at_risk": sum(n[1:], n[0]), "dying": sum(e[1:], e[0])})
        q = q.withColumns({"tie": tie_sums(F.col("at_risk") * F.col("died") / F.col("dying") - F.col("died") + 1, F.col("died")), "w": F.col("died") / F.col("dying"), **{f"c{i}": n[i + 1] - e[i + 1] * F.col("at_risk") / F.col("dying") for i in range(p)}})
        dd, t, w, h1, h2 = F.col("died"), F.col("times"), F.col("w"), F.col("tie.h1"), F.col("tie.h2")
        c, g = [F.col(f"c{i}") for i in range(p)], e[1:]
        q = q.withColumns({f"m{i}": w * (c[i] * h1 + g[i]) for i in range(p)})
        both = lambda i, j: w * w * (c[i] * c[j] * h2 + (c[i] * g[j] + c[j] * g[i]) / dd * h1 + g[i] * g[j] / dd)
        like = F.sum(t * (sum((F.col(f"d{i + 1}") * float(b[i]) for i in range(p)), F.lit(0.0)) - dd * F.log(F.col("dying") / dd) - F.col("tie.logs")))
        score = [F.sum(t * (F.col(f"d{i + 1}") - F.col(f"m{i}"))).alias(f"u{i}") for i in range(p)]
        info = [F.sum(t * ((F.col(f"m{i}") if i == j else F.lit(0.0)) - both(i, j))).alias(f"h{i}_{j}") for i in range(p) for j in range(i, p)]
        r = q.agg(like.alias("l"), *score, *info).first()
        h = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                h[i, j] = h[j, i] = r[f"h{i}_{j}"] or 0.0
        return r["l"] or 0.0, np.array([r[f"u{i}"] or 0.0 for i in range(p)]), h

    rows = []
    if p:
        like, score, info = sums(beta)
        for _ in range(rounds):
            if np.abs(score).max() < 1e-8:
                break
            step = np.linalg.lstsq(info, score, rcond=None)[0]
            for _ in range(10):
                new = sums(np.clip(beta + step, -20, 20))
                if new[0] >= like - 1e-10:
                    break
                step = step / 2
            beta = np.clip(beta + step, -20, 20)
            like, score, info = new
        cov = np.linalg.pinv(info)
        for i, a in enumerate(free):
            se = sqrt(max(cov[i, i], 0.0))
            apart = abs(beta[i]) >= 15 or se > 50
            hr = None if apart else exp(beta[i])
            rows.append((a, hr, None if apart else exp(beta[i] - Z95 * se), None if apart else exp(beta[i] + Z95 * se), None if apart else erfc(abs(beta[i]) / se / sqrt(2)) if se else None, "separated" if apart else None))
    if ref is not None:
        rows.append((ref, 1.0, 1.0, 1.0, 1.0, None))
    schema = T.StructType([T.StructField("treatment", T.StringType())] + [T.StructField(c, T.DoubleType()) for c in ("hr", "lower", "upper", "p_value")] + [T.StructField("warning", T.StringType())])
    return spark.createDataFrame(sorted(rows), schema)


def rank_treatments(hr: DataFrame) -> DataFrame:
    """Rank by rising hazard ratio, SUCRA = (n - rank) / (n - 1) * 100 and its share."""
    known = hr.filter("hr is not null")
    n = F.count("*").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy("hr", "treatment"))
    sucra = F.when(n > 1, (n - rank) / (n - 1) * 100.0)
    return known.select("treatment", "hr", rank.alias("rank"), sucra.alias("sucra"), (sucra / 100.0).alias("p_score"))


def league_long(hr: DataFrame, as_written: bool = False) -> DataFrame:
    """``row, col, cell``: the ratio of hazards with two decimals, the name on the diagonal.

    The lower triangle is the reciprocal, or with ``as_written`` the upper one again.
    """
    known = hr.filter("hr is not null").select("treatment", "hr").withColumn("i", F.row_number().over(Window.orderBy("treatment")))
    a = known.select(F.col("treatment").alias("row"), F.col("hr").alias("ha"), F.col("i").alias("ia"))
    b = known.select(F.col("treatment").alias("col"), F.col("hr").alias("hb"), F.col("i").alias("ib"))
    ratio = F.when((F.col("ia") > F.col("ib")) & F.lit(as_written), F.col("hb") / F.col("ha")).otherwise(F.col("ha") / F.col("hb"))
    # a table of treatments against themselves: some tens of rows on a side
    pairs = a.join(b, F.col("ia") > 0)
    return pairs.select("row", "col", F.when(F.col("ia") == F.col("ib"), F.col("row")).otherwise(F.format_string("%.2f", ratio)).alias("cell"))


def league_table(hr: DataFrame, as_written: bool = False) -> DataFrame:
    return league_long(hr, as_written).groupBy("row").pivot("col").agg(F.first("cell"))


def run_nma(ipd: DataFrame, stratify: bool = False) -> dict[str, DataFrame]:
    """All tables of an analysis by name. The records are read once: all else comes from their ``cells_of``."""
    cells = written(cells_of(ipd, ["study_id"]))
    arms = cells.select("study_id", "arm").distinct()
    edges = written(treatment_edges(arms))
    vertices = arms.select(F.col("arm").alias("treatment")).distinct()
    hr = cox_of_cells(cells, stratify=stratify)
    return {
        "studies": cells.groupBy("study_id", "arm").agg(F.sum("m").alias("n"), F.sum("d").alias("events")), "edges": edges, "components": network_components(edges, vertices), "hazard_ratios": hr,
        "ranking": rank_treatments(hr), "league": league_table(hr),
    }
