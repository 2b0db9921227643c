"""Simulated cohorts are recovered from their curves and numbers at risk."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import survival


def cohort(seed, n, rate, cens):
    rng = np.random.default_rng(seed)
    t, c = rng.exponential(rate, n), np.minimum(rng.uniform(0, cens, n), 60.0)
    return np.round(np.minimum(t, c), 2), (t <= c).astype(int)


def km(time, event):
    t = np.unique(time[event == 1])
    n = np.array([(time >= v).sum() for v in t])
    d = np.array([((time == v) & (event == 1)).sum() for v in t])
    return t, np.cumprod(1 - d / n)


def at(t, s, grid):
    return np.concatenate([[1.0], s])[np.searchsorted(t, grid, "right")]


def test_cohorts_are_recovered(spark):
    grid = np.arange(0, 55, 6.0)
    truth, points, risk, totals = {}, [], [], []
    for seed, (n, rate, cens) in enumerate([(300, 20, 90), (80, 10, 40), (1000, 60, 70), (40, 5, 300)]):
        time, event = cohort(seed, n, rate, cens)
        truth[seed] = time, event
        t, s = km(time, event)
        points += [(seed, float(a), float(b)) for a, b in zip(t, s)]
        risk += [(seed, float(g), int((time >= g).sum())) for g in grid]
        totals.append((seed, int(event.sum())))
    df = lambda rows, kind: spark.createDataFrame(rows, kind).repartition(3)
    out = survival.fit_ipd(df(points, "k int, time double, survival double"), df(risk, "k int, time double, n_risk long"), ["k"], df(totals, "k int, events long")).toPandas()
    for seed, (time, event) in truth.items():
        mine = out[out.k == seed]
        got_t, got_e = mine.time.to_numpy(), mine.event.to_numpy()
        assert len(mine) == len(time)
        assert [(got_t >= g).sum() for g in grid] == [(time >= g).sum() for g in grid]
        assert abs(got_e.sum() - event.sum()) <= 1
        span = np.linspace(0, grid[-1], 400)
        gap = np.abs(at(*km(got_t, got_e), span) - at(*km(time, event), span))
        # half a patient of those at risk is what rounding can cost
        assert gap.max() < (0.01 if len(time) >= 300 else 0.03), (seed, gap.max())


def test_edges(spark):
    points = spark.createDataFrame([("a", 1.0, 0.5), ("a", 3.0, 0.0), ("b", 2.0, 1.0), (None, 1.0, 0.5)], "k string, time double, survival double")
    risk = spark.createDataFrame([("a", 0.0, 4), ("a", 2.0, 2), ("c", 0.0, 3), ("c", 5.0, 1)], "k string, time double, n_risk long")
    out = survival.fit_ipd(points, risk, ["k"]).orderBy("k", "time", "event").collect()
    a = [(r.time, r.event) for r in out if r.k == "a"]
    assert a == [(1.0, 1), (1.0, 1), (3.0, 1), (3.0, 1)]
    # no curve: all are censored, evenly, and the last at the last number at risk
    c = [(round(r.time, 3), r.event) for r in out if r.k == "c"]
    assert c == [(1.25, 0), (3.75, 0), (5.0, 0)] and len(out) == 7
    assert survival.fit_ipd(points.limit(0), risk.limit(0), ["k"]).count() == 0


@pytest.mark.parametrize("total", [True, False])
def test_numbers_at_risk_bind(spark, total):
    """A number at risk that the curve cannot give is met all the same."""
    points = spark.createDataFrame([(0, 1.0, 0.2), (0, 5.0, 0.1)], "k int, time double, survival double")
    risk = spark.createDataFrame([(0, 0.0, 10), (0, 4.0, 9)], "k int, time double, n_risk long")
    totals = spark.createDataFrame([(0, 3)], "k int, events long") if total else None
    out = survival.fit_ipd(points, risk, ["k"], totals)
    assert out.count() == 10 and out.filter("time >= 4").count() == 9
    assert out.filter("event = 1").count() <= 6 and out.agg(F.max("time")).first()[0] == 5.0


def test_patients_of_an_interval_are_one_row_in_its_task():
    """Two million censored in an interval: the solver hands on counts, not patients."""
    import pandas as pd

    rows = pd.DataFrame({"k": 1, "time": [1.0, 2.0], "survival": [0.9, 0.8], "n0": 4e6, "t0": 0.0, "t1": 10.0, "n1": 1.5e6, "s0": 1.0, "target": np.nan})
    out = survival._solve(["k"])(rows)
    assert len(out) <= 4 and out["n"].sum() == 2_500_000


def test_large_intervals_spread_evenly(spark):
    points = spark.createDataFrame([(0, 50.0, 1.0)], "k int, time double, survival double")
    risk = spark.createDataFrame([(0, 0.0, 70_000), (0, 10.0, 5_000)], "k int, time double, n_risk long")
    out = survival.fit_ipd(points, risk, ["k"])
    got = np.sort(out.filter("time < 10").toPandas().time.to_numpy())
    assert out.count() == 70_000 and len(got) == 65_000
    assert np.allclose(got, (np.arange(65_000) + 0.5) / 65_000 * 10)
