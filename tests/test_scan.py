"""Risk sets of one large stratum, spread over tasks, against numpy."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import nma, scan, survival


@pytest.fixture(scope="module")
def cohort(spark):
    """One stratum with a time for each patient, and a small one with ties."""
    rng = np.random.default_rng(5)
    n = 20_000
    big = pd.DataFrame({"g": "big", "arm": rng.choice(["a", "b"], n), "time": rng.permutation(n) / 7.0 + rng.random(n) * 0.01, "event": rng.integers(0, 2, n), "risk": rng.integers(0, 50, n)})
    small = pd.DataFrame({"g": None, "arm": rng.choice(["a", "b"], 60), "time": rng.integers(1, 9, 60) * 1.0, "event": rng.integers(0, 2, 60), "risk": rng.integers(0, 5, 60)})
    rows = pd.concat([big, small]).reset_index(drop=True)
    df = spark.createDataFrame([tuple(None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in r) for r in rows.itertuples(index=False)], "g string, arm string, time double, event int, risk long")
    return rows, df


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Ranges stay as many as the partitions, so that the large stratum fills most of them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def parts(rows):
    return {k: r for k, r in ((None if pd.isna(k) else k, r) for k, r in rows.groupby("g", dropna=False))}


def numpy_km(r):
    t = np.unique(r.time)
    n = np.array([len(r) - np.searchsorted(np.sort(r.time), v) for v in t])
    d = r.groupby("time").event.sum().reindex(t).to_numpy()
    s = np.cumprod(1 - d / n)
    with np.errstate(divide="ignore", invalid="ignore"):
        v = np.cumsum(np.where(d < n, d / (n * (n - d)), 0.0))
    return t, n, d, s, v


def test_life_table_and_km(spark, cohort):
    rows, df = cohort
    ranged = scan.spread(df.groupBy("g", "time").count(), ["g"], "time")
    assert ranged.filter("g = 'big'").select(scan.RANGE).distinct().count() > 1
    got = survival.km_fit(df, ["g"]).toPandas()
    for k, r in parts(rows).items():
        mine = (got[got.g.isna()] if k is None else got[got.g == k]).sort_values("time")
        t, n, d, s, v = numpy_km(r)
        assert np.array_equal(mine.time, t) and np.array_equal(mine.n_risk, n) and np.array_equal(mine.n_event, d)
        assert np.allclose(mine.survival, s, atol=1e-9) and np.allclose(mine.std_err, s * np.sqrt(v), atol=1e-9)


def test_rmst_and_quantiles(cohort):
    rows, df = cohort
    got = {r.g: r for r in survival.rmst(df, ["g"], (0.5, 5.0, 1000.0, 1e6)).collect()}
    levels = {r.g: r.q50 for r in survival.survival_quantiles(df, ["g"]).collect()}
    for k, r in parts(rows).items():
        t, _, _, s, _ = numpy_km(r)
        for tau, name in ((0.5, "rmst_0.5"), (5.0, "rmst_5"), (1000.0, "rmst_1000"), (1e6, "rmst_1e+06")):
            edges = np.concatenate([[0], t[t < tau], [tau]])
            want = (np.concatenate([[1], s[t < tau]]) * np.diff(edges)).sum()
            assert np.isclose(got[k][name], want, rtol=1e-9)
        below = t[s <= 0.5 + 1e-12]
        assert levels[k] == (below[0] if len(below) else None)


def test_left_truncation(cohort):
    rows, df = cohort
    late = df.withColumn("start", F.col("time") / 2).filter("g = 'big'")
    got = survival.life_table(late, ["g"], "start").orderBy("time").toPandas()
    r = rows[rows.g == "big"]
    t = np.sort(r.time)
    want = len(r) - np.searchsorted(t, t) - (len(r) - np.searchsorted(np.sort(r.time / 2), t))
    assert np.array_equal(got.n_risk, want)


def test_logrank_and_risk_sets(cohort):
    rows, df = cohort
    r = rows[rows.g == "big"].sort_values("time")
    n = np.arange(len(r), 0, -1)
    first = (r.arm == "a").to_numpy()
    n1 = first[::-1].cumsum()[::-1]
    d = r.event.to_numpy()
    got = survival.logrank(df.filter("g = 'big'"), ["g"], "arm").first()
    share = n1 / n
    assert got.observed == d[first].sum() and np.isclose(got.expected, (d * share).sum())
    assert np.isclose(got.variance, (d * share * (1 - share) * np.where(n > 1, (n - d) / np.maximum(n - 1, 1), 0)).sum())
    terms = {x.arm: x for x in survival.logrank_terms(df.filter("g = 'big'"), ["g"], "arm").collect()}
    assert np.isclose(terms["a"].expected, got.expected) and terms["b"].observed == d[~first].sum()
    sets = nma.risk_sets(df.filter("g = 'big'"), []).filter("arm = 'a'").orderBy("time").toPandas()
    assert np.array_equal(sets.n, n1[d == 1]) and sets.d.sum() == d[first].sum()


def test_c_index_and_auc(cohort):
    rows, df = cohort
    some = df.filter("g is null or time < 150")
    got = {r.g: r for r in survival.c_index(some, ["g"], "risk").collect()}
    auc = {r.g: r for r in survival.time_auc(some, ["g"], "risk", 4.0).collect()}
    for k, r in parts(rows[(rows.g != "big") | (rows.time < 150)]).items():
        t, e, x = r.time.to_numpy(), r.event.to_numpy(), r.risk.to_numpy()
        pair = (e == 1)[:, None] & (t[:, None] < t[None, :])
        won = np.where(x[:, None] > x[None, :], 1.0, np.where(x[:, None] == x[None, :], 0.5, 0.0))
        assert got[k].pairs == pair.sum() and np.isclose(got[k].c_index, won[pair].mean())
        pair = ((e == 1) & (t <= 4))[:, None] & (t > 4)[None, :]
        assert np.isclose(auc[k].auc, won[pair].mean())


def test_no_window_on_a_whole_stratum(cohort):
    _, df = cohort
    for out in (
        survival.km_fit(df, ["g"]), survival.life_table(df, ["g"], "risk"), survival.rmst(df, ["g"]), survival.logrank(df, ["g"], "arm"), survival.logrank_terms(df, ["g"], "arm"),
        survival.c_index(df, ["g"], "risk"), survival.time_auc(df, ["g"], "risk", 4.0), nma.risk_sets(df, []), nma.risk_sets(df, ["g"]),
    ):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        windows = [x for x in plan.split("\n") if re.search(r"\bWindow \[", x)]
        assert windows and all(scan.RANGE in x for x in windows)


def efron(rows, arms, beta):
    """Score and information of the Cox model, one tied event after another."""
    x = np.array([[a == b for b in arms[1:]] for a in rows.arm], float)
    theta = np.exp(x @ beta)
    like, u, h = 0.0, np.zeros(len(beta)), np.zeros((len(beta),) * 2)
    for t in np.unique(rows.time[rows.event == 1]):
        risk, dead = (rows.time >= t).to_numpy(), ((rows.time == t) & (rows.event == 1)).to_numpy()
        d = dead.sum()
        for k in range(d):
            w = theta * (risk - k / d * dead)
            mean = w @ x / w.sum()
            like -= np.log(w.sum())
            u -= mean
            h += (x * w[:, None]).T @ x / w.sum() - np.outer(mean, mean)
        like += (x[dead] @ beta).sum()
        u += x[dead].sum(axis=0)
    return like, u, h


@pytest.mark.parametrize("ties", [1, 3, 40])
def test_cox_ties_in_closed_form(spark, ties):
    rng = np.random.default_rng(ties)
    n = 150
    rows = pd.DataFrame({"arm": rng.choice(["a", "b", "c"], n), "event": rng.integers(0, 2, n)})
    rows["time"] = np.ceil(rng.exponential(10, n) * (1 + (rows.arm == "b")) * 100 / ties) * ties
    df = spark.createDataFrame([("s", r.arm, float(r.time), int(r.event)) for r in rows.itertuples()], "study_id string, arm string, time double, event int")
    beta = np.zeros(2)
    for _ in range(30):
        _, u, h = efron(rows, ["a", "b", "c"], beta)
        beta = beta + np.linalg.solve(h, u)
    hr = {r.treatment: r.hr for r in nma.cox_hr(df).collect()}
    assert np.allclose([hr["b"], hr["c"]], np.exp(beta), rtol=1e-8)


def test_tie_sums(spark):
    cases = [(1.0, 1), (1.0, 2), (1.5, 12), (1.0, 13), (3.25, 40), (1e9, 1), (1e9, 20), (1e6, 1_000_000), (1.0, 1_000_000), (7.0, 200_000)]
    df = spark.createDataFrame([(y, float(d)) for y, d in cases], "y double, d double")
    got = df.select("y", "d", nma.tie_sums(F.col("y"), F.col("d")).alias("s")).select("y", "d", "s.*").collect()
    for r in got:
        v = np.longdouble(r.y) + np.arange(int(r.d))
        want = [(1 / v).sum(), (1 / v**2).sum(), np.log(v).sum()]
        assert np.allclose(np.array([r.h1, r.h2, r.logs]), np.array(want, float), rtol=1e-12, atol=0), (r, want)


def test_chain_of_treatments(spark):
    names = [f"t{i:03d}" for i in range(100)]
    edges = spark.createDataFrame([*zip(names, names[1:]), ("x1", "x2")], "t1 string, t2 string")
    vertices = spark.createDataFrame([(v,) for v in [*names, "x1", "x2", "z"]], "treatment string")
    got = {r.treatment: r.component for r in nma.network_components(edges, vertices).collect()}
    assert set(got.values()) == {"t000", "x1", "z"} and all(got[v] == "t000" for v in names)


def test_arms_are_checked(spark, monkeypatch):
    monkeypatch.setattr(nma, "MOST_ARMS", 2)
    df = spark.createDataFrame([("s", a, 1.0, 1) for a in "abc"], "study_id string, arm string, time double, event int")
    with pytest.raises(ValueError):
        nma.cox_hr(df)
