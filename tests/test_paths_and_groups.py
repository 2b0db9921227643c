"""Paths as a relational scan, colour groups from many starts, silhouettes by moments."""

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import cluster, spatial
from tidemark.plans import jobs

ARGS = {"M": 2, "L": 2, "H": 1, "V": 1, "Q": 4, "C": 6, "Z": 0}


def walk(d):
    """A pen that reads one command after another."""
    x = y = sx = sy = 0.0
    out = []
    for part in re.findall(r"[MLHVQCZmlhvqcz][^MLHVQCZmlhvqcz]*", d):
        cmd, nums = part[0], [float(v) for v in re.findall(r"[-+]?(?:[0-9]*\.)?[0-9]+(?:[eE][-+]?[0-9]+)?", part[1:])]
        up, need = cmd.upper(), ARGS[cmd.upper()]
        if up == "Z":
            x, y = sx, sy
            out.append((x, y))
            continue
        for rep in range(len(nums) // need):
            a = nums[rep * need : (rep + 1) * need]
            ox, oy = (x, y) if cmd != up else (0.0, 0.0)
            ex = a[0] + ox if up == "H" else x if up == "V" else a[-2] + ox
            ey = a[0] + oy if up == "V" else y if up == "H" else a[-1] + oy
            if up in "QC":
                n = int(np.ceil(max(3.0, min(30.0, np.hypot(ex - x, ey - y) / 0.25))))
                pts = np.array([[x, y], *[(a[i] + ox, a[i + 1] + oy) for i in range(0, need - 2, 2)], [ex, ey]])
                for t in np.arange(1, n) / (n - 1):
                    p = pts
                    while len(p) > 1:
                        p = p[:-1] * (1 - t) + p[1:] * t
                    out.append(tuple(p[0]))
            else:
                out.append((ex, ey))
            x, y = ex, ey
            if up == "M" and rep == 0:
                sx, sy = x, y
    return out


def random_path(rng):
    parts = []
    for _ in range(rng.integers(1, 40)):
        cmd = rng.choice(list("MLHVQCZmlhvqcz"))
        n = ARGS[cmd.upper()] * int(rng.integers(1, 4)) + int(rng.integers(0, 2))
        parts.append(cmd + " ".join(f"{v:.3f}" for v in rng.normal(0, 9, n)))
    return "".join(parts)


def test_random_paths(spark):
    rng = np.random.default_rng(8)
    paths = [random_path(rng) for _ in range(120)] + ["", "5 5", "M", "l1 1 2 2zm1,1h3Zl4 4", "m1e1-2.5.5.5H7z z M0 0 5 5 6 6 m 1 1 2 2", "L3 3Zv2m-1-1z", "M1 1A 3 3 L 2 2"]
    df = spark.createDataFrame(list(enumerate(paths)), "k int, d string")
    got = {}
    for r in spatial.flatten_path(df, ["k"]).orderBy("k", "idx").collect():
        got.setdefault(r.k, []).append((r.idx, r.px, r.py))
    for k, d in enumerate(paths):
        want = walk(d)
        mine = got.get(k, [])
        assert [p[0] for p in mine] == list(range(len(want))), d
        assert np.allclose([p[1:] for p in mine] or np.empty((0, 2)), want or np.empty((0, 2)), atol=1e-9), d


def test_null_path_and_long_path_in_linear_time(spark):
    assert spatial.flatten_path(spark.createDataFrame([(1, None)], "k int, d string"), ["k"]).count() == 0
    took = []
    for n in (20_000, 20_000, 200_000):
        df = spark.createDataFrame([(1, "M0 0" + "l1 1" * (n - 1) + "V5")], "k int, d string")
        began = time.time()
        r = spatial.flatten_path(df, ["k"]).agg(F.count("*").alias("n"), F.max("px").alias("x"), F.max_by("py", "idx").alias("y")).first()
        took.append(time.time() - began)
        assert (r.n, r.x, r.y) == (n + 1, n - 1, 5.0)
    assert took[2] < 40 * max(took[1], 0.3)


def features(spark, rows):
    return spark.createDataFrame([(int(f), int(i), *map(float, v)) for f, i, v in rows], "figure_id int, id long, f0 double, f1 double, f2 double")


def test_many_starts_are_no_worse_and_mend_a_bad_one(spark):
    # two outliers draw the farthest points away from three tight groups
    rng = np.random.default_rng(4)
    rows = [(0, i, rng.normal(0, 0.05, 3) + [c, 0, 0]) for i, c in enumerate([0, 1, 2] * 60)] + [(0, 500, (1, 2.2, 0)), (0, 501, (1, -2.2, 0))]
    rows += [(1, i, rng.normal(0, 1, 3)) for i in range(150)]
    df = features(spark, rows)
    cost = lambda starts: {r.figure_id: r.inertia for r in cluster.inertia(cluster.kmeans_groups(df, ["figure_id"], 3, 6, starts), ["figure_id"]).collect()}
    one, ten = cost(1), cost(10)
    assert all(ten[f] <= one[f] + 1e-9 for f in one)
    assert ten[0] < 0.7 * one[0]
    again = cost(10)
    assert again == pytest.approx(ten)


def brute(x, label):
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    out = []
    for i, own in enumerate(label):
        same = label == own
        a = d[i][same].sum() / (same.sum() - 1) if same.sum() > 1 else None
        b = min(d[i][label == k].mean() for k in set(label) if k != own)
        out.append(0.0 if a is None else (b - a) / max(a, b))
    return np.mean(out)


def test_silhouette_is_that_of_all_pairs(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (300, 3))
    label = np.array([0, 1, 2, 3] * 75)
    label[:] = np.where(np.arange(300) == 7, 9, label)
    want = brute(x, label)
    df = spark.createDataFrame([(0, int(c), *map(float, v)) for c, v in zip(label, x)] + [(1, 0, 1.0, 1.0, 1.0)] * 3, "figure_id int, cluster int, f0 double, f1 double, f2 double")
    got = {r.figure_id: r.silhouette for r in cluster.silhouette(df, ["figure_id"]).collect()}
    # the cluster of one row is less than 1 % of all: halved
    assert got[0] == pytest.approx(want / 2) and got[1] == -1.0


def test_number_of_groups_by_each_method(spark):
    rng = np.random.default_rng(0)
    rows = [(0, i, rng.normal(c, 0.05, 3)) for i, c in enumerate([0, 1, 2] * 60)] + [(1, i, rng.normal(0, 1, 3)) for i in range(50)]
    df = features(spark, rows)
    for method in ("silhouette", "elbow", "combined"):
        got = {r.figure_id: r.k for r in cluster.auto_k(df, ["figure_id"], 4, 3, method, 3).collect()}
        assert got == {0: 3 if method != "elbow" else got[0], 1: 1} and got[0] in (2, 3)
    with pytest.raises(ValueError):
        cluster.auto_k(df, ["figure_id"], method="other")


def test_curves_of_a_page_with_their_number_found(spark):
    colours = [(220, 20, 20), (20, 160, 20), (30, 30, 220)]
    px = [(0, x, 40 + 60 * c + x // 10 + w, *colours[c]) for c in range(3) for x in range(300) for w in (0, 1)]
    px += [(0, x, 5, 60, 60, 60) for x in range(0)]
    df = spark.createDataFrame(px, "figure_id int, x int, y int, r int, g int, b int")
    got = {r.curve_id: r["count"] for r in jobs.curves_from_pixels(df).groupBy("curve_id").count().collect()}
    assert got == {0: 600, 1: 600, 2: 600}
