"""Nearest neighbours by a count pyramid, on pixels that lie in clusters."""

import numpy as np

from tidemark.operators import cluster


def brute(rows, k):
    out = set()
    for f in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == f]
        x = np.array([r[2:] for r in mine], float)
        ids = np.array([r[1] for r in mine])
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        for i in range(len(mine)):
            order = [j for j in np.lexsort((ids, d[i])) if j != i][:k]
            out |= {(f, ids[i], ids[j], rank) for rank, j in enumerate(order, 1)}
    return out


def test_clusters_and_sparse_pixels(spark):
    rng = np.random.default_rng(3)
    xy = np.concatenate([rng.normal((200, 200), 3, (500, 2)), rng.normal((230, 200), 1, (300, 2)), rng.uniform(0, 6000, (150, 2)), np.tile([[9, 9]], (30, 1))])
    rows = [(0, i, int(a), int(b)) for i, (a, b) in enumerate(xy)] + [(1, i, 40 * i, -3) for i in range(4)] + [(2, 0, 5, 5)]
    df = spark.createDataFrame(rows, "f int, id long, x int, y int")
    k = 6
    got = {(r.f, r.id, r.other, r["rank"]) for r in cluster.knn_join(df, ["f"], k).collect()}
    assert got == brute(rows, k)


def test_pairs_are_bounded_by_k_a_pixel(spark):
    rng = np.random.default_rng(4)
    k = 5
    for n in (1500, 6000):
        # a tight cluster beside thinly spread pixels: all pairs would be n squared
        xy = np.concatenate([rng.normal((0, 0), 40, (n, 2)), rng.uniform(-20_000, 20_000, (n // 4, 2))]).astype(int)
        df = spark.createDataFrame([(0, i, int(a), int(b)) for i, (a, b) in enumerate(xy)], "f int, id long, x int, y int")
        assert cluster.knn_pairs(df, ["f"], k).count() <= 100 * k * len(xy)


def test_pairs_do_not_grow_with_density(spark):
    k = 5
    # every place of a square holds a pixel; and one place holds many
    full = [(0, 100 * y + x, x, y) for x in range(70) for y in range(70)]
    heap = [(1, i, 3, 4) for i in range(400)] + [(1, 400 + i, 3 + i, 5) for i in range(5)]
    for rows in (full, heap):
        df = spark.createDataFrame(rows, "f int, id long, x int, y int")
        assert cluster.knn_pairs(df, ["f"], k).count() <= 4 * k * len(rows)


def test_dense_places_and_fractions(spark):
    rng = np.random.default_rng(5)
    k = 5
    xy = np.concatenate([[(x, y) for x in range(12) for y in range(12)], np.tile([[5, 5]], (20, 1)), np.tile([[40, 40]], (9, 1)), rng.normal((900, -7), 0.3, (60, 2)), [(10**6, 10**6 + 0.1), (10**6 + 0.3, 10**6 + 0.1)]]).astype(float)
    ids = rng.permutation(len(xy))
    rows = [(0, int(i), float(a), float(b)) for i, (a, b) in zip(ids, xy)] + [(1, 7, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "f int, id long, x double, y double")
    got = {(r.f, r.id, r.other, r["rank"]) for r in cluster.knn_join(df, ["f"], k).collect()}
    assert got == brute(rows, k)


def test_coherence_by_hand(spark):
    rows = [(0, 1, 0, 0, 1), (0, 2, 2, 0, 1), (0, 3, 0, 1, 2), (0, 4, 0, 0, 2)]
    df = spark.createDataFrame(rows, "f int, id long, x int, y int, cluster int")
    got = {r.id: round(r.coherence, 9) for r in cluster.knn_coherence(df, ["f"], 2).collect()}
    # 1: 4 in its own place, then 3; 2: 1 before 4 at the same distance; 3: 1 before 4; 4: 1, then 3
    assert got == {1: round((-100 - 1) / 2, 9), 2: round((0.25 - 0.25) / 2, 9), 3: round((-1 + 1) / 2, 9), 4: round((-100 + 1) / 2, 9)}
