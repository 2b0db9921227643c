import duckdb
import numpy as np
import pytest

from tidemark.llm import hard_negatives, queries

SCHEMA = "vec_id long, embedding array<double>, label int"
INF = float("inf")


def brute(rows, every=100, most=5):
    used = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        used.append((vec_id, [int(np.floor(256.0 * x)) for x in vector], label))

    def score(a, b):
        return max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b))))

    out = []
    for k, (vec_id, vector, label) in enumerate(used):
        if vec_id is None or vec_id % every:
            continue
        other = [(-score(vector, v), i is None, i or 0, same == label) for n, (i, v, same) in enumerate(used) if n != k]
        other.sort()
        for p in [x for x in other if x[3]][:most]:
            hard = [x for x in other if not x[3] and 80 * -p[0] <= 100 * -x[0] <= 100 * -p[0]][:most]
            out += [(vec_id, None if p[1] else p[2], r, None if x[1] else x[2], -p[0], -x[0]) for r, x in enumerate(hard, 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect()), key=repr)


def clustered(n, seed, width=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    rows = []
    for i in range(n):
        v = centres[rng.integers(6)] + 0.2 * rng.normal(size=width)
        rows.append((i, [float(x) for x in v * rng.uniform(0.05, 3)], int(rng.integers(4))))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_of_any_norm(spark, seed, monkeypatch):
    monkeypatch.setattr(hard_negatives, "TILE", 16)
    monkeypatch.setattr(hard_negatives, "SAMPLE", 40)
    rows = clustered(900, seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(hard_negatives.mine(df, anchors=20, block_rows=50, anchor_rows=10)) == brute(rows, 20)


def test_edges(spark):
    rows = [
        (0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (100, [0.0, 0.0], 1), (200, [], 1), (300, [1.0], 2), (-100, [0.5, 0.5, 0.5], 2),
        (None, [1.0, 0.1], 1), (None, [0.9, 0.0], 2), (5, None, 1), (6, [1.0, None], 1), (7, [INF, 1.0], 1), (8, [float("nan"), 1.0], 1), (9, [1.0, 1.0], None),
        (10, [0.95, 0.0], 2), (11, [0.95, 0.0], 2), (12, [0.95, 0.0], 2), (13, [0.95, 0.0], 3), (14, [0.95, 0.0], 3), (15, [0.95, 0.0], 3), (16, [-1.0, 0.0], 1), (17, [-0.9, 0.0], 2), (400, [0.1, 0.7], 9),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(hard_negatives.mine(df)) == brute(rows)
    more = df.selectExpr("vec_id", "embedding", "label", "label as row", "1 as cell", "2 as rank", "3 as block")
    assert got(hard_negatives.mine(more)) == brute(rows)
    assert got(hard_negatives.mine(df.limit(0))) == []
    assert got(hard_negatives.mine(df.filter("label is null"))) == []


def test_large_numbers_and_long_vectors(spark):
    rows = [(i, [1e9 * (i + 1), -3e8 * i], i % 2) for i in range(30)] + [(100 + i, [1e30 * (-1) ** i, 1e307], i % 3) for i in range(12)]
    got(hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), anchors=10))
    exact = [(i, [2.0**20 * (i + 1) + i / 256, -(2.0**19) * i + 1 / 256], i % 2) for i in range(40)]
    assert got(hard_negatives.mine(spark.createDataFrame(exact, SCHEMA), anchors=10)) == brute(exact, 10)
    rng = np.random.default_rng(3)
    wide = [(i, [float(x) for x in rng.normal(size=3000)], i % 2) for i in range(40)]
    assert got(hard_negatives.mine(spark.createDataFrame(wide, SCHEMA), anchors=10)) == brute(wide, 10)


def test_whole_table(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    names = "anchor_id, positive_id, rank, negative_id, positive_score, negative_score"
    want = con.execute(f"SELECT {names} FROM ({queries.ORACLE_SQL['op11_angular_negatives']})").fetchall()
    assert got(queries.op11_angular_negatives(spark, sf_dir)) == sorted(want, key=repr)
