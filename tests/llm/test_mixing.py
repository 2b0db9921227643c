from collections import defaultdict
from math import log

import pyarrow.parquet as pq

from pyspark.sql import functions as F

from tidemark.llm import queries
from tidemark.llm.mixing import mix, mixture


def fill(sizes, weights=(1, 2, 3), cap=3):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        weight = sum(w[s] for s in names if s not in full)
        t = {s: cap * sizes[s] if s in full else left * w[s] / weight for s in names}
        over = {s for s in names if s not in full and t[s] > cap * sizes[s]}
        if not over:
            return t
        full |= over


def test_targets_and_taken_on_whole_table(spark, sf_dir):
    table = pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()
    words = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in table}
    sizes = defaultdict(int)
    for r in table:
        sizes[r["source"]] += words[r["doc_id"]]
    want = fill(sizes)
    got = {r.doc_id: r for r in queries.op1_pareto_mixing(spark, sf_dir).collect()}
    assert got.keys() == words.keys()
    taken = defaultdict(int)
    most = defaultdict(int)
    for r in table:
        g = got[r["doc_id"]]
        assert g.size == words[r["doc_id"]] and g.source_size == sizes[r["source"]]
        assert abs(g.target - want[r["source"]]) < 1e-6 * max(1, g.target)
        assert g.taken <= 3 * g.size and (g.size == 0 or g.taken % g.size == 0)
        taken[r["source"]] += g.taken
        most[r["source"]] = max(most[r["source"]], g.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= most[s] / 2 + 1
    again = {r.doc_id: r.taken for r in queries.op1_pareto_mixing(spark, sf_dir).collect()}
    assert again == {i: r.taken for i, r in got.items()}


def test_null_source_hot_source_and_repeats(spark):
    rows = [(i, "w " * (i % 7), None if i % 3 else ("a" if i % 2 else "b"), i) for i in range(300)] + [(5, "w w", None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    out = mix(df).collect()
    assert len(out) == 301
    by = defaultdict(lambda: [0, 0.0, 0])
    for r in out:
        by[r.source][0] += r.taken
        by[r.source][1] = r.target
    for s, (taken, target, _) in by.items():
        assert abs(taken - target) <= 7
    assert mixture(df).columns == df.columns
    assert mixture(df).count() == sum(r.copies for r in out)
    assert mix(df.limit(0)).count() == 0
    nothing = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [r.taken for r in mix(nothing).collect()] == [0, 0]


def test_the_draw_against_ranks_put_in_order(spark):
    """Pareto order sampling by hand: odds over inclusion odds, in order, until the words are there."""
    rows = [(i, "w " * (1 + i * i % 50), "abc"[i % 3 if i % 5 else 0]) for i in range(400)] + [(7, "w", "a"), (400, "w " * 20_000, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seeds = df.select("doc_id", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(20)), 11).alias("u")).distinct().collect()
    u = {r.doc_id: (r.u + 0.5) / 2**53 for r in seeds}
    got = sorted((r.source, r.doc_id, r.size, r.copies) for r in mix(df).collect())
    clash = df.withColumns({c: F.lit(1) for c in ("rank", "row", "of", "__source", "bucket", "size", "certain")})
    assert sorted((r.source, r.doc_id, r.copies) for r in mix(clash).collect()) == [(s, i, c) for s, i, _, c in got]
    docs = defaultdict(list)
    for i, t, s in rows:
        docs[s].append((i, len(t.split())))
    target = fill({s: sum(n for _, n in d) for s, d in docs.items()})
    want = []
    for s, mine in docs.items():
        size = sum(n for _, n in mine)
        certain, rest = int(target[s] // size), target[s] - target[s] // size * size
        f = lambda n: round(1000 * log(n + 2))
        scale = rest / sum(f(n) * n for _, n in mine)
        ranked = []
        for i, n in mine:
            p = min(1 - 1e-9, max(1e-12, scale * f(n)))
            ranked.append((u[i] / (1 - u[i]) / (p / (1 - p)), i, n))
        words = 0.0
        for _, i, n in sorted(ranked):
            words += n
            want.append((s, i, n, certain + (words - n / 2 <= rest)))
    assert got == sorted(want)
