import zlib
from collections import defaultdict

import pyarrow.parquet as pq

from tidemark.llm import queries
from tidemark.llm.sharding import shard


def check(rows, texts, shards=8, slack=0.1):
    size, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    for s, have in slots.items():
        assert sorted(have) == list(range(len(have)))
    mean = sum(size.values()) / shards
    assert max(size.values()) - mean <= slack * mean


def test_whole_table(spark, sf_dir):
    table = {r["doc_id"]: (r["text"] or "").encode() for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()}
    rows = queries.op9_vector_sharding(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(table)
    for r in rows:
        assert r.size == len(table[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(table[r.doc_id])
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 8
    check(rows, table, slack=0.25)


def test_hot_group_and_edges(spark):
    rows = [(i, "the same text " * 3 if i % 3 == 0 else f"text {i} " * (i % 5)) for i in range(6000)] + [(7, None), (7, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "text")
    out = shard(df).collect()
    assert len(out) == len(rows)
    check(out, None, slack=0.01)
    assert shard(df.limit(0)).count() == 0
    assert [r.slot for r in shard(df.filter("doc_id is null")).collect()] == [0]


def test_repeated_rows_very_long_texts_and_clashing_names(spark):
    rows = [(None, "abcd") for _ in range(4000)] + [(i, f"{i:04d}") for i in range(4000)]
    out = shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    check(out, None, slack=0.05)
    rows = [(0, "x" * 5_000_000), (1, "y" * 4_000_000)] + [(i, "word " * (i % 7)) for i in range(2, 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as row", "2 as shard", "3 as item", "4 as size")
    out = shard(df).collect()
    big = {r.doc_id: r.shard for r in out if r.doc_id < 2}
    assert len(out) == len(rows) and big[0] != big[1]
