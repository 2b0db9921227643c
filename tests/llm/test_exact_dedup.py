import hashlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from tidemark.llm import exact_dedup, queries
from tidemark.llm.exact_dedup import QuotientFilter


def brute(rows):
    groups = defaultdict(list)
    for k, (doc_id, text) in enumerate(rows):
        groups[text or ""].append((doc_id is not None, doc_id or 0, k))
    out = []
    for text, members in groups.items():
        top = max(members)
        for m in members:
            # which of several rows with one doc_id stays is free: the last here
            out.append((m[1] if m[0] else None, top[1] if top[0] else None, len(members), m == top, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=repr)


ROWS = (
    [(i, "hot text") for i in range(400)]
    + [(1000 + i, f"only {i}") for i in range(300)]
    + [(2000 + i, f"pair {i // 2}") for i in range(100)]
    + [(7, None), (8, ""), (None, None), (None, "hot text"), (2**63 - 1, "x"), (-(2**63), "x"), (5, "twice"), (5, "twice"), (6, "A"), (9, "a"), (10, "a "), (11, "é"), (12, "é")]
    + [(20, "long " * 200_000), (21, "long " * 200_000), (22, "long " * 200_000 + ".")]
)


@pytest.mark.parametrize("bits", [64, 12, 4])
def test_brute_force_and_collisions(spark, bits):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(7)
    assert got(exact_dedup.groups(df, bits)) == brute(ROWS)


def test_joins_by_shuffle(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(5)
    assert got(exact_dedup.groups(df, broadcast_rows=1)) == brute(ROWS)


def test_empty_clashing_names_and_keep_one(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    more = df.selectExpr("text as fp", "doc_id as row", "doc_id", "text", "text as keep", "1 as again", "2 as kept", "3 as n")
    assert got(exact_dedup.groups(more)) == brute(ROWS)
    assert exact_dedup.groups(df.limit(0)).count() == 0
    assert exact_dedup.keep_one(df).count() == len({t or "" for _, t in ROWS})


def test_whole_table(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.execute(queries.ORACLE_SQL["op13_quotient_dedup"]).fetchall()
    assert got(queries.op13_quotient_dedup(spark, sf_dir)) == sorted(want, key=repr)


@pytest.mark.parametrize("width", [64, 60, 40, 9, 1])
def test_filters_keep_and_merge_counts(width):
    rng = np.random.default_rng(width)
    want, filters = defaultdict(int), []
    for n in (0, 1, 2, 1000, 37):
        values, counts = np.unique(rng.integers(0, min(2**width, 2**63), n).astype(np.uint64), return_counts=True)
        if width == 64 and n > 2:
            values[-1] = np.uint64(2**64 - 1)
        for v, c in zip(values, counts):
            want[int(v)] += int(c)
        made = QuotientFilter.of(values, counts, width)
        back = QuotientFilter.unpack(made.pack())
        assert (back.fingerprints() == values).all() and (back.counts == counts).all()
        filters.append(back)
    whole = QuotientFilter.merged(filters)
    assert dict(zip(map(int, whole.fingerprints()), map(int, whole.counts))) == want
