import re
from collections import defaultdict

import pyarrow.parquet as pq

from tidemark.llm import line_dedup as ld
from tidemark.llm import queries


def brute(rows, min_docs=2):
    """doc_id -> dropped line numbers, straight from the definition."""
    lines = [(i, k, tuple("<*>" if re.search("[0-9]", w.decode()) else w.decode() for w in line.encode().split())) for i, t in rows for k, line in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if x[2]]
    leaf = lambda t: (len(t), t[: ld.DEPTH])
    docs, leaf_docs, at = defaultdict(set), defaultdict(set), defaultdict(lambda: defaultdict(lambda: defaultdict(set)))
    for i, _, t in lines:
        docs[t].add(i)
        leaf_docs[leaf(t)].add(i)
    for t in docs:
        for p, w in enumerate(t):
            at[leaf(t)][p][w] |= docs[t]
    name, general = {}, {}
    for t in docs:
        fixed = [len(at[leaf(t)][p][w]) >= min_docs for p, w in enumerate(t)]
        tail = [(w, f) for w, f in list(zip(t, fixed))[ld.DEPTH :] if w != "<*>"]
        n = sum(f for _, f in tail)
        general[t] = n >= ld.TAIL and n >= ld.CONSTANT * len(tail)
        name[t] = (leaf(t), general[t], tuple(w if f or not general[t] else None for w, f in zip(t, fixed)))
    members = defaultdict(set)
    for t in docs:
        members[name[t]] |= docs[t]
    head = {}
    for i, k, t in sorted(lines):
        head.setdefault(name[t], (i, k))
    out = defaultdict(list)
    for i, k, t in lines:
        if len(leaf_docs[leaf(t)]) < min_docs:
            continue
        if any(w != "<*>" for w in t) and len(members[name[t]]) >= min_docs and head[name[t]] != (i, k):
            out[i].append(k)
    return dict(out)


def test_whole_table(spark, sf_dir):
    table = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()]
    got = {r.doc_id: r.dropped for r in ld.drop_recurring(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    assert {i: d for i, d in got.items() if d} == brute(table)
    assert got.keys() == {i for i, _ in table} and any(got.values())
    assert queries.op2_line_templates(spark, sf_dir).count() == len(table)


def test_templates_and_edges(spark, monkeypatch):
    cookie = "We use cookies on this site so that {} can read our pages in peace number {}"
    names = "anna ben cleo dan eva finn".split()
    rows = [(i, f"own line of {names[i]} here\n\n" + cookie.format(names[i], i) + f"\nPage {i} of 9") for i in range(6)]
    rows += [(10, None), (11, ""), (12, "x\n" * 3), (13, "Page 1 of 2\nPage 2 of 2"), (13, "Page 3 of 3"), (14, "w " * 20_000), (15, "only\nonce")]
    df = spark.createDataFrame([(i, t, "b") for i, t in rows], "doc_id long, text string, block string")
    for wide in (ld.LEAF_BYTES, 1):
        monkeypatch.setattr(ld, "LEAF_BYTES", wide)
        got = ld.drop_recurring(df, blocks=3).collect()
        by = {r.doc_id: r for r in got if r.doc_id != 13}
        assert len(got) == len(rows) and by[0].n_dropped == 0 and by[15].n_dropped == 0 and by[12].n_dropped == 0
        for i in range(1, 6):
            assert 3 in by[i].dropped and 2 in by[i].dropped
            assert "own line" in by[i].text
    assert ld.drop_recurring(df.limit(0), blocks=2).count() == 0


def test_leaves_of_any_size_are_generalised_alike(spark, sf_dir, monkeypatch):
    line = "We use cookies on this site so that {} can read our pages in peace"
    rows = [(i, line.format(f"{chr(97 + i)}xyz")) for i in range(20)] + [(30, "seen in just two places"), (31, "seen in just two places")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = []
    for wide in (ld.LEAF_BYTES, 1):
        monkeypatch.setattr(ld, "LEAF_BYTES", wide)
        got = {r.doc_id: r.dropped for r in ld.drop_recurring(df, blocks=3).collect()}
        assert got == {i: [0] if 0 < i < 20 or i == 31 else [] for i, _ in rows}
        seen.append({r.doc_id: r.dropped for r in ld.drop_recurring(table, blocks=3).collect()})
    assert seen[0] == seen[1] and any(seen[0].values())


def test_variants_within_one_document_do_not_make_a_template(spark):
    line = "{} we keep these very same words on the page of {}"
    rows = [(1, "\n".join(line.format("so", w) for w in "ab cd ef gh".split())), (2, "so we keep nothing of these words on any page of ij")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.n_dropped for r in ld.drop_recurring(df, blocks=2).collect()] == [0, 0]
    df = spark.createDataFrame([*rows, (3, line.format("so", "kl"))], "doc_id long, text string")
    assert {r.doc_id: r.dropped for r in ld.drop_recurring(df, blocks=2).collect()} == {1: [1, 2, 3], 2: [], 3: [0]}


def test_blocks_without_shared_or_any_lines(spark, sf_dir):
    for rows in ([(1, "x"), (2, "y z")], [(1, ""), (2, None), (3, " \n ")], [(1, "only one")], [(None, "a b"), (2**63 - 1, "c")]):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        for blocks in (1, 5):
            got = sorted(((r.doc_id, r.text, r.dropped) for r in ld.drop_recurring(df, blocks=blocks).collect()), key=repr)
            assert got == sorted(((i, t or "", []) for i, t in rows), key=repr)
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    few = {r.doc_id: r.dropped for r in ld.drop_recurring(table).collect()}
    assert few == {r.doc_id: r.dropped for r in ld.drop_recurring(table, blocks=150).collect()}
