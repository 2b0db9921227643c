import re

import pyarrow.parquet as pq

from tidemark.llm import decontamination as dc
from tidemark.llm import queries


def template(text):
    """(plain words, template words), written from the definition."""
    words = (text or "").encode().split()
    plain, code = [], []
    opens = True
    for i, w in enumerate(words):
        bare = w.strip(dc._EDGE)
        low = bare.lower()
        number = re.fullmatch(rb"[0-9][0-9.,/]*", bare)
        before = i and re.fullmatch(rb"[0-9][0-9.,/]*", words[i - 1].strip(dc._EDGE))
        if number:
            code.append("<number>")
        elif low.decode("utf-8", "replace") in dc.UNITS:
            code.append("<unit>" if before else low)
        elif re.fullmatch(rb"[A-Z].+", bare) and bare[1:].islower() and not opens:
            code.append("<name>")
        else:
            code.append(low)
        plain.append(low)
        opens = w.rstrip(b"\"')]")[-1:] in (b".", b"!", b"?", b":")
    return plain, code


def windows(text, size):
    plain, code = template(text)
    for p in range(len(code) - size + 1):
        if sum(not str(c).startswith("<") or isinstance(c, bytes) for c in code[p : p + size]) >= min(dc.LITERALS, size - 1):
            yield (plain[p], *code[p + 1 : p + size])


def test_whole_table_against_sets_of_windows(spark, sf_dir):
    docs = pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()
    items = pq.read_table(f"{sf_dir}/benchmark.parquet").to_pylist()
    want = set()
    wins = {d["doc_id"]: {} for d in docs}
    for b in items:
        size = min(dc.WINDOW, len(b["text"].split()))
        mine = set(windows(b["text"], size))
        for d in docs:
            have = wins[d["doc_id"]].setdefault(size, set(windows(d["text"], size)))
            if mine & have:
                want.add((d["doc_id"], b["item_id"]))
    got = {(r.doc_id, r.item_id) for r in queries.op5_template_decontamination(spark, sf_dir).collect()}
    assert got == want and got


def test_reparameterised_and_inconsistent(spark, monkeypatch):
    item = "A train leaves the town of Lyon with 12 cars and 12 drivers, then after 30 km the guard Maria counts all of the seats again."
    same = "today we saw " + item
    other = item.replace("12", "45").replace("Lyon", "Metz").replace("30 km", "7 miles").replace("Maria", "Paula")
    broken = item.replace("12 cars", "45 cars").replace("12 drivers", "46 drivers")
    rows = [(1, same), (2, other), (3, broken), (4, None), (5, ""), (6, "a b c"), (7, item.upper()), (8, "w " * 30_000 + item)]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(10, item), (11, None), (12, "too short"), (13, item)], "item_id long, text string")
    for size in (dc.CHUNK_WORDS, 10):
        monkeypatch.setattr(dc, "CHUNK_WORDS", size)
        got = {(r.doc_id, r.item_id): r for r in dc.contaminated(docs, bench).collect()}
        assert {k for k, _ in got} == {1, 2, 7, 8}
        assert {k for _, k in got} == {10, 13}
        assert got[1, 10].exact and not got[2, 10].exact and got[2, 10].n_slots == 6
        clean = dc.keep_clean(docs, bench)
        assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [3, 4, 5, 6]
    assert dc.contaminated(docs.limit(0), bench).count() == 0
    assert dc.contaminated(docs, bench.limit(0)).count() == 0


def test_items_dense_in_numbers(spark):
    item = "Sums: 12 34 56 78 90 and 21 43 65 87 then Lyon Metz Paris."
    docs = spark.createDataFrame([(1, "we add " + item + " and go on"), (2, item.replace("43", "44")), (3, "Sums: 1 2 3")], "doc_id long, text string")
    bench = spark.createDataFrame([(10, item)], "item_id long, text string")
    got = dc.contaminated(docs, bench).collect()
    assert [(r.doc_id, r.item_id, r.exact) for r in got] == [(1, 10, True)]
    assert sorted(r.doc_id for r in dc.keep_clean(docs, bench).collect()) == [2, 3]
