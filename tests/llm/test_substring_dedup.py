import hashlib
import random

import pyarrow.parquet as pq

from tidemark.llm import queries
from tidemark.llm.substring_dedup import remove_repeats


def brute(rows, length=20):
    """(doc_id, n_words, n_removed, sha256 of the kept words), by trying every window."""
    out, seen = [], {}
    split = sorted(((i, (t or "").encode().split()) for i, t in rows), key=lambda r: r[0])
    for i, words in split:
        for p in range(len(words) - length + 1):
            key = tuple(words[p : p + length])
            seen.setdefault(key, (i, p))
    for i, words in split:
        gone = set()
        for p in range(len(words) - length + 1):
            if seen[tuple(words[p : p + length])] != (i, p):
                gone.update(range(p, p + length))
        kept = b" ".join(w for j, w in enumerate(words) if j not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_matches_brute_force_on_whole_table(spark, sf_dir):
    table = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = sorted(map(tuple, queries.op3_substring_dedup(spark, sf_dir).collect()))
    want = brute([(r["doc_id"], r["text"]) for r in table])
    assert got == want
    assert sum(r[2] for r in got) > 0


def test_random_small_vocabulary(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(0, 40)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in remove_repeats(df, 5, 2, blocks=7).collect())
    assert got == brute(rows, 5)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, long), (5, long), (6, "a b c"), (6, "a b c")]
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, block string, n int")
    got = {(r.doc_id): r for r in remove_repeats(df, blocks=3).collect()}
    assert got[1].n_words == got[2].n_words == got[3].n_words == 0 and got[1].kept == ""
    assert got[4].n_removed == 0 and got[5].n_removed == 30_000 and got[5].kept == ""
    assert got[5].spans == [(0, 30_000)] and got[6].n_removed == 0
    assert remove_repeats(df.limit(0), blocks=2).count() == 0
