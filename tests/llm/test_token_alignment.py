import hashlib
from collections import Counter

import pyarrow.parquet as pq
import pytest

from tidemark.llm import queries, token_alignment

A, B = queries.TOKENIZERS


def brute(rows):
    """Each text by itself: sets of end offsets, plain loops."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    sp = SentencePieceProcessor(model_file=B)
    byte = token_alignment._byte_level()
    count, docs = Counter(), []
    for doc_id, text in rows:
        data = (" " + (text or "")).encode()
        a = b = ()
        if text:
            ids = t.encode(" " + text, add_special_tokens=False).ids
            a = [(i, bytes(byte[c] for c in t.id_to_token(i))) for i in ids]
            b = []
            for i in sp.encode(text):
                piece = sp.id_to_piece(i)
                b.append((i, bytes([int(piece[3:5], 16)]) if sp.is_byte(i) else piece.replace("▁", " ").encode()))
        if not text or b"".join(x for _, x in a) != data or b"".join(x for _, x in b) != data:
            a = b = ()
        ends = []
        for tokens in (a, b):
            at, own = 0, {}
            for i, x in tokens:
                at += len(x)
                own[at] = i
            ends.append(own)
        both = sorted(ends[0].keys() & ends[1].keys())
        links = [(ends[0][e], ends[1][e]) for e in both]
        parts = [[[] for _ in both] for _ in ends]
        for own, part in zip(ends, parts):
            at = 0
            for e in sorted(own):
                part[at].append(str(own[e]))
                at += e == both[at]
        groups = ["|".join(",".join(part[k]) for part in parts) for k in range(len(both))]
        count.update(links)
        docs.append((doc_id, len(a), len(b), links, ";".join(groups)))
    most = Counter()
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    out = []
    for doc_id, n_a, n_b, links, groups in docs:
        sha = hashlib.sha256(groups.encode()).hexdigest() if n_a else ""
        out.append((doc_id, n_a, n_b, len(links), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), sha))
    return sorted(out, key=repr)


def got(df):
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


ROWS = [
    (1, "The quick brown fox, doesn't it? 12345 km."),
    (2, None),
    (3, ""),
    (None, "the same words"),
    (4, "the same words"),
    (4, "the same words"),
    (5, " leading, double  spaces \t tabs\nand lines \n\n and the end "),
    (6, "strings <|endoftext|> and <s> </s> <unk> <0x41> stay text"),
    (7, "a ▁ is not given back"),
    (8, "日本語 и русский ไทย 😀👩‍👩‍👧 ​‍ 　x y \x85 z \x1c w ﻿ v"),
    (9, "x" * 3000 + " " + "ab" * 2000),
    (10, "word and more " * 4_000),
    (11, " "),
    (12, "nul \x00 inside"),
    (13, "é and ﬁ ligature Ⅳ ½"),
    (14, "\n"),
]


@pytest.mark.parametrize("most", [2_000_000, 10])
def test_brute_force(spark, most):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    assert got(token_alignment.links(df, A, B, broadcast_pairs=most)) == brute(ROWS)


def test_empty_clashing_names_and_broken_text(spark):
    df = spark.createDataFrame(ROWS[:5], "doc_id long, text string")
    more = df.selectExpr("doc_id", "text", "text as links", "doc_id as row", "1 as pair", "2 as n_best")
    assert got(token_alignment.links(more, A, B)) == brute(ROWS[:5])
    assert got(token_alignment.links(df.limit(0), A, B)) == []
    broken = df.selectExpr("1L as doc_id", "cast(X'66FF6F' as string) as text").limit(1)
    assert got(token_alignment.links(broken, A, B)) == brute([(1, "f\ufffdo")])


def test_remembered_pieces(spark, monkeypatch):
    monkeypatch.setattr(token_alignment, "REMEMBERED", 20)
    e = token_alignment.Encoder(A, B)
    assert e.b.splits
    texts = [x for _, x in ROWS if x]
    texts += [r["text"] for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()[:150] if r["text"]]
    for text in texts + texts[::-1]:
        (ids,) = e.encode([text])
        want = e.a.tokenizer.encode(" " + text, add_special_tokens=False).ids, e.b.model.encode(text)
        assert ids is None and "▁" in text or tuple(i.tolist() for i in ids) == want


def test_whole_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()]
    assert got(queries.op12_pointer_alignment(spark, sf_dir)) == brute(rows)
