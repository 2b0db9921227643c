"""Alignment of two tokenizers by pointer jumping.

Both tokenizers cut the same bytes (a space and the text). Every token points to
the token of the other tokenizer that overlaps it and reaches farthest to the
right; a token of the first that ends where one of the second ends points to
itself, and that one points to it. Doubling all successors at once, in one array
for a batch of documents, ends after about log2 of the longest chain at each
component's last token, which labels the component: the tokens between two byte
offsets where both tokenizers end.

Links are the pairs of tokens that end together; how often a pair is linked is
counted over all documents, and a document reports how many of its links are the
commonest of their second token.

*Scale.* Texts are encoded once, in batches of some megabytes; links are written
as packed pairs with a row a document. Counts are summed in each task before they
are shuffled, and a pair of ids has one row in all. While there are at most two
million pairs the counts go to all tasks as arrays; beyond that the pairs of each
document, counted, are joined with them by shuffle.

Both tokenizers split before each space that stands between two characters that
are no white space (the first by its pattern, the second as no piece of its
vocabulary holds such a space but as its first character), so the parts between
such spaces are encoded once and remembered; a text with another space, or with a
part whose tokens do not give back its bytes, is encoded whole.

Defined cases: a null or empty text, and one whose tokens do not give back its
bytes (the second tokenizer changes some characters), has no tokens: zeros and an
empty hash; bytes that are no UTF-8 count as U+FFFD; special tokens' strings are plain text; repeated rows count once each;
a null doc_id is carried; very long texts are encoded whole; other columns may
have any name and are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, few_texts, materialize

#: Pairs of ids whose counts may go to all tasks (13 bytes each).
BROADCAST_PAIRS = 2_000_000
#: Characters of the pieces of text that a worker remembers.
REMEMBERED = 3_000_000
#: Characters that some patterns take for white space and Python does not.
_DOUBTFUL = "\u180e\u200b\u2060\ufeff"


def _byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level tokenizer file: ids of a space and each text, and the bytes of each id."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.size = self.tokenizer.get_vocab_size()
        byte = _byte_level()
        self.bytes = [b""] * self.size
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.length = np.array([len(x) for x in self.bytes], np.int64)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """A piece model with byte fallback, which puts a space before a text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.bytes, self.splits = [], True
        for i in range(self.size):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:-1], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())
            # no piece spans a space that stands between other characters
            self.splits &= "▁" not in piece.lstrip("▁")
        self.length = np.array([len(x) for x in self.bytes], np.int64)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []


class Encoder:
    """Both tokenizers' ids of texts; parts of texts between single spaces are encoded once and remembered."""

    def __init__(self, first: str, second: str):
        self.a, self.b = ByteLevel(first), Pieces(second)
        self.known: dict[str, tuple[bytes, bytes] | None] = {}
        self.held = 0

    def _packed(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of each text as packed 32-bit numbers; None if some tokens' bytes are not those of a space and the text."""
        of_a, of_b, out = self.a.bytes.__getitem__, self.b.bytes.__getitem__, []
        for text, a, b in zip(texts, self.a.ids(texts), self.b.ids(texts)):
            data = b" " + text.encode()
            fine = b"".join(map(of_a, a)) == data and b"".join(map(of_b, b)) == data
            out.append((array("i", a).tobytes(), array("i", b).tobytes()) if fine else None)
        return out

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        if self.held > REMEMBERED:
            self.known, self.held = {}, 0
        parts = [text.split(" ") for text in texts]
        fresh: dict[str, None] = {}
        for some in parts:
            fresh.update(dict.fromkeys([p for p in some if p not in self.known]))
        # a cut is right only between two characters that are no white space
        cut = [p for p in fresh if p and not (p[0].isspace() or p[-1].isspace() or p[0] in _DOUBTFUL or p[-1] in _DOUBTFUL)] if self.b.splits else []
        self.held += sum(map(len, fresh))
        self.known |= fresh
        self.known |= zip(cut, self._packed(cut))
        out: list[tuple[np.ndarray, np.ndarray] | None] = []
        whole = []
        for i, some in enumerate(parts):
            found = list(map(self.known.__getitem__, some))
            if None in found:
                whole.append(i)
                out.append(None)
            else:
                out.append(tuple(np.frombuffer(b"".join([x[k] for x in found]), np.int32) for k in (0, 1)))
        for i, data in zip(whole, self._packed([texts[i] for i in whole])):
            out[i] = None if data is None else tuple(np.frombuffer(x, np.int32) for x in data)
        return out


@lru_cache(maxsize=2)
def _encoder(first: str, second: str) -> Encoder:
    return Encoder(first, second)


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The terminal token (an index into ``ends_a``) of every token of both, and for each of A's the B token that reaches its end.

    ``ends`` are the byte offsets where tokens end, increasing; both end at the same last offset.
    """
    n = len(ends_a)
    over_b = np.searchsorted(ends_b, ends_a)
    over_a = np.searchsorted(ends_a, ends_b)
    together = ends_b[over_b] == ends_a
    successor = np.concatenate([np.where(together, np.arange(n), n + over_b), over_a])
    while True:
        farther = successor[successor]
        if np.array_equal(farther, successor):
            return successor[:n], successor[n:], over_b
        successor = farther


def _digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of the numbers below ``size``, left-aligned with room for one more byte, and how many each has."""
    width = len(str(size - 1))
    text = np.char.encode(np.arange(size).astype(f"U{width}"), "ascii")
    table = np.zeros((size, width + 1), np.uint8)
    table[:, :width] = text.view(np.uint8).reshape(size, width)
    return table, (table > 0).sum(axis=1)


_DIGITS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _written(ids_a, ids_b, label_a, label_b, ends, partner) -> tuple[np.ndarray, np.ndarray]:
    """All groups as bytes, and the place after each group in them."""
    group = np.cumsum(ends) - 1  # of a terminal token
    group_a, group_b = group[label_a], group[label_b]
    count = int(ends.sum())
    in_a, in_b = np.bincount(group_a, minlength=count), np.bincount(group_b, minlength=count)
    before_b = np.cumsum(in_b) - in_b
    at_a = np.arange(len(ids_a)) + before_b[group_a]
    at_b = np.arange(len(ids_b)) + np.cumsum(in_a)[group_b]
    ids = np.empty(len(ids_a) + len(ids_b), np.int64)
    ids[at_a], ids[at_b] = ids_a, ids_b
    mark = np.full(len(ids), ord(","), np.uint8)
    mark[at_a[ends]] = ord("|")
    last = at_b[partner[ends]]
    mark[last] = ord(";")
    size = int(ids.max(initial=0)) + 1
    size = 1 << max(10, (size - 1).bit_length())
    if size not in _DIGITS:
        _DIGITS[size] = _digits(size)
    table, digits = _DIGITS[size]
    parts = []
    for lo in range(0, len(ids), 1 << 20):
        some, n = ids[lo : lo + (1 << 20)], digits[ids[lo : lo + (1 << 20)]]
        rows = table[some]
        rows[np.arange(len(some)), n] = mark[lo : lo + (1 << 20)]
        parts.append(rows[np.arange(table.shape[1]) <= n[:, None]])
    after = np.cumsum(digits[ids] + 1)
    return np.concatenate(parts) if parts else np.empty(0, np.uint8), after[last]


def _encode(first: str, second: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(first, second)
        a, b = encoder.a, encoder.b
        kind = pair_type(a.size, b.size)
        for batch in few_texts(batches, 1 << 20):
            texts = [(x or b"").decode("utf-8", "replace") for x in binary(batch.column("text"))]
            some = [i for i, t in enumerate(texts) if t]
            found = encoder.encode([texts[i] for i in some])
            fine = [k for k, x in enumerate(found) if x is not None]
            of_a, of_b = ([x[t] if x is not None else None for x in found] for t in (0, 1))
            n_a, n_b, n_groups = (np.zeros(len(texts), np.int64) for _ in range(3))
            hashes, links = [""] * len(texts), [b""] * len(texts)
            if fine:
                ids_a, ids_b = np.concatenate([of_a[k] for k in fine]), np.concatenate([of_b[k] for k in fine])
                label_a, label_b, partner = align(np.cumsum(a.length[ids_a]), np.cumsum(b.length[ids_b]))
                ends = label_a == np.arange(len(ids_a))
                data, after = _written(ids_a, ids_b, label_a, label_b, ends, partner)
                pairs = (ids_b[partner[ends]].astype(kind) * kind(a.size) + ids_a[ends].astype(kind)).astype(kind)
                done = np.concatenate([[0], np.cumsum(ends)])[np.concatenate([[0], np.cumsum([len(of_a[k]) for k in fine])])]
                for k, lo, hi in zip(fine, done[:-1], done[1:]):
                    i = some[k]
                    n_a[i], n_b[i], n_groups[i] = len(of_a[k]), len(of_b[k]), hi - lo
                    links[i] = pairs[lo:hi].tobytes()
                    hashes[i] = hashlib.sha256(data[after[lo - 1] if lo else 0 : after[hi - 1] - 1].tobytes()).hexdigest()
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id").cast(pa.int64()),
                    "n_a": pa.array(n_a),
                    "n_b": pa.array(n_b),
                    "n_groups": pa.array(n_groups),
                    "groups_sha256": pa.array(hashes, pa.string()),
                    "links": pa.array(links, pa.binary()),
                }
            )

    return run


def pair_type(size_a: int, size_b: int):
    """The smallest type that holds a pair ``b * size_a + a``."""
    return np.uint32 if size_a * size_b <= 1 << 32 else np.uint64


def _counted(kind):
    """Pairs of a task with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0

        def flush():
            nonlocal keys, counts, held
            every, where = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.zeros(len(every), np.int64)
            np.add.at(total, where, np.concatenate(counts))
            keys, counts, held = [every], [total], len(every)

        for batch in batches:
            every, n = np.unique(np.frombuffer(b"".join(batch.column("links").to_pylist()), kind), return_counts=True)
            keys.append(every)
            counts.append(n)
            held += len(every)
            if held > 4_000_000:
                flush()
                if held > 2_000_000:
                    yield pa.record_batch({"pair": pa.array(keys[0].astype(np.int64)), "n": pa.array(counts[0])})
                    keys, counts, held = [], [], 0
        if held:
            flush()
            yield pa.record_batch({"pair": pa.array(keys[0].astype(np.int64)), "n": pa.array(counts[0])})

    return run


def _looked_up(kind, table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = table.value
        for batch in batches:
            links = batch.column("links").to_pylist()
            ends = np.cumsum([len(x) // np.dtype(kind).itemsize for x in links], dtype=np.int64)
            at = np.searchsorted(pairs, np.frombuffer(b"".join(links), kind).astype(np.int64))
            totals = [np.concatenate([[0], np.cumsum(v[at], dtype=np.int64)]) for v in (best, counts)]
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            out = {c: batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")}
            out |= {"n_best": pa.array(totals[0][ends] - totals[0][starts]), "count_sum": pa.array(totals[1][ends] - totals[1][starts])}
            yield pa.record_batch(out | {"groups_sha256": batch.column("groups_sha256")})

    return run


def _listed(kind):
    """The distinct pairs of each document with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, links in zip(batch.column("row").to_pylist(), batch.column("links").to_pylist()):
                every, n = np.unique(np.frombuffer(links, kind), return_counts=True)
                yield pa.record_batch({"row": pa.array(np.full(len(every), row, np.int64)), "pair": pa.array(every.astype(np.int64)), "times": pa.array(n.astype(np.int64))})

    return run


OUT = "doc_id long, n_a long, n_b long, n_groups long, n_best long, count_sum long, groups_sha256 string"


def alignments(docs: DataFrame, first: str, second: str) -> DataFrame:
    """``row, doc_id, n_a, n_b, n_groups, groups_sha256, links`` for every row, written once; links are packed pairs."""
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = slim.mapInArrow(_encode(first, second), "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary")
    return materialize(found.select(F.monotonically_increasing_id().alias("row"), "*"), "alignments")


def pair_counts(aligned: DataFrame, size_a: int, size_b: int) -> DataFrame:
    """``pair, a, b, n, best``: how often each pair is linked in all documents, and whether no pair of its B token is linked more often."""
    summed = aligned.select("links").mapInArrow(_counted(pair_type(size_a, size_b)), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    b = F.floor(F.col("pair") / size_a).cast("long")
    counts = materialize(summed.select("pair", (F.col("pair") - b * size_a).alias("a"), b.alias("b"), "n"), "pairs")
    return counts.join(counts.groupBy("b").agg(F.max("n").alias("most")), "b").select("pair", "a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def links(docs: DataFrame, first: str, second: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """One row a document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``."""
    spark = docs.sparkSession
    a, b = _encoder(first, second).a, _encoder(first, second).b
    kind = pair_type(a.size, b.size)
    aligned = alignments(docs, first, second)
    counts = materialize(pair_counts(aligned, a.size, b.size), "counts")
    if counts.count() <= broadcast_pairs:
        held = counts.select("pair", "n", "best").toArrow().sort_by("pair")
        table = spark.sparkContext.broadcast((held["pair"].to_numpy(), held["n"].to_numpy(), held["best"].to_numpy(zero_copy_only=False).astype(np.int64)))
        out = aligned.drop("row").mapInArrow(_looked_up(kind, table), OUT)
    else:
        listed = aligned.select("row", "links").mapInArrow(_listed(kind), "row long, pair long, times long")
        sums = (
            listed.join(counts.select("pair", "n", "best"), "pair")
            .groupBy("row")
            .agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        )
        none = F.lit(0).cast("long")
        out = aligned.drop("links").join(sums, "row", "left").withColumns({c: F.coalesce(F.col(c), none) for c in ("n_best", "count_sum")})
    # one link ends each group
    return out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
