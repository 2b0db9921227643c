"""Line dedup with a log-template tree.

A line's tokens are its words; words with a digit are variable and read as
``<*>``. The tree has a fixed depth: token count, then the ``DEPTH`` leading
tokens lead to a leaf. In a leaf, a position of a line is constant if its token
stands there in lines of two documents or more, else it is variable; the line's
template keeps the constant tokens. Positions are generalised only if at least
``CONSTANT`` of the words after the leading ones (and ``TAIL`` of them) are
constant; else the line is its own template. A template recurs if it is found in
two documents or more. Occurrences of recurring templates are dropped; the first
one (smallest doc_id, then line) stays.

*Scale.* Documents are dealt into blocks, and a block sends one row per distinct
line with the first and the last document that has it, so a line that a third of
all documents share costs one row per block; the least of the first and the
greatest of the last tell whether there are two documents. Leaves known to one
document end after the first pass. Leaves hold distinct lines. Those of up to
``LEAF_BYTES`` are generalised in a task; in a larger one tokens are summed by
(leaf, position, token) and the constant ones joined back, by the same rules and
with the same result. Decisions go back to the blocks that hold the line.

Defined cases: a null text is empty; blank lines stay and are not counted; a
null doc_id counts as the largest (one document with 2^63 - 1); rows that repeat a doc_id count as one
document, and equal places of them stay together; a very long text is one row of
its block, a very long line one row of its leaf; on an empty table the
result is empty. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, binary, block_count, materialize, mix, with_block

DEPTH = 3
CONSTANT, TAIL = 0.6, 5
LEAF_BYTES = 4_000_000
#: Text of a block: a task holds several arrays of eight bytes for each of its bytes.
BLOCK_BYTES = 4_000_000

OUT = "doc_id long, n_lines int, n_dropped int, text string, dropped array<int>"
_LAST = np.iinfo(np.int64).max
_STAR = np.uint64(0)
_ODD = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


class _Lines:
    """The lines with a word of a block, in order of doc_id and text: ``leaf`` and ``line`` are hashes."""

    def __init__(self, table: pa.Table):
        raw = table.column("doc_id").to_pylist()
        ids = [_LAST if i is None else i for i in raw]
        texts = [t or b"" for t in binary(table.column("text"))]
        order = sorted(range(len(ids)), key=lambda d: (ids[d], texts[d]))
        self.ids = np.array([ids[d] for d in order], np.int64)
        self.raw = [raw[d] for d in order]
        self.texts = [texts[d] for d in order]
        self.block = table.column("block")[0].as_py() if len(table) else 0
        words = Words(pa.array(self.texts, pa.large_binary()))
        digits = np.concatenate([[0], np.cumsum(words.data - np.uint8(48) < 10)])
        self.tokens = words.hashes() | np.uint64(1)
        self.tokens[digits[words.ends] > digits[words.starts]] = _STAR
        doc = np.repeat(np.arange(len(self.texts)), np.diff(words.first))
        breaks = np.concatenate([[0], np.cumsum(words.data == 10)])
        number = breaks[words.starts] - breaks[words.at[:-1]][doc]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (number[1:] != number[:-1])
        self.first = np.flatnonzero(new)
        self.size = np.diff(np.append(self.first, len(doc)))
        self.doc, self.number = doc[self.first], number[self.first].astype(np.int32)
        self.id = self.ids[self.doc]
        with np.errstate(over="ignore"):
            leaf = self.size.astype(np.uint64)
            for k in range(DEPTH):
                there = self.size > k
                leaf[there] = mix(leaf[there] + (self.tokens[self.first[there] + k] + np.uint64(k)) * _ODD[k])
        self.leaf = leaf.view(np.int64)
        self.line = words.runs(self.first, self.size, self.tokens).view(np.int64)

    def tokens_of(self, i: int) -> np.ndarray:
        return self.tokens[self.first[i] : self.first[i] + self.size[i]]


def _ends(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last place of each distinct key."""
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.argsort(keys, kind="stable")
    begins = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
    return order[begins], order[np.append(begins[1:], len(keys)) - 1]


def _leaves(table: pa.Table) -> pa.Table:
    """Leaves with the first and the last document that has a line there."""
    x = _Lines(table)
    a, b = _ends(x.leaf)
    return pa.table({"leaf": x.leaf[a], "block": np.full(len(a), x.block, np.int32), "first_doc": x.id[a], "last_doc": x.id[b]})


_DISTINCT = "line long, leaf long, block int, first_doc long, first_line int, last_doc long, tokens binary"


def _distinct(table: pa.Table, wanted: pa.Table) -> pa.Table:
    x = _Lines(table)
    at = np.flatnonzero(np.isin(x.leaf, wanted.column("leaf").to_numpy()))
    a, b = _ends(x.line[at])
    a, b = at[a], at[b]
    return pa.table(
        {
            "line": x.line[a], "leaf": x.leaf[a], "block": np.full(len(a), x.block, np.int32), "first_doc": x.id[a], "first_line": x.number[a],
            "last_doc": x.id[b], "tokens": pa.array([x.tokens_of(i).tobytes() for i in a], pa.binary()),
        }
    )


def _named(tokens: np.ndarray, constant: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of the templates of lines; line i has ``tokens[begins[i]:begins[i] + sizes[i]]``."""
    pos = np.arange(len(tokens)) - np.repeat(begins, sizes)
    tail = (pos >= DEPTH) & (tokens != _STAR)
    words = np.add.reduceat(tail.astype(np.int64), begins)
    fixed = np.add.reduceat((tail & constant).astype(np.int64), begins)
    general = (fixed >= TAIL) & (fixed >= CONSTANT * words)
    shown = np.where(constant | ~np.repeat(general, sizes), tokens, np.uint64(2))
    with np.errstate(over="ignore"):
        steps = mix(pos.astype(np.uint64) + np.uint64(1)) | np.uint64(1)
        # a line that is not generalised is its own template, whatever templates look alike
        return mix(np.add.reduceat(mix(shown) * steps, begins) + general.astype(np.uint64))


def _spread(keys: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each row, whether the rows of its key belong to two documents or more."""
    order = np.argsort(keys)
    begins = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
    several = np.minimum.reduceat(first[order], begins) != np.maximum.reduceat(last[order], begins)
    out = np.empty(len(keys), bool)
    out[order] = np.repeat(several, np.diff(np.append(begins, len(keys))))
    return out


def _templates(table: pa.Table) -> pa.Table:
    """``line, keep_doc, keep_line`` of the recurring lines of some whole leaves."""
    leaf, line, first, last, number = (table.column(c).to_numpy() for c in ("leaf", "line", "first_doc", "last_doc", "first_line"))
    raw = table.column("tokens").to_pylist()
    tokens, sizes = np.frombuffer(b"".join(raw), np.uint64), np.array([len(t) // 8 for t in raw])
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(len(line)), sizes)
    with np.errstate(over="ignore"):
        at = mix(leaf.view(np.uint64))[owner] + (np.arange(len(tokens)) - begins[owner]).astype(np.uint64)
        constant = _spread(mix(mix(at) + tokens), first[owner], last[owner])
        name = mix(_named(tokens, constant, begins, sizes) + leaf.view(np.uint64))
    recurs = _spread(name, first, last) & (np.bitwise_or.reduceat(tokens, begins) != _STAR)
    order = np.lexsort((number, first, name))
    heads = order[np.concatenate([[True], name[order][1:] != name[order][:-1]])]
    head = heads[np.searchsorted(name[heads], name[recurs])]
    return pa.table({"line": line[recurs], "keep_doc": first[head], "keep_line": number[head]})


_AT = "leaf long, line long, pos int, token long, first_doc long, last_doc long"


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each token of each line."""
    for batch in batches:
        for raw, *row in zip(*(batch.column(c).to_pylist() for c in ("tokens", "leaf", "line", "first_doc", "last_doc"))):
            tokens = np.frombuffer(raw, np.int64)
            leaf, line, first, last = (np.full(len(tokens), x) for x in row)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (leaf, line, np.arange(len(tokens), dtype=np.int32), tokens, first, last)], [x.split()[0] for x in _AT.split(", ")])


def _name_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``line, name, literal`` of lines with the places of their constant tokens."""
    for batch in batches:
        names, literal = [], []
        for raw, places in zip(batch.column("tokens").to_pylist(), batch.column("places").to_pylist()):
            tokens = np.frombuffer(raw, np.uint64)
            constant = np.zeros(len(tokens), bool)
            constant[places or []] = True
            names.append(int(_named(tokens, constant, np.zeros(1, np.int64), np.array([len(tokens)])).view(np.int64)[0]))
            literal.append(bool(tokens.any()))
        yield pa.RecordBatch.from_arrays([batch.column("line"), pa.array(names, pa.int64()), pa.array(literal, pa.bool_())], ["line", "name", "literal"])


def _wide_templates(lines: DataFrame) -> DataFrame:
    """What ``_templates`` gives, for leaves of any size: no leaf meets in one task."""
    at = lines.select("leaf", "line", "first_doc", "last_doc", "tokens").mapInArrow(_positions, _AT)
    spread = at.groupBy("leaf", "pos", "token").agg(F.min("first_doc").alias("a"), F.max("last_doc").alias("b")).filter("a <> b")
    places = at.join(spread.select("leaf", "pos", "token"), ["leaf", "pos", "token"]).groupBy("line").agg(F.collect_list("pos").alias("places"))
    named = lines.select("line", "tokens").join(places, "line", "left").mapInArrow(_name_each, "line long, name long, literal boolean")
    named = materialize(lines.drop("tokens").join(named, "line"), "named")
    found = named.groupBy("leaf", "name").agg(F.min("first_doc").alias("a"), F.max("last_doc").alias("b"), F.min(F.struct("first_doc", "first_line")).alias("head"))
    recurs = named.join(found.filter("a <> b"), ["leaf", "name"]).filter("literal")
    return recurs.select("line", F.col("head.first_doc").alias("keep_doc"), F.col("head.first_line").alias("keep_line"))


def _cut(table: pa.Table, drop: pa.Table) -> pa.Table:
    x = _Lines(table)
    gone = drop.column("line").to_numpy()
    order = np.argsort(gone)
    gone, keep_doc, keep_line = gone[order], drop.column("keep_doc").to_numpy()[order], drop.column("keep_line").to_numpy()[order]
    away = np.zeros(len(x.line), bool)
    if len(gone):
        at = np.minimum(np.searchsorted(gone, x.line), len(gone) - 1)
        away = (gone[at] == x.line) & ~((keep_doc[at] == x.id) & (keep_line[at] == x.number))
    dropped: dict[int, list[int]] = {}
    for d, k in zip(x.doc[away].tolist(), x.number[away].tolist()):
        dropped.setdefault(d, []).append(k)
    texts = list(x.texts)
    for d, lines in dropped.items():
        out = set(lines)
        texts[d] = b"\n".join([t for k, t in enumerate(texts[d].split(b"\n")) if k not in out])
    n = len(texts)
    return pa.table(
        {
            "doc_id": pa.array(x.raw, pa.int64()),
            "n_lines": np.bincount(x.doc, minlength=n).astype(np.int32),
            "n_dropped": np.bincount(x.doc[away], minlength=n).astype(np.int32),
            "text": pa.array(texts, pa.binary()).cast(pa.string()),
            "dropped": pa.array([dropped.get(d, []) for d in range(n)], pa.list_(pa.int32())),
        }
    )


def drop_recurring(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """``doc_id, n_lines, n_dropped, text, dropped`` for every document; ``dropped`` are line numbers."""
    dealt = with_block(docs, blocks or block_count(docs, BLOCK_BYTES), "doc_id", "text").groupBy("block")
    leaves = materialize(dealt.applyInArrow(_leaves, "leaf long, block int, first_doc long, last_doc long"), "leaves")
    often = leaves.groupBy("leaf").agg(F.min("first_doc").alias("a"), F.max("last_doc").alias("b")).filter("a <> b").select("leaf")
    wanted = leaves.join(often, "leaf").select("block", "leaf")
    lines = materialize(dealt.cogroup(wanted.groupBy("block")).applyInArrow(_distinct, _DISTINCT), "lines")
    whole = lines.groupBy("line", "leaf").agg(F.min(F.struct("first_doc", "first_line")).alias("place"), F.max("last_doc").alias("last_doc"), F.first("tokens").alias("tokens"))
    whole = materialize(whole.select("line", "leaf", "place.*", "last_doc", "tokens"), "distinct")
    placed = whole.join(whole.groupBy("leaf").agg(F.sum(F.octet_length("tokens")).alias("bytes")), "leaf")
    total = whole.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // LEAF_BYTES)
    narrow = placed.filter(F.col("bytes") <= LEAF_BYTES).withColumn("part", F.pmod(F.xxhash64("leaf"), F.lit(parts)))
    recurring = narrow.groupBy("part").applyInArrow(_templates, "line long, keep_doc long, keep_line int")
    wide = placed.filter(F.col("bytes") > LEAF_BYTES).drop("bytes")
    if wide.limit(1).count():
        recurring = recurring.union(_wide_templates(materialize(wide, "wide")))
    back = lines.select("line", "block").join(recurring, "line").select("block", "line", "keep_doc", "keep_line")
    return dealt.cogroup(back.groupBy("block")).applyInArrow(_cut, OUT)
