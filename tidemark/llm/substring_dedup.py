"""Substring dedup: seed on winnowed anchors, extend both ways, keep maximal repeats.

Words of a window of ``length`` consecutive words go when the same word
sequence starts earlier (smaller doc_id, or earlier in the same document).

*Seed.* In each window the smallest hash among its ``anchor``-word grams is the
window's anchor. Equal windows choose equal anchors, so a window can only
repeat if its anchor does; about one gram in seven is an anchor. Anchors that
occur once in the corpus end here.

*Extend.* Around each anchor that occurs again, every window that chose it (up
to ``length - anchor`` words to the left and to the right) is compared by its
hash with the windows of the other occurrences: by 64 bits inside a block, by 128
bits across blocks. Consecutive windows that repeat form the maximal repeats,
each ``length`` words or more.

*Scale.* Documents are dealt once into blocks by doc_id. A block settles the
repeats inside it and sends one row per distinct anchor or window, so a
passage that a third of all documents share costs one row per block and never
meets in one task. No pairs are made. The three passes read the same exchange.

Defined cases: a null or short text keeps all its words; a null doc_id counts
as the largest; rows that repeat a doc_id are compared like one document whose
equal positions do not precede each other; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, block_count, binary, gram_hash, is_in, mix, signed, unsigned, with_block

_LAST = np.iinfo(np.int64).max
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)

OUT = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:int,end:int>>"


class _Block:
    """Word hashes of the documents of one block, in order of doc_id."""

    def __init__(self, table: pa.Table, length: int, anchor: int):
        ids = table.column("doc_id").to_pylist()
        texts = binary(table.column("text"))
        self.order = sorted(range(len(ids)), key=lambda i: (_LAST if ids[i] is None else ids[i], texts[i] or b""))
        self.ids = [ids[i] for i in self.order]
        self.texts = [texts[i] or b"" for i in self.order]
        words = Words(pa.array(self.texts, pa.large_binary()))
        self.words, self.starts = words.hashes(), words.first
        self.counts = np.diff(self.starts)
        self.length, self.anchor = length, anchor
        # positions at which a window fits into its document
        room = np.maximum(self.counts - length + 1, 0)
        first = np.repeat(self.starts[:-1], room)
        self.doc = np.repeat(np.arange(len(room)), room)
        self.pos = np.arange(len(first)) - np.repeat(np.cumsum(room) - room, room)
        self.at = first + self.pos
        self.id_of = np.array([_LAST if i is None else i for i in self.ids], np.int64)

    def windows(self) -> np.ndarray:
        grams = gram_hash(self.words, self.length)
        return grams[self.at] if len(self.at) else np.empty(0, np.uint64)

    def checks(self, at: np.ndarray) -> np.ndarray:
        """A second hash of the windows that start at these places."""
        return gram_hash(mix(self.words + _SECOND), self.length)[at] if len(at) else np.empty(0, np.uint64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """For each window the place and the hash of its anchor."""
        if not len(self.at):
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        grams = gram_hash(self.words, self.anchor)
        view = np.lib.stride_tricks.sliding_window_view(grams, self.length - self.anchor + 1)
        place = view.argmin(axis=1)[self.at] + self.at
        return place, grams[place]


def _seeds(length: int, anchor: int):
    def run(table: pa.Table) -> pa.Table:
        block = _Block(table, length, anchor)
        place, _ = block.anchors()
        grams = gram_hash(block.words, anchor)
        keys, n = np.unique(grams[np.unique(place)], return_counts=True) if len(place) else (np.empty(0, np.uint64), np.empty(0, np.int64))
        where = table.column("block")[0].as_py()
        return pa.table({"anchor": signed(keys), "block": pa.array(np.full(len(keys), where, np.int32)), "n": pa.array(np.minimum(n, 2).astype(np.int32))})

    return run


def _extend(length: int, anchor: int):
    def run(table: pa.Table, shared: pa.Table) -> pa.Table:
        block = _Block(table, length, anchor)
        _, keys = block.anchors()
        chosen = np.flatnonzero(is_in(keys, np.sort(unsigned(shared.column("anchor")))))
        windows, first = np.unique(block.windows()[chosen], return_index=True)
        where = table.column("block")[0].as_py() if len(table) else 0
        ids = block.id_of[block.doc[chosen[first]]] if len(first) else np.empty(0, np.int64)
        check = block.checks(block.at[chosen[first]])
        return pa.table({"seq": signed(windows), "check": signed(check), "block": pa.array(np.full(len(windows), where, np.int32)), "first_id": pa.array(ids)})

    return run


def _cut(length: int, anchor: int):
    def run(table: pa.Table, earlier: pa.Table) -> pa.Table:
        block = _Block(table, length, anchor)
        windows = block.windows()
        covered = np.zeros(len(block.words) + 1, np.int64)
        if len(windows):
            _, first, inverse = np.unique(windows, return_index=True, return_inverse=True)
            one = first[inverse]
            repeat = (block.id_of[block.doc] != block.id_of[block.doc[one]]) | (block.pos != block.pos[one])
            repeat |= is_in(windows, np.sort(unsigned(earlier.column("seq"))))
            at = block.at[repeat]
            np.add.at(covered, at, 1)
            np.add.at(covered, at + length, -1)
        gone = np.cumsum(covered)[:-1] > 0
        kept, removed, spans = [], [], []
        for i, text in enumerate(block.texts):
            mine = gone[block.starts[i] : block.starts[i + 1]]
            n = int(mine.sum())
            words = text.split()
            removed.append(n)
            if n:
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mine.astype(np.int8), [0]])))
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])])
                words = [words[j] for j in np.flatnonzero(~mine)]
            else:
                spans.append([])
            kept.append(b" ".join(words))
        return pa.table(
            {
                "doc_id": pa.array(block.ids, pa.int64()),
                "n_words": pa.array(block.counts),
                "n_removed": pa.array(removed, pa.int64()),
                "kept": pa.array(kept, pa.binary()).cast(pa.string()),
                "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            }
        )

    return run


def remove_repeats(docs: DataFrame, length: int = 20, anchor: int = 8, blocks: int | None = None) -> DataFrame:
    """Documents without the words of windows that occur earlier: ``doc_id, n_words, n_removed, kept, spans``.

    ``kept`` joins the kept words by one space; ``spans`` are the maximal
    repeats removed, in words, end exclusive.
    """
    if not 0 < anchor <= length:
        raise ValueError("anchor must be between 1 and length")
    dealt = with_block(docs, blocks or block_count(docs)).groupBy("block")
    seeds = dealt.applyInArrow(_seeds(length, anchor), "anchor long, block int, n int")
    again = seeds.withColumn("n", F.sum("n").over(Window.partitionBy("anchor"))).filter("n > 1").select("block", "anchor")
    windows = dealt.cogroup(again.groupBy("block")).applyInArrow(_extend(length, anchor), "seq long, check long, block int, first_id long")
    earlier = (
        windows.withColumn("least", F.min("first_id").over(Window.partitionBy("seq", "check")))
        .filter("first_id > least")
        .select("block", "seq")
    )
    return dealt.cogroup(earlier.groupBy("block")).applyInArrow(_cut(length, anchor), OUT)
