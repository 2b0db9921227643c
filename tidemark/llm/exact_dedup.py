"""Exact duplicates by counting quotient filters and byte verification.

Every text has a 64-bit fingerprint. A task builds a counting quotient filter of
the fingerprints of its rows: a fingerprint's upper bits are its quotient, which
picks a run of slots; the rest is its remainder, kept in order within the run,
with a count. A quotient and a remainder give the fingerprint back, so filters of
any sizes merge without loss by their sorted remainders. Filters travel in
segments of the range of fingerprints, and a task merges one segment. Only
fingerprints with a count above one matter after that: their documents are
compared byte by byte. All other documents are known to be single.

*Scale.* Documents are scanned twice. The first scan moves fingerprints, in
filters: a text that a third of all rows share is one slot a task. The second
marks the documents whose fingerprint recurs; their texts alone are written, and
equal ones are counted before they are shuffled, so a hot text moves once a task.
Rows find their class by fingerprint; texts are joined only where texts of one
fingerprint differ. The recurring fingerprints are broadcast while there are at
most a million, and joined by shuffle beyond.

Defined cases: a null text counts as empty, and empty texts are equal; of equal
texts the row with the largest doc_id stays, a null doc_id is the smallest, and
of rows with one doc_id and one text a single one stays; very long texts are
compared whole; other columns may have any name and are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, signed, small_side, unsigned

#: Fingerprints that a task holds before it ends a filter, and those of a segment on average.
FILTER_ROWS = 2_000_000
SEGMENT_ROWS = 200_000
#: Recurring fingerprints that may be broadcast (8 bytes each).
BROADCAST_ROWS = 1_000_000


class QuotientFilter:
    """Counts of ``width``-bit fingerprints: for each quotient the length of its run, then sorted remainders and their counts."""

    def __init__(self, width: int, quotient_bits: int, runs: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.width, self.quotient_bits = width, quotient_bits
        self.runs, self.remainders, self.counts = runs, remainders, counts

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray, width: int) -> QuotientFilter:
        """From distinct sorted fingerprints below ``2 ** width``: about one slot a fingerprint."""
        bits = min(width, max(0, len(fingerprints) - 1).bit_length())
        remainder_bits = width - bits
        quotient = _shift(fingerprints, remainder_bits)
        remainder = fingerprints if not bits else fingerprints & np.uint64((1 << remainder_bits) - 1)
        runs = np.bincount(quotient.astype(np.int64), minlength=1 << bits)
        return cls(width, bits, runs, remainder, counts)

    def fingerprints(self) -> np.ndarray:
        """The fingerprints, in order."""
        quotient = np.repeat(np.arange(len(self.runs), dtype=np.uint64), self.runs)
        bits = self.width - self.quotient_bits
        return self.remainders | (quotient << np.uint64(bits) if bits < 64 else np.uint64(0))

    def pack(self) -> bytes:
        """Header, runs, remainders in as many bytes as they need, counts."""
        size = (self.width - self.quotient_bits + 7) // 8
        low = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]
        head = np.array([self.width, self.quotient_bits, len(self.remainders)], "<i8")
        return b"".join([head.tobytes(), self.runs.astype("<u4").tobytes(), low.tobytes(), self.counts.astype("<i8").tobytes()])

    @classmethod
    def unpack(cls, data: bytes) -> QuotientFilter:
        width, bits, n = (int(x) for x in np.frombuffer(data, "<i8", 3))
        size, at = (width - bits + 7) // 8, 24
        runs = np.frombuffer(data, "<u4", 1 << bits, at).astype(np.int64)
        at += 4 << bits
        remainders = np.zeros((n, 8), np.uint8)
        remainders[:, :size] = np.frombuffer(data, np.uint8, n * size, at).reshape(n, size)
        return cls(width, bits, runs, remainders.view("<u8").ravel().astype(np.uint64), np.frombuffer(data, "<i8", n, at + n * size))

    @classmethod
    def merged(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        """One filter with the sums of the counts."""
        found, counts = _summed(np.concatenate([f.fingerprints() for f in filters]), np.concatenate([f.counts for f in filters]))
        return cls.of(found, counts, filters[0].width)


def _shift(values: np.ndarray, bits: int) -> np.ndarray:
    return values >> np.uint64(bits) if bits < 64 else np.zeros_like(values)


def _summed(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, with the sums of their counts; sorted pieces merge in linear time."""
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)
    return values[first], np.add.reduceat(counts, first) if len(first) else counts


def _filters(segment_bits: int):
    """Filters of a task's fingerprints, cut by segment."""
    width = 64 - segment_bits

    def cut(parts: list[np.ndarray]) -> pa.RecordBatch:
        values = np.concatenate(parts)
        found, counts = _summed(values, np.ones(len(values), np.int64))
        segment = _shift(found, width).astype(np.int64)
        inside = found & np.uint64((1 << width) - 1)
        keys, first = np.unique(segment, return_index=True)
        ends = np.append(first[1:], len(found))
        packed = [QuotientFilter.of(inside[a:b], counts[a:b], width).pack() for a, b in zip(first, ends)]
        return pa.record_batch({"segment": pa.array(keys.astype(np.int64)), "filter": pa.array(packed, pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            parts.append(unsigned(batch.column("fp")))
            held += len(batch)
            if held >= FILTER_ROWS:
                yield cut(parts)
                parts, held = [], 0
        if held:
            yield cut(parts)

    return run


def _merge(table: pa.Table) -> pa.Table:
    """The fingerprints of a segment that occur more than once."""
    filters = [QuotientFilter.unpack(x) for x in table.column("filter").to_pylist()]
    whole = QuotientFilter.merged(filters)
    often = whole.counts > 1
    segment = np.uint64(table.column("segment")[0].as_py())
    high = segment << np.uint64(whole.width) if whole.width < 64 else np.uint64(0)
    return pa.table({"fp": signed((whole.fingerprints()[often] | high).astype(np.uint64)), "copies": pa.array(whole.counts[often])})


def recurring(fingerprints: DataFrame, rows: int) -> DataFrame:
    """``fp, copies`` of the values of column ``fp`` that occur more than once, by merged filters; ``rows`` sets the number of segments."""
    segment_bits = max(0, (max(1, rows) // SEGMENT_ROWS).bit_length())
    pieces = fingerprints.select("fp").mapInArrow(_filters(segment_bits), "segment long, filter binary")
    return pieces.groupBy("segment").applyInArrow(_merge, "fp long, copies long")


def groups(docs: DataFrame, bits: int = 64, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row. ``bits`` shortens fingerprints, for tests of collisions."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    fingerprint = F.xxhash64(text) if bits == 64 else F.shiftrightunsigned(F.xxhash64(text), 64 - bits)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    slim = slim.withColumn("fp", fingerprint)
    again = small_side(recurring(slim, docs.count()).select("fp", F.lit(True).alias("again")), broadcast_rows)
    marked = materialize(
        slim.join(again, "fp", "left").select(
            F.monotonically_increasing_id().alias("row"), "doc_id", "fp", F.sha2("text", 256).alias("text_sha256"), F.when(F.col("again"), F.col("text")).alias("text")
        ),
        "marked",
    )
    single = marked.filter("text is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    some = marked.filter("text is not null")
    # equal bytes, not equal fingerprints, make a class
    classes = materialize(some.groupBy("fp", "text").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row")).alias("keep")), "classes")
    clash = materialize(classes.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select("fp"), "clashes")

    def known(rows: DataFrame, found: DataFrame, *by: str) -> DataFrame:
        return rows.join(found, list(by)).select(
            "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256"
        )

    if clash.isEmpty():
        return single.union(known(some.drop("text"), small_side(classes.drop("text"), broadcast_rows // 4), "fp"))
    # texts of one fingerprint differ: these are told apart by their bytes
    plain = known(some.drop("text").join(clash, "fp", "left_anti"), classes.drop("text").join(clash, "fp", "left_anti"), "fp")
    odd = known(some.join(clash, "fp", "left_semi"), classes.join(clash, "fp", "left_semi"), "fp", "text")
    return single.union(plain).union(odd)


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that stay, as ``doc_id, text_sha256, group_size``."""
    return groups(docs).filter("kept").select("doc_id", "text_sha256", "group_size")
