"""Helpers shared by the text operators: words, hashes, blocks and the shared folder.

A *word* is a maximal run of characters other than ASCII white space
(space and 0x09-0x0D). On UTF-8 bytes that is exactly what
``bytes.split()`` cuts, so tasks work on bytes and never decode.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE_CLASS = r"[\x20\x09-\x0D]"

_BASE = np.uint64(0x9E3779B97F4A7C15)


def word_count(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all run in one process."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


@contextmanager
def short_lived_shuffles(spark: SparkSession):
    """What runs inside leaves no shuffle files: Spark drops those of a query as it ends, not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage at files that survive the loss of any executor, and lets
    several consumers read a result without computing it again. The shuffles
    that made it are dropped. ``path`` may be one of ``new_path`` that nothing
    reads any more: what it holds is replaced.
    """
    spark = df.sparkSession
    path = path or new_path(spark, name)
    with short_lived_shuffles(spark):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, most: int = 10_000) -> DataFrame:
    """``df`` written once, and marked for broadcast if it has at most ``most`` rows; else joined by shuffle."""
    kept = materialize(df, "side")
    return F.broadcast(kept) if kept.count() <= most else kept


#: 64-bit words in a table of marks.
MARKS = 1 << 20


def marks(hashes: DataFrame) -> DataFrame:
    """A Bloom filter of the 64-bit hashes in the only column, for ``is_marked``: at most ``MARKS`` rows whatever the input."""
    h = hashes.columns[0]
    bits = hashes.select(F.expr(f"pmod(shiftrightunsigned(`{h}`, 6), {MARKS})").alias("mark_word"), F.expr(f"shiftleft(1L, cast(`{h}` & 63 as int))").alias("bit"))
    return F.broadcast(materialize(bits.groupBy("mark_word").agg(F.bit_or("bit").alias("mark_bits")), "marks"))


def is_marked(df: DataFrame, h: str, marked: DataFrame) -> DataFrame:
    """``df`` with a column ``is_marked``: true if the hash ``h`` is in ``marked``, and for a few others; no row is shuffled."""
    joined = df.join(marked, F.expr(f"pmod(shiftrightunsigned({h}, 6), {MARKS})") == F.col("mark_word"), "left")
    return joined.withColumn("is_marked", F.expr(f"coalesce(getbit(mark_bits, cast({h} & 63 as int)) = 1, false)")).drop("mark_word", "mark_bits")


def commonest(df: DataFrame, count: str, most: int) -> DataFrame:
    """The rows with the largest counts, at most ``most`` in all, so that collecting them is bounded at any input size.

    A histogram of the counts (exact below 1,024, then 64 bins for each factor
    e: some thousands of rows) gives the cut; of the bin that would exceed
    ``most``, rows are taken by the hash of all their columns.
    """
    c = F.col(count)
    bin_ = F.when(c < 1024, c.cast("long")).otherwise(1024 + F.floor(F.log(c / 1024.0) * 64)).cast("long")
    draw = F.pmod(F.xxhash64(*df.columns, F.lit(3)), F.lit(1 << 30))
    total, cut, share = 0, 0, 1.0
    for b, n in sorted(((r[0], r[1]) for r in df.groupBy(bin_.alias("b")).agg(F.count("*")).collect()), reverse=True):
        if total + n > most:
            # a margin of five standard deviations keeps the draw below the bound
            share = max(0.0, most - total - 5 * sqrt(most)) / n
            cut = b
            break
        total += n
        cut = b
    return df.filter((bin_ > cut) | ((bin_ == cut) & (draw < int(share * (1 << 30)))))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def block_count(docs: DataFrame, block_bytes: int = 8_000_000) -> int:
    """Blocks of about ``block_bytes`` of text, so that a task's memory stays flat as tables grow."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, ceil(total / block_bytes))


def with_block(docs: DataFrame, blocks: int, *by: str) -> DataFrame:
    """``(block, doc_id, text)``: rows alike in ``by`` (the doc_id) fall into one block; other columns are dropped."""
    return docs.select(
        F.pmod(F.xxhash64(*(by or ["doc_id"])), F.lit(blocks)).cast("int").alias("block"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    )


#: A random value for each byte; the second table folds A-Z into a-z.
_VALUES = np.random.default_rng(20).integers(0, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _VALUES.copy()
_FOLDED[65:91] = _VALUES[97:123]
_STEP = 0x9E3779B97F4A7C15
_SEGMENT = 1 << 16


class _Powers:
    """Powers of an odd step modulo 2^64, and of its inverse."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                for name, base in (("up", _STEP), ("down", pow(_STEP, -1, 1 << 64))):
                    steps = np.full(n, base, np.uint64)
                    steps[0] = 1
                    setattr(self, name, np.cumprod(steps))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


class Words:
    """The words of a batch of texts: places in ``data``, and ``first[i]:first[i + 1]`` are those of text i."""

    def __init__(self, column: pa.ChunkedArray | pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        column = column.cast(pa.large_binary())
        if column.null_count:
            column = column.fill_null(b"")
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        self.data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
        self.at = at - at[0]
        word = np.zeros(len(self.data) + 2, bool)
        word[1:-1] = (self.data != 32) & (self.data - np.uint8(9) > 4)
        starts, ends = word[1:] & ~word[:-1], word[:-1] & ~word[1:]
        # a text ends its last word even if the next text begins with one
        edge = self.at[1:-1]
        cut = edge[word[edge] & word[edge + 1]]
        starts[cut] = ends[cut] = True
        self.starts, self.ends = np.flatnonzero(starts), np.flatnonzero(ends)
        self.first = np.searchsorted(self.starts, self.at)

    def hashes(self, fold: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes; ``fold`` takes A-Z for a-z."""
        out = np.empty(len(self.starts), np.uint64)
        values = _FOLDED if fold else _VALUES
        lo = 0
        with np.errstate(over="ignore"):
            while lo < len(out):
                begin = self.starts[lo]
                hi = max(lo + 1, int(np.searchsorted(self.ends, begin + _SEGMENT, "right")))
                end = int(self.ends[hi - 1])
                up, down = _POWERS(end - begin + 1)
                total = np.zeros(end - begin + 1, np.uint64)
                np.cumsum(values[self.data[begin:end]] * up[:-1], out=total[1:])
                a, b = self.starts[lo:hi] - begin, self.ends[lo:hi] - begin
                out[lo:hi] = (total[b] - total[a]) * down[a] + (b - a).astype(np.uint64)
                lo = hi
            return mix(out)

    def runs(self, first: np.ndarray, sizes: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """A hash of each run of tokens ``tokens[first[i]:first[i] + sizes[i]]``."""
        up, down = _POWERS(len(tokens) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(tokens) + 1, np.uint64)
            np.cumsum(tokens * up[:-1], out=total[1:])
            return mix((total[first + sizes] - total[first]) * down[first] + sizes.astype(np.uint64))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def few_texts(batches: Iterator[pa.RecordBatch], most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes, or of one row."""
    for batch in batches:
        step = max(1, int(len(batch) * most / max(1, batch.nbytes)))
        for lo in range(0, len(batch), step):
            part = batch.slice(lo, step)
            if len(part) > 1 and part.nbytes > 2 * most:
                yield from few_texts(iter([part.slice(k, 1) for k in range(len(part))]), most)
            else:
                yield part


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def gram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k values: ``len(h) - k + 1`` results, built from runs of 1, 2, 4, ..."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    done, done_len, run, run_len, power = None, 0, h, 1, _BASE
    left = k
    with np.errstate(over="ignore"):
        while True:
            if left & 1:
                if done is None:
                    done, done_len = run, run_len
                else:
                    done = done[: len(run) - done_len] * power + run[done_len:]
                    done_len += run_len
            left >>= 1
            if not left:
                break
            run = run[: len(run) - run_len] * power + run[run_len:]
            run_len *= 2
            power = power * power
        return mix(done[:n])


def binary(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """The strings of a column as UTF-8 bytes."""
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def unsigned(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.asarray(column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()).astype(np.int64, copy=False).view(np.uint64)


def is_in(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Membership of ``values`` in the sorted array ``keys``."""
    if not len(keys):
        return np.zeros(len(values), bool)
    at = np.searchsorted(keys, values)
    at[at == len(keys)] = 0
    return keys[at] == values
