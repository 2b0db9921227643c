"""Benchmark decontamination by template canonicalisation.

Words become a template: numbers, names (a capitalised word inside a sentence)
and units after a number are replaced by typed placeholders; other words lose
their case and the marks around them. Windows of ``window`` template words
(the whole item where it is shorter) are hash-joined with the benchmark's.
A window opens with its word as it is, so that a passage pasted into the middle
of a sentence is found, and needs ``literals`` words besides placeholders; one
with fewer is compared word for word, without placeholders.

*Slots.* Matches of a document and an item on one diagonal are checked
together: equal slot values of the item must have equal values in the document
and the other way round. A copy passes trivially, a question with other numbers
or names passes if it was rewritten consistently, and text that merely shares a
pattern does not.

*Scale.* The benchmark is measured first. Up to ``CHUNK_WORDS`` words it goes to
all tasks as one hash table; a larger one is taken in chunks of that size, one
scan each. Documents are scanned as they lie and never shuffled.

Defined cases: a null or empty text matches nothing; items of fewer than
``shortest`` words are not searched for; equal items are all reported; on empty
tables the result is empty. Columns besides doc_id and text do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, gram_hash, is_in, mix, word_count

WINDOW = 13
LITERALS = 6
SHORTEST = 6
CHUNK_WORDS = 1_000_000

OUT = "doc_id long, item_id long, n_windows int, first_word int, last_word int, n_slots int, exact boolean"

# Units of measure.
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles mg g kg lb lbs oz ounce ounces pound pounds ton tons"
    " ml l liter liters litre litres gallon gallons s sec secs second seconds min mins minute minutes h hr hrs hour hours day days"
    " week weeks month months year years cent cents dollar dollars euro euros usd eur percent degree degrees meter meters metre"
    " metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms mph kmh hz khz mhz ghz kb mb gb tb watt watts".split()
)
_EDGE = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
_LITERAL, _TITLE, _NUMBER, _UNIT, _ENDS = 0, 1, 2, 3, 4
_SLOTS = {k: np.uint64(xxhash.xxh3_64_intdigest(f"<{k}>")) for k in ("name", "number", "unit")}


class _Tokens(dict):
    """A word's hash without case and edge marks; the low bits hold its class and whether it ends a sentence."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        bare = word.strip(_EDGE)
        low = bare.lower()
        if bare and bare.replace(b",", b"").replace(b".", b"").replace(b"/", b"").isdigit():
            kind = _NUMBER
        elif low in _UNIT_BYTES:
            kind = _UNIT
        elif len(bare) > 1 and bare[:1].isupper() and bare[1:].islower():
            kind = _TITLE
        else:
            kind = _LITERAL
        ends = _ENDS if word.rstrip(b"\"')]")[-1:] in (b".", b"!", b"?", b":") else 0
        v = self[word] = (xxhash.xxh3_64_intdigest(low) & ~7) | kind | ends
        return v


_UNIT_BYTES = frozenset(u.encode() for u in UNITS)
_TOKENS = _Tokens()


class Template:
    """Template words of a text: ``code`` with placeholders, ``plain`` without, ``slot`` where a placeholder stands."""

    def __init__(self, text: bytes | None):
        self.words = (text or b"").split()
        v = np.fromiter(map(_TOKENS.__getitem__, self.words), np.uint64, len(self.words))
        kind = (v & np.uint64(3)).astype(np.int8)
        opens = np.ones(len(v), bool)
        opens[1:] = (v[:-1] & np.uint64(4)) > 0
        number = kind == _NUMBER
        after = np.zeros(len(v), bool)
        after[1:] = number[:-1]
        name, unit = (kind == _TITLE) & ~opens, (kind == _UNIT) & after
        self.plain = v & ~np.uint64(7)
        self.code = np.where(number, _SLOTS["number"], np.where(name, _SLOTS["name"], np.where(unit, _SLOTS["unit"], self.plain)))
        self.slot = number | name | unit

    def windows(self, size: int, literals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and hashes of the windows, and which have too few words besides placeholders: those are hashed word for word."""
        n = len(self.words) - size + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool)
        with np.errstate(over="ignore"):
            h = mix(self.plain[:n] * np.uint64(0xD6E8FEB86659FD93) + gram_hash(self.code, size - 1)[1 : n + 1] + np.uint64(size))
            word = mix(gram_hash(self.plain, size) * np.uint64(0xA0761D6478BD642F) + np.uint64(size))
        filled = np.concatenate([[0], np.cumsum(self.slot)])
        sparse = size - (filled[size:] - filled[:-size]) < min(literals, size - 1)
        return np.arange(n), np.where(sparse, word, h), sparse


def consistent(pairs: list[tuple[int, int]]) -> bool:
    """Whether slot values map one to one."""
    there: dict[int, int] = {}
    back: dict[int, int] = {}
    return all(there.setdefault(a, b) == b and back.setdefault(b, a) == a for a, b in pairs)


class Benchmark:
    """Windows of the items by hash: what one task probes."""

    def __init__(self, items: list[tuple[int, bytes | None]], window: int, literals: int, shortest: int):
        self.literals = literals
        self.items: list[tuple[int, Template]] = []
        self.sizes: set[int] = set()
        found: dict[int, list[tuple[int, int, int]]] = {}
        for item_id, text in items:
            t = Template(text)
            size = min(window, len(t.words))
            if size < shortest:
                continue
            self.sizes.add(size)
            where = len(self.items)
            self.items.append((item_id, t))
            for p, h, _ in zip(*t.windows(size, literals)):
                found.setdefault(int(h), []).append((where, int(p), size))
        self.found = found
        self.keys = np.sort(np.fromiter(found, np.uint64, len(found)))

    def search(self, text: bytes | None) -> list[tuple[int, int, int, int, int, bool]]:
        """(item_id, windows, first word, end, slots, exact) for each item found in a text."""
        t = Template(text)
        lines: dict[tuple[int, int], set[tuple[int, int, bool]]] = {}
        for size in self.sizes:
            at, h, sparse = t.windows(size, self.literals)
            hit = is_in(h, self.keys)
            for p, x, verbatim in zip(at[hit], h[hit], sparse[hit]):
                for where, q, s in self.found[int(x)]:
                    if s == size:
                        lines.setdefault((where, int(p) - q), set()).add((int(p), int(p) + size, bool(verbatim)))
        best: dict[int, tuple] = {}
        for (where, shift), spans in lines.items():
            item = self.items[where][1]
            # windows found word for word stand even where others on the diagonal contradict each other
            for spans in (spans, {x for x in spans if x[2]}):  # noqa: B020, PLW2901
                covered = sorted({j for a, b, _ in spans for j in range(a, b)})
                slots = [(int(item.plain[j - shift]), int(t.plain[j])) for j in covered if t.slot[j] and item.slot[j - shift]]
                if not spans or not consistent(slots):
                    continue
                exact = all(a == b for a, b in slots)
                found = (len(spans), covered[0], covered[-1] + 1, len(slots), exact)
                if where not in best or found > best[where]:
                    best[where] = found
        return [(self.items[where][0], *found) for where, found in sorted(best.items())]


def _report(benchmark: Benchmark):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *found) for i, text in zip(batch.column("doc_id").to_pylist(), binary(batch.column("text"))) for found in benchmark.search(text)]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
            columns = list(zip(*rows)) if rows else [[] for _ in kinds]
            names = [x.split()[0] for x in OUT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


def _drop(benchmark: Benchmark):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [not benchmark.search(text) for text in binary(batch.column("text"))]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return run


def _chunks(benchmark: DataFrame, window: int, literals: int, shortest: int) -> Iterator[Benchmark]:
    total = benchmark.agg(F.sum(word_count(F.col("text")))).first()[0] or 0
    parts = max(1, ceil(total / CHUNK_WORDS))
    for i in range(parts):
        rows = benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i).select("item_id", "text").collect()
        yield Benchmark([(r[0], None if r[1] is None else r[1].encode()) for r in rows], window, literals, shortest)


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS, shortest: int = SHORTEST) -> DataFrame:
    """One row for each document and item found in it."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = [texts.mapInArrow(_report(b), OUT) for b in _chunks(benchmark, window, literals, shortest)]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS, shortest: int = SHORTEST) -> DataFrame:
    """The documents in which no item is found, with their columns as they are."""
    for b in _chunks(benchmark, window, literals, shortest):
        docs = docs.mapInArrow(_drop(b), docs.schema)
    return docs
