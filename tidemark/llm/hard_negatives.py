"""Hard negatives by angular triangle filtering.

Some reference directions are fixed. Every row keeps its norm and its angles to
the references. For an anchor and a row, each reference bounds the angle between
them: it is at least the difference of their angles to the reference and at most
the sum (or what is left of a full turn). The cosines of the bounds times both
norms, widened for rounding, bound the score. Only where these bounds meet a
window of scores that is looked for, integer scores are computed: first for tiles
of rows by the tiles' ranges of angles, then for the rows of a tile.

Two searches run so: an anchor's positives (rows of its label that may exceed the
fifth best score known) and its negatives (rows of other labels whose score may
lie in a window ``80 * positive <= 100 * score <= 100 * positive``).

*Scale.* Rows are dealt to blocks of at most 65,536 by their nearest reference,
and by row where one cell holds more; inside a block they lie by label and angle.
Anchors meet blocks in groups of at most 65,536, so a task holds one block and
one group, and gives at most five rows for an anchor and window. Scores are whole
numbers: doubles multiply them exactly below 2^53, else Python's integers do.

The references are chosen from ``SAMPLE`` rows at most, picked by hash (each next
one is farthest in angle from those before); the first threshold of an anchor is
its fifth score in that sample. Neither changes a result.

Defined cases: rows with a null label or vector, or a null or non-finite
component take no part; a shorter vector counts as padded by zeros; an anchor's
other rows are all rows but itself, so a repeated row is one of them; ties go to
the smaller vec_id, null last, and equal rows keep any order; a row with a null
vec_id is no anchor but may be found; components and scores beyond the range of
a long are cut to it; very long vectors are used whole; an anchor without rows of its label gives nothing; other columns may have
any name and are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SAMPLE = 2_048
REFERENCES = 16
#: Rows of one label that are bounded together, rows of a block, and anchors that meet it at a time.
TILE = 512
BLOCK_ROWS = 65_536
ANCHORS = 65_536
#: Angles are kept as 32-bit floats; bounds are widened by this much.
SLACK = 2e-6
_LIMIT = 1 << 63
_INT_LIMIT = float(1 << 53)

ROW = "row long, vec_id long, label long, vec binary, norm double, angles binary, cell int"


def whole(column: pa.Array) -> list[np.ndarray]:
    """Each vector's components as whole numbers, ``floor(256 * x)``."""
    return [floored(v) for v in column.to_pylist()]


def floored(vector: list[float]) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(256.0 * np.array(vector, np.float64)), -float(_LIMIT), float(_LIMIT))


def padded(vectors: list[np.ndarray], width: int = 0) -> np.ndarray:
    out = np.zeros((len(vectors), max([width, *map(len, vectors)], default=width)))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def lengths(x: np.ndarray) -> np.ndarray:
    """Norms, without overflow."""
    top = np.abs(x).max(axis=1, initial=0.0)
    safe = np.where(top > 0, top, 1.0)
    return top * np.sqrt(((x / safe[:, None]) ** 2).sum(axis=1))


def angles(x: np.ndarray, norms: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angle of each row to each reference (unit vectors); a right angle for a zero vector."""
    wide = max(x.shape[1], references.shape[1])
    unit = np.pad(x, ((0, 0), (0, wide - x.shape[1]))) / np.where(norms > 0, norms, 1.0)[:, None]
    return np.arccos(np.clip(unit @ np.pad(references, ((0, 0), (0, wide - references.shape[1]))).T, -1.0, 1.0))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole vectors, as int64 cut to its range."""
    wide = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (a, b))
    if lengths(a).max(initial=0.0) * lengths(b).max(initial=0.0) < _INT_LIMIT / 4 and wide < 1 << 40:
        return np.rint(a @ b.T).astype(np.int64)
    exact = np.array([[int(v) for v in r] for r in a], object).reshape(a.shape) @ np.array([[int(v) for v in r] for r in b], object).reshape(b.shape).T
    return np.clip(exact, -_LIMIT, _LIMIT - 1).astype(np.int64) if exact.size else np.zeros(exact.shape, np.int64)


def choose(sample: np.ndarray, count: int) -> np.ndarray:
    """Unit vectors of at most ``count`` rows, each the farthest in angle from those before it."""
    norms = lengths(sample)
    unit = sample[norms > 0] / norms[norms > 0][:, None]
    if not len(unit):
        return np.ones((1, max(1, sample.shape[1]))) / np.sqrt(max(1, sample.shape[1]))
    picked, near = [0], unit @ unit[0]
    while len(picked) < min(count, len(unit)):
        k = int(near.argmin())
        if near[k] > 1 - 1e-12:
            break
        picked.append(k)
        near = np.maximum(near, unit @ unit[k])
    return unit[picked]


def _place(references: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = whole(batch.column("embedding"))
            x = padded(vectors)
            norms = lengths(x)
            turn = angles(x, norms, references)
            yield pa.record_batch(
                {
                    "vec_id": batch.column("vec_id"),
                    "label": batch.column("label"),
                    "vec": pa.array([v.tobytes() for v in vectors], pa.binary()),
                    "norm": pa.array(norms),
                    "angles": pa.array([t.tobytes() for t in turn.astype(np.float32)], pa.binary()),
                    "cell": pa.array(turn.argmin(axis=1).astype(np.int32)),
                }
            )

    return run


class _Rows:
    """Rows of a block or anchors of a group, as arrays."""

    def __init__(self, table: pa.Table, by_angle: bool = False):
        self.row = table.column("row").to_numpy()
        ids = table.column("vec_id")
        self.known = ~np.asarray(ids.is_null().to_numpy(), bool) if len(ids) else np.empty(0, bool)
        self.vec_id = ids.fill_null(0).to_numpy()
        self.label = table.column("label").to_numpy()
        self.norm = table.column("norm").to_numpy()
        self.x = padded([np.frombuffer(v, np.float64) for v in table.column("vec").to_pylist()])
        self.turn = np.array([np.frombuffer(v, np.float32) for v in table.column("angles").to_pylist()], np.float64)
        if by_angle and len(self.row):
            own = self.turn[np.arange(len(self.row)), table.column("cell").to_numpy()]
            order = np.lexsort((own, self.label))
            for name in ("row", "known", "vec_id", "label", "norm", "x", "turn"):
                setattr(self, name, getattr(self, name)[order])

    def tiles(self) -> Iterator[slice]:
        """Runs of rows of one label, at most TILE long."""
        edges = np.flatnonzero(np.diff(self.label)) + 1
        for lo, hi in zip([0, *edges], [*edges, len(self.row)]):
            for at in range(lo, hi, TILE):
                yield slice(at, min(at + TILE, hi))


def tile_bounds(turn: np.ndarray, norm: np.ndarray, rows: _Rows, tile: slice) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score that each anchor can have with any row of a tile."""
    lo, hi = rows.turn[tile].min(axis=0), rows.turn[tile].max(axis=0)
    least = np.maximum(np.maximum(turn - hi, lo - turn), 0.0).max(axis=1) - SLACK
    most = np.minimum(turn + hi, 2 * np.pi - turn - lo).min(axis=1) + SLACK
    small, large = rows.norm[tile].min(), rows.norm[tile].max()
    return _between(least, most, norm, small, large)


def row_bounds(turn: np.ndarray, norm: np.ndarray, rows: _Rows, tile: slice) -> tuple[np.ndarray, np.ndarray]:
    """The same for each row of a tile, by the two references that spread its rows and its anchors most."""
    own = rows.turn[tile]
    best = np.argsort(-(own.std(axis=0) + turn.std(axis=0)))[:2]
    least = np.zeros((len(turn), len(own)))
    most = np.full(least.shape, np.pi)
    for r in best:
        a, b = turn[:, r][:, None], own[:, r][None, :]
        np.maximum(least, np.abs(a - b), out=least)
        np.minimum(most, np.minimum(a + b, 2 * np.pi - a - b), out=most)
    return _between(least - SLACK, most + SLACK, norm[:, None], rows.norm[tile][None, :], rows.norm[tile][None, :])


def _between(least, most, norm, small, large) -> tuple[np.ndarray, np.ndarray]:
    high, low = np.cos(np.clip(least, 0.0, np.pi)), np.cos(np.clip(most, 0.0, np.pi))
    edge = norm * large * 1e-9 + 1.0
    down, up = norm * np.minimum(low * small, low * large) - edge, norm * np.maximum(high * small, high * large) + edge
    # as scores are cut
    return np.clip(down, -float(_LIMIT), float(_LIMIT)), np.clip(up, -float(_LIMIT), float(_LIMIT))


def _best(parts: list[tuple], most: int) -> tuple[np.ndarray, ...]:
    """Of ``(key, score, known, vec_id, row)`` the first ``most`` of each key: by score down, then vec_id, unknown last."""
    key, score, known, vec_id, row = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((row, vec_id, ~known, ~score, key))
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    rank = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
    keep = order[rank < most]
    return tuple(x[keep] for x in (np.concatenate(p) for p in zip(*parts)))


def _output(name: str, parts: list[tuple], most: int, extra: dict) -> pa.Table:
    none = np.empty(0, np.int64)
    key, score, known, vec_id, row = _best(parts, most) if parts else (none, none, none.astype(bool), none, none)
    out = {c: pa.array(v[key]) for c, v in extra.items()}
    return pa.table(out | {f"{name}_id": pa.array(vec_id, mask=~known), f"{name}_score": pa.array(score), f"{name}_row": pa.array(row)})


def _positives(most: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not len(rows) or not len(anchors):
            return _output("positive", [], most, {"anchor": np.empty(0, np.int64)})
        found, ask = _Rows(rows, by_angle=True), _Rows(anchors)
        need = anchors.column("need").fill_null(-_LIMIT).to_numpy()
        parts = []
        for tile in found.tiles():
            same = np.flatnonzero(ask.label == found.label[tile.start])
            low, high = tile_bounds(ask.turn[same], ask.norm[same], found, tile)
            same = same[high >= need[same]]
            if not len(same):
                continue
            _, high = row_bounds(ask.turn[same], ask.norm[same], found, tile)
            may = high >= need[same][:, None]
            may &= ask.row[same][:, None] != found.row[tile][None, :]
            parts += _scored(ask, same, found, tile, may, lambda s, i: s >= need[i][:, None], same)
            if sum(len(p[0]) for p in parts) > 1_000_000:
                parts = [_best(parts, most)]
        return _output("positive", parts, most, {"anchor": ask.row})

    return run


def _scored(ask, chosen, found, tile, may, wanted, keys) -> list[tuple]:
    """Integer scores of the anchors and rows that have a pair in ``may``; the wanted pairs."""
    a, b = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
    if not len(a):
        return []
    at = b + tile.start
    s = scores(ask.x[chosen[a]], found.x[at])
    i, j = np.nonzero(may[np.ix_(a, b)] & wanted(s, chosen[a]))
    return [(keys[a[i]], s[i, j], found.known[at[j]], found.vec_id[at[j]], found.row[at[j]])]


def _negatives(most: int, low: int, high: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not len(rows) or not len(anchors):
            return _output("negative", [], most, {"anchor": np.empty(0, np.int64), "k": np.empty(0, np.int32)})
        found, ask = _Rows(rows, by_angle=True), _Rows(anchors)
        score, k = anchors.column("positive_score").to_numpy(), anchors.column("k").to_numpy()
        # windows in exact integers: the least and largest score
        least = np.array([-(-low * int(p) // high) for p in score], object)
        fits = np.array([lo <= int(p) for lo, p in zip(least, score)], bool)
        least = np.array([min(int(x), _LIMIT - 1) if f else _LIMIT - 1 for x, f in zip(least, fits)], np.int64)
        floor = least.copy()
        parts = []
        for tile in found.tiles():
            other = np.flatnonzero((ask.label != found.label[tile.start]) & fits)
            down, up = tile_bounds(ask.turn[other], ask.norm[other], found, tile)
            other = other[(up >= floor[other]) & (down <= score[other])]
            if not len(other):
                continue
            down, up = row_bounds(ask.turn[other], ask.norm[other], found, tile)
            may = (up >= floor[other][:, None]) & (down <= score[other][:, None])
            parts += _scored(ask, other, found, tile, may, lambda s, i: (s >= floor[i][:, None]) & (s <= score[i][:, None]), other)
            if sum(len(p[0]) for p in parts) > 200_000:
                parts = [_best(parts, most)]
                keys, n = np.unique(parts[0][0], return_counts=True)
                last = np.cumsum(n)[n == most] - 1
                floor[keys[n == most]] = parts[0][1][last]
        return _output("negative", parts, most, {"anchor": ask.row, "k": k})

    return run


def mine(
    vectors: DataFrame, anchors: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, references: int = REFERENCES, block_rows: int = BLOCK_ROWS, anchor_rows: int = ANCHORS
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank`` of ``vectors(vec_id, embedding, label)``.

    Anchors are the rows whose vec_id is divisible by ``anchors``; a negative's
    score lies between ``low / high`` of the positive's and the positive's.
    """
    spark = vectors.sparkSession
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    used = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")
    ).filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    sample = used.orderBy(F.xxhash64("vec_id", "embedding"), "vec_id").limit(SAMPLE).collect()
    held = padded([floored(r["embedding"]) for r in sample])
    chosen = choose(held, references)
    known = (held, np.array([r["label"] for r in sample], np.int64), np.array([-1 if r["vec_id"] is None else r["vec_id"] for r in sample], np.int64))

    placed = used.mapInArrow(_place(chosen), ROW.split(", ", 1)[1])
    placed = materialize(placed.select(F.monotonically_increasing_id().alias("row"), "*"), "placed")
    cells = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most REFERENCES rows
    block = max(TILE, min(block_rows, sum(cells.values()) // 48))
    starts, total = [], 0
    for c in range(len(chosen)):
        n = max(1, ceil(cells.get(c, 0) / block))
        starts.append((c, total, n))
        total += n
    plan = F.broadcast(spark.createDataFrame(starts, "cell int, first int, parts int"))

    ask = placed.filter(F.col("vec_id").isNotNull() & (F.col("vec_id") % anchors == 0))
    asked = materialize(ask.mapInArrow(_thresholds(known, positives), ROW + ", need long"), "anchors")
    teams = max(1, ceil(asked.count() / anchor_rows))
    team = F.pmod(F.xxhash64("row"), F.lit(teams)).cast("int")
    place = (F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts"))).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(teams - 1)))
    rows = placed.join(plan, "cell").select("row", "vec_id", "label", "vec", "norm", "angles", "cell", place.alias("block"), every.alias("team")).groupBy("block", "team")
    over = F.explode(F.sequence(F.lit(0), F.lit(total - 1)))

    def first(found: DataFrame, name: str, most: int, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc(f"{name}_score"), F.asc_nulls_last(f"{name}_id"), f"{name}_row")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)

    met = asked.select("*", team.alias("team"), over.alias("block")).groupBy("block", "team")
    near = rows.cogroup(met).applyInArrow(_positives(positives), "anchor long, positive_id long, positive_score long, positive_row long")
    near = materialize(first(near, "positive", positives, "anchor").withColumnRenamed("rank", "k").drop("positive_row"), "positives")

    windows = asked.drop("need").join(near.select(F.col("anchor").alias("row"), "k", "positive_score"), "row")
    met = windows.select("*", team.alias("team"), over.alias("block")).groupBy("block", "team")
    hard = rows.cogroup(met).applyInArrow(_negatives(negatives, low, high), "anchor long, k int, negative_id long, negative_score long, negative_row long")
    hard = first(hard, "negative", negatives, "anchor", "k")
    ids = asked.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return hard.join(near, ["anchor", "k"]).join(ids, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score", F.col("k").alias("positive_rank")
    )


def _thresholds(known: tuple, most: int):
    """Each anchor with a score that its last positive reaches at least: the one of that rank in the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, labels, ids = known
        for batch in batches:
            rows = _Rows(pa.Table.from_batches([batch]))
            need = []
            for lo in range(0, len(batch), 1024):
                s = scores(rows.x[lo : lo + 1024], held)
                for i in range(len(s)):
                    mine = np.sort(s[i][(labels == rows.label[lo + i]) & (ids != rows.vec_id[lo + i])])
                    need.append(int(mine[-most]) if len(mine) >= most else None)
            yield pa.record_batch([*batch.columns, pa.array(need, pa.int64())], names=[*batch.schema.names, "need"])

    return run
