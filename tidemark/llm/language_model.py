"""Scoring documents with a gated recurrent language model.

*Counts.* Words of all training documents (crc32 of the doc_id as text, modulo
10, is not 0), lower-cased in A-Z, and one end per document, are counted by
Spark over the whole corpus. They give the base score and the vocabulary.

*Model.* A gated recurrent unit reads one token at a time; its output layer is
factored: a softmax over classes, then over the words of a class. The commonest
``HEAD`` words stand in classes of ``WIDTH`` by rank. Every other word belongs to
one of ``TAILS`` classes by its last two bytes, in which its probability is its
smoothed share of the class by the counts; each such class keeps room for one
unseen word. So every word has a probability, and known words sum to at most 1.

*Training.* Truncated backpropagation in numpy over every training document, at
every size, with the state carried from window to window. Documents are dealt by hash
to replicas of about ``REPLICA_BYTES`` of text each, however many tasks there are;
a replica trains in pieces of at most ``PIECE`` tokens, and Spark averages the
replicas' weights by their tokens (as whole numbers, so that the order of the
sum does not matter). So scores do not depend on how the table is partitioned.

*Scoring.* A task packs whole documents into lanes, carries the state through
each document from its first to its last word, and adds up log10 P. Counts of
the ``KNOWN`` commonest words go to the tasks (a bounded table); rarer words
are joined with the counts by a shuffle, so every count is exact. Words are
known by 64 bits: 59 of their hash and the class.

Defined cases: a null text is empty and consists of the end alone; a null
doc_id counts as the text "" for the split; rows that repeat a doc_id are scored
each; words of equal count are ranked by their hash; a very long text fills a
lane of its own and takes memory in proportion to its words alone; without
training documents all counts are 0; on an empty table the result is empty.
Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import ceil, log10, sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, commonest, few_texts, materialize, mix, signed, unsigned, with_block

HIDDEN = 16
HEAD, WIDTH, TAILS = 2048, 64, 32
KNOWN = 1_000_000
LANES, WINDOW = 512, 16
#: Rows whose scores over the classes are held at once: so many stay in a core's cache.
ROWS = 1024
#: Longer documents are trained in pieces of so many tokens, each with a fresh state; a lane gets as many at least.
PIECE = 2048
#: Bytes of text that are trained on, or scored, together.
TRAIN_BYTES, SCORE_BYTES = 6_000_000, 12_000_000
#: Text that one replica trains on.
REPLICA_BYTES = 16_000_000
RATE = 0.01
#: Weights are averaged in steps of this.
GRAIN = 2.0**-40
_UNUSED = -30.0
_CLASS = np.uint64(TAILS - 1)
_LOW = np.arange(256, dtype=np.uint64)
_LOW[65:91] += 32
_ENDINGS = (mix(np.arange(1 << 16, dtype=np.uint64)) & _CLASS).astype(np.uint64)
#: The end of a document.
END = mix(np.array([1 << 40], np.uint64))[0] & ~_CLASS


def token_ids(words: Words) -> np.ndarray:
    """Of each word 59 bits of a hash, and its class in the low bits."""
    if not len(words.starts):
        return np.empty(0, np.uint64)
    last = _LOW[words.data[words.ends - 1]]
    before = np.where(words.ends - words.starts > 1, _LOW[words.data[words.ends - 2]], 0).astype(np.uint64)
    return (words.hashes(fold=True) & ~_CLASS) | _ENDINGS[before * np.uint64(256) + last]


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words and ends of all texts, and where each text begins (with the total last)."""
    words = Words(texts)
    n = len(words.first) - 1
    first = words.first + np.arange(n + 1)
    out = np.full(first[-1], END, np.uint64)
    ends = first[1:] - 1
    place = np.ones(len(out), bool)
    place[ends] = False
    out[place] = token_ids(words)
    return out, first


# ---------------------------------------------------------------- counts


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def added() -> tuple[np.ndarray, np.ndarray]:
        word, n = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(word, kind="stable")
        word = word[order]
        begins = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        return word[begins], np.add.reduceat(n[order], begins)

    for batch in few_texts(batches):
        held.append(np.unique(tokens(batch.column("text"))[0], return_counts=True))
        size += len(held[-1][0])
        if size > 2_000_000:
            held = [added()]
            size = len(held[0][0])
            if size > 1_000_000:
                yield pa.RecordBatch.from_arrays([signed(held[0][0]), pa.array(held[0][1])], ["word", "c"])
                held, size = [], 0
    if held:
        word, n = added()
        yield pa.RecordBatch.from_arrays([signed(word), pa.array(n)], ["word", "c"])


def split(docs: DataFrame) -> DataFrame:
    """``doc_id, text, held_out``."""
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (crc % 10 == 0).alias("held_out"))


def word_counts(parts: DataFrame) -> DataFrame:
    """``word, c`` over all training documents."""
    counted = parts.filter("not held_out").select("text").mapInArrow(_count_words, "word long, c long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"))


# ---------------------------------------------------------------- model


class Vocabulary:
    """The commonest words with their counts, and their model ids: the end, the head by rank, then an id for each tail class."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, tail_mass: np.ndarray, total: int):
        if END not in words:
            words, counts = np.append(words, END), np.append(counts, 0)
        rank = np.lexsort((words, -counts, words != END))
        head = rank[:HEAD]
        self.total, self.classes = total, ceil(HEAD / WIDTH)
        self.size = len(head)
        self.head_counts = np.zeros(HEAD)
        self.head_counts[: self.size] = counts[head]
        self.tail_mass = tail_mass - np.bincount((words[head] & _CLASS).astype(np.int64), counts[head] + 0.1, TAILS)
        self.tail_mass = np.maximum(self.tail_mass, 0.0) + 0.1
        model = HEAD + (words & _CLASS).astype(np.int32)
        model[head] = np.arange(self.size)
        order = np.argsort(words)
        self.words, self.counts, self.model = words[order], counts[order].astype(np.float64), model[order].astype(np.int32)

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of words, which are among the commonest, their place there, and their model ids."""
        at = np.searchsorted(self.words, words)
        at[at == len(self.words)] = 0
        hit = self.words[at] == words
        return hit, at, np.where(hit, self.model[at], HEAD + (words & _CLASS).astype(np.int32))


def start(v: Vocabulary, seed: int = 11) -> dict[str, np.ndarray]:
    """Weights that give every word its share of the counts."""
    rng = np.random.default_rng(seed)
    mass = np.concatenate([v.head_counts.reshape(v.classes, WIDTH).sum(1), v.tail_mass])
    inner = np.log(v.head_counts + 0.1)
    inner[v.size :] = _UNUSED
    inner = inner.reshape(v.classes, WIDTH)
    inner = inner - np.log(np.exp(inner).sum(1, keepdims=True))
    small = lambda *shape: rng.normal(0, 0.15, shape)
    p = {
        "x": small(HEAD + TAILS, 3 * HIDDEN),
        "u": small(HIDDEN, 3 * HIDDEN),
        "b": np.concatenate([np.full(HIDDEN, -1.0), np.zeros(2 * HIDDEN)]),
        "cw": small(HIDDEN, v.classes + TAILS) * 0.1,
        "cb": np.log((mass + 0.1) / (mass + 0.1).sum()),
        "ww": small(v.classes, HIDDEN, WIDTH) * 0.1,
        "wb": inner,
    }
    return {k: a.astype(np.float32) for k, a in p.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    out = np.tanh(0.5 * x)
    out *= 0.5
    out += 0.5
    return out


def _row_sums(x: np.ndarray) -> np.ndarray:
    return x @ np.ones(x.shape[1], x.dtype)


def _cell(p: dict[str, np.ndarray], gates: np.ndarray, h: np.ndarray):
    """One step: (new state, z, r, n, u_n)."""
    u = h @ p["u"]
    zr = _sigmoid(gates[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
    z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
    un = u[:, 2 * HIDDEN :]
    n = np.tanh(gates[:, 2 * HIDDEN :] + r * un)
    return n + z * (h - n), z, r, n, un


def _target_class(ids: np.ndarray, classes: int) -> np.ndarray:
    return np.where(ids < HEAD, ids // WIDTH, ids - HEAD + classes)


def log_probs(p: dict[str, np.ndarray], h: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Natural log P of target ids given states: the class, and for head words the word in its class."""
    classes = len(p["ww"])
    cls = _target_class(ids, classes)
    out = np.empty(len(ids), np.float64)
    for lo in range(0, len(ids), ROWS):
        s = slice(lo, lo + ROWS)
        logits = h[s] @ p["cw"]
        logits += p["cb"]
        picked = logits[np.arange(len(logits)), cls[s]]
        np.exp(logits, out=logits)
        out[s] = picked - np.log(_row_sums(logits))
    order = np.argsort(cls.astype(np.int16), kind="stable")
    ends = np.searchsorted(cls[order], np.arange(classes + 1))
    for c in range(classes):
        rows = order[ends[c] : ends[c + 1]]
        for lo in range(0, len(rows), ROWS):
            part = rows[lo : lo + ROWS]
            logits = h[part] @ p["ww"][c]
            logits += p["wb"][c]
            picked = logits[np.arange(len(part)), ids[part] % WIDTH]
            np.exp(logits, out=logits)
            out[part] += picked - np.log(_row_sums(logits))
    return out


def _output_grads(p: dict[str, np.ndarray], h: np.ndarray, ids: np.ndarray, g: dict[str, np.ndarray]) -> np.ndarray:
    """Adds the output layer's gradients to ``g``; returns those of the states."""
    classes = len(p["ww"])
    order = np.argsort(_target_class(ids, classes).astype(np.int16), kind="stable")
    h, ids = h[order], ids[order]
    cls = _target_class(ids, classes)
    dh = np.empty_like(h)
    for lo in range(0, len(ids), ROWS):
        s = slice(lo, lo + ROWS)
        logits = h[s] @ p["cw"]
        logits += p["cb"]
        np.exp(logits, out=logits)
        logits *= (1 / _row_sums(logits))[:, None]
        logits[np.arange(len(logits)), cls[s]] -= 1
        g["cw"] += h[s].T @ logits
        g["cb"] += np.ones(len(logits), logits.dtype) @ logits
        dh[s] = logits @ p["cw"].T
    ends = np.searchsorted(cls, np.arange(classes + 1))
    for c in np.flatnonzero(np.diff(ends)):
        for lo in range(ends[c], ends[c + 1], ROWS):
            s = slice(lo, min(lo + ROWS, ends[c + 1]))
            inner = h[s] @ p["ww"][c]
            inner += p["wb"][c]
            np.exp(inner, out=inner)
            inner *= (1 / _row_sums(inner))[:, None]
            inner[np.arange(len(inner)), ids[s] % WIDTH] -= 1
            g["ww"][c] += h[s].T @ inner
            g["wb"][c] += np.ones(len(inner), inner.dtype) @ inner
            dh[s] += inner @ p["ww"][c].T
    out = np.empty_like(dh)
    out[order] = dh
    return out


def gradients(
    p: dict[str, np.ndarray], inputs: np.ndarray, targets: np.ndarray, fresh: np.ndarray, h: np.ndarray, g: dict[str, np.ndarray] | None = None
) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Backpropagation through one window; arrays are (time, lane), ``fresh`` marks the first token of a document.

    Targets below 0 are not scored. Returns summed gradients (in ``g``, all 0, if given) and the last state.
    """
    steps, lanes = inputs.shape
    kind = p["u"].dtype
    gates = p["x"][inputs] + p["b"]
    kept = (~fresh)[:, :, None].astype(kind)
    before, z, r, n, un, after = (np.empty((steps, lanes, HIDDEN), kind) for _ in range(6))
    for t in range(steps):
        np.multiply(h, kept[t], out=before[t])
        h, z[t], r[t], n[t], un[t] = _cell(p, gates[t], before[t])
        after[t] = h
    g = {k: np.zeros_like(a) for k, a in p.items()} if g is None else g
    flat = targets.reshape(-1)
    scored = flat >= 0
    if scored.all():
        d_out = _output_grads(p, after.reshape(-1, HIDDEN), flat, g)
    else:
        d_out = np.zeros((steps * lanes, HIDDEN), kind)
        d_out[scored] = _output_grads(p, after.reshape(-1, HIDDEN)[scored], flat[scored], g)
    d_out = d_out.reshape(steps, lanes, HIDDEN)
    # what the gradient of a state is multiplied by for each gate
    of_n = (1 - z) * (1 - n * n)
    of_z = (before - n) * z * (1 - z)
    of_r = un * r * (1 - r)
    d_gates = np.empty((steps, lanes, 3 * HIDDEN), kind)
    du = np.empty_like(d_gates)
    dh = np.zeros((lanes, HIDDEN), kind)
    back = np.ascontiguousarray(p["u"].T)
    for t in range(steps - 1, -1, -1):
        dh = dh + d_out[t]
        dz, dr, dn = d_gates[t, :, :HIDDEN], d_gates[t, :, HIDDEN : 2 * HIDDEN], d_gates[t, :, 2 * HIDDEN :]
        np.multiply(dh, of_n[t], out=dn)
        np.multiply(dh, of_z[t], out=dz)
        np.multiply(dn, of_r[t], out=dr)
        du[t, :, : 2 * HIDDEN] = d_gates[t, :, : 2 * HIDDEN]
        np.multiply(dn, r[t], out=du[t, :, 2 * HIDDEN :])
        dh = (dh * z[t] + du[t] @ back) * kept[t]
    g["u"] += before.reshape(-1, HIDDEN).T @ du.reshape(-1, 3 * HIDDEN)
    flat_gates = d_gates.reshape(-1, 3 * HIDDEN)
    at = inputs.reshape(-1).astype(np.int16)
    order = np.argsort(at, kind="stable")
    begins = np.flatnonzero(np.diff(at[order], prepend=-1))
    g["x"][at[order[begins]]] = np.add.reduceat(flat_gates[order], begins, axis=0)
    g["b"] += flat_gates.sum(axis=0)
    return g, h


class Adam:
    """Weights and gradients as views of one array each, so that a step is a few operations."""

    def __init__(self, p: dict[str, np.ndarray], rate: float = RATE):
        self.flat, self.grad = _flat(p), np.zeros(sum(a.size for a in p.values()), np.float32)
        self.p, self.g = _views(self.flat, p), _views(self.grad, p)
        self.m, self.v, self.work = (np.zeros_like(self.grad) for _ in range(3))
        self.t, self.rate = 0, rate

    def step(self, scored: int) -> None:
        """One step along the gradients, of so many tokens; they are 0 afterwards."""
        self.t += 1
        g, m, v, work = self.grad, self.m, self.v, self.work
        g *= np.float32(1 / max(1, scored))
        g *= np.float32(min(1.0, 5.0 / (sqrt(float(g @ g)) + 1e-6)))
        np.subtract(g, m, out=work)
        work *= np.float32(0.1)
        m += work
        np.multiply(g, g, out=g)
        g -= v
        g *= np.float32(0.001)
        v += g
        np.sqrt(v, out=work)
        work += np.float32(1e-6)
        np.divide(m, work, out=work)
        work *= np.float32(self.rate * sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t))
        self.flat -= work
        g.fill(0)


def pack(lengths: list[int], lanes: int) -> list[list[int]]:
    """Documents by lane, longest first, each onto the lane that is shortest so far; lanes from long to short."""
    heap = [(0, i) for i in range(min(lanes, max(1, len(lengths))))]
    out: list[list[int]] = [[] for _ in heap]
    for d in sorted(range(len(lengths)), key=lambda d: -lengths[d]):
        size, lane = heapq.heappop(heap)
        out[lane].append(d)
        heapq.heappush(heap, (size + lengths[d], lane))
    return sorted(out, key=lambda ds: -sum(lengths[d] for d in ds))


class Lanes:
    """Runs of ids, with the id before each, packed into lanes, one run after the other, lanes from long to short."""

    def __init__(self, ids: np.ndarray, before: np.ndarray, first: np.ndarray, lanes: int, shuffle: bool = False):
        sizes = np.diff(first)
        packed = pack(sizes.tolist(), lanes)
        if shuffle:
            packed = [np.random.default_rng(len(mine)).permutation(mine).tolist() for mine in packed]
        order = np.array([d for mine in packed for d in mine], np.int64)
        begins = np.concatenate([[0], np.cumsum(sizes[order])[:-1]])
        self.order, self.begins = order, begins
        moved = np.repeat(first[order] - begins, sizes[order]) + np.arange(len(ids))
        self.targets, self.inputs = ids[moved], before[moved]
        self.fresh = np.zeros(len(ids), bool)
        self.fresh[begins] = True
        self.lengths = np.array([sizes[mine].sum() for mine in packed], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])

    def busy(self, t: int) -> int:
        """Lanes that have a token at step t."""
        return int(np.searchsorted(-self.lengths, -t, side="left"))


def _before(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The id before each, the end at the start of a document."""
    out = np.concatenate([[0], ids[:-1]])
    out[first[:-1]] = 0
    return out


def train(adam: Adam, ids: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """One pass over documents, whose tokens are ``ids[first[i]:first[i + 1]]``; changes and returns the weights."""
    pieces = np.concatenate([np.arange(a, b, PIECE) for a, b in zip(first[:-1], first[1:])] + [first[-1:]])
    x = Lanes(ids, _before(ids, first), pieces, min(LANES, max(8, len(ids) // PIECE)), shuffle=True)
    h = np.zeros((len(x.lengths), HIDDEN), np.float32)
    for t in range(0, int(x.lengths[0]), WINDOW):
        b = x.busy(t)
        steps = np.arange(t, min(t + WINDOW, int(x.lengths[0])))[:, None]
        inside = steps < x.lengths[:b]
        at = np.where(inside, x.at[:b] + steps, 0)
        _, h = gradients(adam.p, np.where(inside, x.inputs[at], 0), np.where(inside, x.targets[at], -1), inside & x.fresh[at], h[:b], adam.g)
        adam.step(int(inside.sum()))
    return adam.p


def log_scores(p: dict[str, np.ndarray], ids: np.ndarray, first: np.ndarray, lanes: int = 512) -> np.ndarray:
    """Natural log P of each document, its state carried through."""
    x = Lanes(ids, _before(ids, first), first, lanes)
    table = p["x"] + p["b"]
    kept = (~x.fresh).astype(np.float32)
    scored = np.empty(len(ids))
    h = np.zeros((len(x.lengths), HIDDEN), np.float32)
    held, where, rows = [], [], 0
    for t in range(int(x.lengths[0])):
        at = x.at[: x.busy(t)] + t
        h, *_ = _cell(p, table[x.inputs[at]], h[: len(at)] * kept[at, None])
        held.append(h)
        where.append(at)
        rows += len(at)
        if rows > 100_000 or t + 1 == x.lengths[0]:
            at = np.concatenate(where)
            scored[at] = log_probs(p, np.concatenate(held), x.targets[at])
            held, where, rows = [], [], 0
    out = np.empty(len(x.order))
    out[x.order] = np.add.reduceat(scored, x.begins)
    return out


# ---------------------------------------------------------------- jobs


def _flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def _views(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def _train_replica(vocabulary):
    def run(table: pa.Table) -> pa.Table:
        """``i, w``: the replica's weights, each times its share of all training tokens, in whole grains."""
        v = vocabulary.value
        adam = Adam(start(v))
        seen = 0
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")]).select(["text"])
        for batch in few_texts(table.to_batches(), TRAIN_BYTES):
            ids, first = tokens(batch.column("text"))
            words, back = np.unique(ids, return_inverse=True)
            train(adam, v.find(words)[2][back], first)
            seen += len(ids)
        w = np.round(np.clip(adam.flat.astype(np.float64), -1000, 1000) * (seen / v.total) / GRAIN).astype(np.int64)
        return pa.table({"i": pa.array(np.arange(len(w), dtype=np.int32)), "w": pa.array(w)})

    return run


def fit(parts: DataFrame, vocabulary: Vocabulary, shared_vocabulary) -> dict[str, np.ndarray]:
    """Weights averaged over replicas: one pass over every training document.

    A replica trains on the documents that a hash deals to it, about
    ``REPLICA_BYTES`` of text at any size of the corpus, in the order of doc_id
    and text. So the weights do not depend on partitions or tasks.
    """
    p = start(vocabulary)
    if not vocabulary.total:
        return p
    known = parts.filter("not held_out")
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = with_block(known, max(1, ceil(total / REPLICA_BYTES)), "doc_id", "text").groupBy("block")
    trained = dealt.applyInArrow(_train_replica(shared_vocabulary), "i int, w long")
    rows = trained.groupBy("i").agg(F.sum("w").alias("w")).toArrow()  # the weights once
    flat = np.zeros(rows.num_rows)
    flat[rows.column("i").to_numpy()] = rows.column("w").to_numpy() * GRAIN
    return _views(flat.astype(np.float32), p)


def _score(weights, vocabulary, base_total: float):
    """A row for each document, and one (uid, word, n) for each rarer word in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, v = weights.value, vocabulary.value
        base_of = np.log10((v.counts + 0.1) / base_total)
        tail = v.model >= HEAD
        extra_of = np.where(tail, np.log10(v.counts + 0.1) - np.log10(v.tail_mass)[np.where(tail, v.model - HEAD, 0)], 0.0)
        uid = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        for batch in few_texts(batches, SCORE_BYTES):
            ids, first = tokens(batch.column("text"))
            words, back = np.unique(ids, return_inverse=True)
            hit, at, model = v.find(words)
            begins, n = first[:-1], len(first) - 1
            per_doc = lambda x: np.add.reduceat(np.where(hit, x, 0)[back], begins)  # noqa: B023, E731
            gained = log_scores(p, model[back], first) / np.log(10.0) + per_doc(extra_of[at])
            uids = pa.array(np.arange(uid, uid + n))
            yield _rows(
                uid=uids, doc_id=batch.column("doc_id"), held_out=batch.column("held_out"), n_tokens=pa.array(np.diff(first)),
                n_known=pa.array(per_doc((v.counts[at] > 0).astype(np.int64))), score=pa.array(gained), base=pa.array(per_doc(base_of[at])),
            )
            rare = np.flatnonzero(~hit[back])
            if len(rare):
                doc = np.searchsorted(first, rare, side="right") - 1
                pairs, times = np.unique(doc * len(words) + back[rare], return_counts=True)
                yield _rows(uid=pa.array(uid + pairs // len(words)), word=signed(words[pairs % len(words)]), n=pa.array(times))
            uid += n

    return run


_FIELDS = [
    ("uid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
    ("score", pa.float64()), ("base", pa.float64()), ("word", pa.int64()), ("n", pa.int64()),
]
_SCORED = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, score double, base double, word long, n long"


def _rows(**have: pa.Array) -> pa.RecordBatch:
    size = len(have["uid"])
    return pa.RecordBatch.from_arrays([have[k].cast(t) if k in have else pa.nulls(size, t) for k, t in _FIELDS], [k for k, _ in _FIELDS])


def score(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row."""
    spark = docs.sparkSession
    parts = split(docs)
    counts = materialize(word_counts(parts), "counts")
    total = counts.agg(F.sum("c"), F.count("*")).first()
    tokens_, distinct = total[0] or 0, total[1]
    base_total = tokens_ + 0.1 * (distinct + 1)
    cls = F.col("word").bitwiseAND(F.lit(TAILS - 1))
    mass = np.zeros(TAILS)
    for r in counts.groupBy(cls.alias("cls")).agg(F.sum(F.col("c") + F.lit(0.1)).alias("m")).collect():  # TAILS rows
        mass[r["cls"]] = r["m"]
    top = commonest(counts, "c", KNOWN).toArrow()
    v = Vocabulary(unsigned(top.column("word")), top.column("c").to_numpy(), mass, tokens_)
    vocabulary = spark.sparkContext.broadcast(v)
    weights = spark.sparkContext.broadcast(fit(parts, v, vocabulary))

    scored = materialize(parts.mapInArrow(_score(weights, vocabulary, base_total), _SCORED), "scored")
    tail_log = F.element_at(F.array(*[F.lit(float(x)) for x in np.log10(v.tail_mass)]), cls.cast("int") + 1)
    rare = scored.filter("word is not null").select("uid", "word", "n").join(counts.select("word", "c"), "word", "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    added = rare.groupBy("uid").agg(
        F.sum(F.when(c > 0, F.col("n")).otherwise(F.lit(0))).alias("known_more"),
        F.sum(F.col("n") * F.log10((c + F.lit(0.1)) / F.lit(base_total))).alias("base_more"),
        F.sum(F.col("n") * (F.log10(c + F.lit(0.1)) - tail_log)).alias("score_more"),
    )
    return scored.filter("word is null").join(added, "uid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known_more", F.lit(0))).alias("n_known"),
        F.lit(tokens_).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("score_more", F.lit(0.0))).alias("score"),
    )


def base_log10(count: float, tokens: int, distinct: int) -> float:
    return log10((count + 0.1) / (tokens + 0.1 * (distinct + 1)))
