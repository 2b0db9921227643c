import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from tidemark.llm import language_model as lm
from tidemark.llm import queries
from tidemark.llm.common import Words


def reference(rows):
    counts = Counter()
    toks = {}
    for i, t in rows:
        toks[i] = [*(t or "").encode().lower().split(), b""]
        if zlib.crc32(str(i).encode()) % 10:
            counts.update(toks[i])
    total, distinct = sum(counts.values()), len(counts)
    return {
        i: (zlib.crc32(str(i).encode()) % 10 == 0, len(w), sum(counts[x] > 0 for x in w), total, sum(lm.base_log10(counts[x], total, distinct) for x in w))
        for i, w in toks.items()
    }


def test_whole_table(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(lm, "KNOWN", 3000)  # so that rarer words take the other way
    table = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()]
    want = reference(table)
    got = {r.doc_id: r for r in queries.op10_recurrent_scoring(spark, sf_dir).collect()}
    assert got.keys() == want.keys()
    for i, r in got.items():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[i][:4]
        assert abs(r.base_score - want[i][4]) < 1e-6 * max(1, abs(want[i][4]))
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def tiny():
    words = lm.token_ids(Words(pa.array([f"w{i}" for i in range(300)])))
    counts = 1000 // (np.arange(300) + 1) + 1
    words, counts = np.append(words, lm.END), np.append(counts, 50)
    mass = np.bincount((words & lm._CLASS).astype(int), counts + 0.1, lm.TAILS)
    return lm.Vocabulary(words, counts, mass, int(counts.sum())), words


def joined(docs):
    return np.concatenate(docs), np.concatenate([[0], np.cumsum([len(d) for d in docs])])


def test_probabilities_sum_to_one():
    v, _ = tiny()
    p = lm.start(v)
    h = np.random.default_rng(0).normal(0, 0.5, (1, lm.HIDDEN)).astype(np.float32)
    ids = np.arange(lm.HEAD + lm.TAILS)
    total = np.exp(lm.log_probs(p, np.repeat(h, len(ids), 0), ids)).sum()
    assert abs(total - 1) < 1e-4


def test_gradients_against_differences():
    v, words = tiny()
    rng = np.random.default_rng(2)
    p = {k: a.astype(np.float64) for k, a in lm.start(v).items()}
    ids = rng.integers(0, 300, (6, 3))
    inputs, targets = np.vstack([np.zeros((1, 3), int), ids[:-1]]), ids.copy()
    targets[4, 1] = -1
    fresh = np.zeros((6, 3), bool)
    fresh[0], fresh[3, 2] = True, True
    h0 = np.zeros((3, lm.HIDDEN))

    def loss():
        gates = p["x"][inputs] + p["b"]
        h, total = h0, 0.0
        for t in range(6):
            h, *_ = lm._cell(p, gates[t], h * ~fresh[t][:, None])
            ok = targets[t] >= 0
            total -= lm.log_probs(p, h[ok], targets[t][ok]).sum()
        return total

    g, _ = lm.gradients(p, inputs, targets, fresh, h0)
    for k in p:
        flat = p[k].reshape(-1)
        for j in rng.choice(np.flatnonzero(np.abs(g[k].reshape(-1)) > 1e-4), 4):
            old = flat[j]
            flat[j] = old + 1e-5
            up = loss()
            flat[j] = old - 1e-5
            down = loss()
            flat[j] = old
            assert abs((up - down) / 2e-5 - g[k].reshape(-1)[j]) < 1e-2 * max(0.1, abs(g[k].reshape(-1)[j])), k


def test_packing_does_not_change_scores():
    v, words = tiny()
    p = lm.start(v)
    rng = np.random.default_rng(3)
    docs = [np.append(rng.integers(1, 300, n), 0) for n in (0, 1, 5, 900, 40, 40, 3, 17)]
    one = np.concatenate([lm.log_scores(p, *joined([d])) for d in docs])
    assert np.allclose(lm.log_scores(p, *joined(docs), lanes=3), one, rtol=1e-5)
    assert np.allclose(lm.log_scores(p, *joined(docs)), one, rtol=1e-5)


def test_training_lowers_the_loss():
    v, words = tiny()
    docs = joined([np.array([*([1 + i % 2, 5 + i % 2] * 40), 0]) for i in range(60)])
    p = lm.start(v)
    before = lm.log_scores(p, *docs).sum()
    after = lm.log_scores(lm.train(lm.Adam(p), *docs), *docs).sum()
    assert after > before * 0.8


def test_a_very_long_text_takes_memory_of_its_own_words_only():
    v, words = tiny()
    rng = np.random.default_rng(4)
    docs = joined([np.append(rng.integers(1, 300, n), 0) for n in [100_000, *[100] * 600]])
    p = lm.start(v)
    tracemalloc.start()
    scores = lm.log_scores(p, *docs)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(scores) == 601 and most < 80_000_000


def test_whole_scores_against_a_plain_scorer(spark, monkeypatch):
    """The score of each text by a loop over its words, with dictionaries and the formulas of the model."""
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(["Ax", "bee", "cat", "dot", "end", "fig", f"r{i}"], 3 + i % 9)) for i in range(60)] + [None, "unseen"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = {}
    monkeypatch.setattr(lm, "KNOWN", 60)
    fit = lm.fit
    monkeypatch.setattr(lm, "fit", lambda parts, v, b: seen.update(p=fit(parts, v, b), v=v) or seen["p"])
    got = {r.doc_id: r.score for r in lm.score(df).collect()}
    p, v = {k: a.astype(np.float64) for k, a in seen["p"].items()}, seen["v"]
    name = lambda w: int(lm.token_ids(Words(pa.array([w])))[0]) if w else int(lm.END)
    toks = {i: [*(t or "").lower().split(), ""] for i, t in enumerate(texts)}
    counts = Counter(w for i, ws in toks.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    model = dict(zip(v.words.tolist(), v.model.tolist()))
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    n = lm.HIDDEN
    for i, ws in toks.items():
        h, at, total = np.zeros(n), 0, 0.0
        for w in ws:
            a, u = p["x"][at] + p["b"], h @ p["u"]
            z, r = sigmoid(a[:n] + u[:n]), sigmoid(a[n : 2 * n] + u[n : 2 * n])
            h = (1 - z) * np.tanh(a[2 * n :] + r * u[2 * n :]) + z * h
            at = model.get(name(w), lm.HEAD + name(w) % lm.TAILS)
            scores = h @ p["cw"] + p["cb"]
            head = at < lm.HEAD
            c = at // lm.WIDTH if head else v.classes + at - lm.HEAD
            total += scores[c] - np.log(np.exp(scores).sum())
            if head:
                inner = h @ p["ww"][c] + p["wb"][c]
                total += inner[at % lm.WIDTH] - np.log(np.exp(inner).sum())
            else:
                total += np.log((counts[w] + 0.1) / v.tail_mass[at - lm.HEAD])
        assert abs(got[i] - total / np.log(10)) < 1e-3 * max(1, abs(got[i]))


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "A b"), (3, "a B"), (None, "zz"), (11, "w " * 20_000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int")
    got = lm.score(df).collect()
    assert len(got) == 6 and {r.n_tokens for r in got} == {1, 3, 2, 20_001}
    assert lm.score(df.limit(0)).count() == 0
    assert [r.train_tokens for r in lm.score(df.filter("doc_id is null")).collect()] == [0]


def test_scores_do_not_depend_on_partitions_or_order(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(lm, "REPLICA_BYTES", 60_000)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = [{r.doc_id: r for r in lm.score(docs.repartition(n).orderBy("doc_id", ascending=n > 1) if n > 1 else docs.coalesce(1)).collect()} for n in (1, 9)]
    assert found[0].keys() == found[1].keys()
    assert all(abs(found[0][i].score - r.score) <= 1e-4 * (1 + abs(r.score)) for i, r in found[1].items())
    held = [r for r in found[0].values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
