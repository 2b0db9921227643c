import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_decontamination import windows  # noqa: E402
from tests.llm.test_jaccard_join import brute  # noqa: E402
from tests.llm.test_quality_rules import measures  # noqa: E402
from tidemark.llm import decontamination as dc  # noqa: E402
from tidemark.llm.common import materialize, shared_dir  # noqa: E402


def test_stages_on_whole_table(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    rows = None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        rows = docs.collect()
        if k == 4:
            break
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in rows}
        assert all(before[i] == t for i, t in after.items())
        if k == 0:
            assert not any(measures(t)[-1] for t in after.values()) and len(after) > 0.7 * len(before)
        elif k == 1:
            assert sorted(after) == sorted({c for _, c in brute(list(before.items())).values()})
            assert len(rows) == len(after)
        elif k == 2:
            found = set()
            for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
                size = min(dc.WINDOW, len(r.text.split()))
                mine = set(windows(r.text, size))
                found |= {i for i, t in before.items() if mine & set(windows(t, size))}
            assert set(after) == set(before) - found
        elif k == 3:
            assert set(Counter(r.doc_id for r in rows).values()) <= {1, 2, 3}
        before = after
        n = len(rows)
    assert len(rows) == n
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_awkward_rows_pass_every_stage(spark, sf_dir):
    """Nulls, empty and long texts, repeated rows and clashing names; then an empty table."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    odd = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (None, "word " * 30_000, None, None, 5), (7, "é", "xx", "b", 1)]
    docs = table.unionByName(spark.createDataFrame(odd, table.schema))
    for c in ("row", "id", "key", "label", "copy", "size", "group", "ref_chars", "__c", "of"):
        docs = docs.withColumn(c, F.lit(1))
    for start in (docs, docs.limit(0)):
        step = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, step, sf_dir)
            assert name == "sharding" or out.columns == docs.columns
            step = materialize(out, "step")
            assert step.count() <= 3 * max(1, start.count())


def test_a_stage_is_written_in_place_of_the_one_before_the_last(spark, sf_dir, monkeypatch):
    stages = [(str(k), lambda s, docs, d, k=k: docs.filter(F.col("doc_id") % (k + 2) > 0)) for k in range(5)]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    shared = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    got = sorted(r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got == sorted(r.doc_id for r in docs.collect() if all(r.doc_id % (k + 2) for k in range(5)))
    assert len(set(os.listdir(shared)) - before) == 2
