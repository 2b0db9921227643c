"""Nearest rows are looked up by place: repeated rows of a place make no pairs."""

from pyspark.sql import functions as F

from tidemark.operators import spatial


def test_equal_to_all_pairs(spark):
    left = spark.createDataFrame([(d, i, float(i * 7 % 30) / 2, float(i * 11 % 20)) for d in (1, 2) for i in range(60)], "d int, line_id int, lx double, ly double")
    right = spark.createDataFrame([(d, f"t{i % 5}", i % 3, float(i * 5 % 14), float(i * 3 % 20)) for d in (1, 2) for i in range(90)], "d int, label string, more int, rx double, ry double")
    got = spatial.nearest_within(left, right, ["d"], ("lx", "ly"), ("rx", "ry"), 4.0, ["label"])
    dist = F.sqrt((F.col("lx") - F.col("rx")) * (F.col("lx") - F.col("rx")) + (F.col("ly") - F.col("ry")) * (F.col("ly") - F.col("ry")))
    pairs = left.join(right, "d").withColumn("dist", dist).filter("dist <= 4").groupBy("d", "line_id").agg(F.min(F.struct("dist", "label")).alias("m"))
    want = {(r.d, r.line_id, r.m.dist, r.m.label) for r in pairs.collect()}
    rows = got.collect()
    assert {(r.d, r.line_id, r.dist, r.label) for r in rows} == want and len(rows) == len(want) > 50


def test_repeated_rows_make_no_pairs(spark):
    """20,000 swatches and as many words in a few places: all pairs would be 400 million."""
    n = F.col("id")
    lines = spark.range(20_000).select(F.lit(1).alias("d"), n.alias("line_id"), (n % 3).cast("string").alias("style_key"), (n % 4).cast("double").alias("x1"), F.lit(0.0).alias("y1"), (n % 4 + 2).cast("double").alias("x2"), F.lit(0.0).alias("y2"))
    texts = spark.range(20_000).select(F.lit(1).alias("d"), F.concat(F.lit("w"), (n % 100).cast("string")).alias("label"), (n % 5).cast("double").alias("tx"), F.lit(1.0).alias("ty"))
    found = spatial.nearest_label(lines, texts, ["d"])
    met = spatial.place_pairs(spatial._places(lines, ["d"], ("x1", "y1")), spatial._first_by_place(texts, ["d"], ("tx", "ty"), ["label"]), ["d"], ("tx", "ty"), 25.0)
    assert met.count() == 4 * 5
    assert [(r.style_key, r.label) for r in found.orderBy("style_key").collect()] == [("0", "w1"), ("1", "w1"), ("2", "w1")]


def test_many_short_paths_and_a_long_one(spark):
    """A stream of curves gives what a walk over each curve gives, whatever the batches."""
    import numpy as np

    from tidemark.operators import shape

    rng = np.random.default_rng(5)
    sizes = [25_000, *rng.integers(1, 4, 3000).tolist()]
    rows = [(c, i, float(x), float(y)) for c, n in enumerate(sizes) for i, (x, y) in enumerate(zip(np.round(rng.normal(0, 1, n).cumsum(), 3), np.round(rng.normal(0, 1, n).cumsum(), 3)))]
    want, last = set(), {}
    for c, i, x, y in rows:
        if c in last:
            dx, dy = abs(x - last[c][0]), abs(y - last[c][1])
            if dx < 0.5 and dy < 0.5:
                continue
            x, y = (last[c][0], y) if dx < dy else (x, last[c][1])
        last[c] = x, y
        want.add((c, i, x, y))
    df = shape.step_regularize(spark.createDataFrame(rows, "c int, seq int, time double, survival double").repartition(5), 0.5, ["c"])
    assert "FlatMapGroups" not in df._jdf.queryExecution().executedPlan().toString()
    assert {(r.c, r.seq, r.time, r.survival) for r in df.collect()} == want
