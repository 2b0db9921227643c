"""Containment by grid levels against all pairs."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import spatial

INF = float("inf")


def test_points_in_boxes_of_any_size(spark):
    rng = np.random.default_rng(11)
    points = [(int(rng.integers(3)), i, *map(float, rng.normal(0, 10 ** rng.uniform(0, 5), 2))) for i in range(600)] + [(0, 900, 0.0, 0.0), (0, 901, 32.0, 64.0), (9, 902, 1.0, 1.0), (1, 903, None, 1.0)]
    boxes = []
    for i in range(150):
        w, h = 10 ** rng.uniform(-1, 6, 2)
        x, y = rng.normal(0, 10 ** rng.uniform(0, 4), 2)
        boxes.append((int(rng.integers(3)), i, float(x), float(x + w), float(y), float(y + h)))
    boxes += [(0, 500, -INF, INF, 0.0, 5.0), (0, 501, -INF, 3.0, -INF, INF), (0, 502, 0.0, 0.0, 0.0, 0.0), (0, 503, 0.0, 32.0, 0.0, 64.0), (0, 504, 5.0, 4.0, 0.0, 1.0), (1, 505, 0.0, 1e12, -1e12, 1e12), (0, 506, None, 1.0, 0.0, 1.0)]
    p = spark.createDataFrame(points, "k int, point_id int, px double, py double")
    b = spark.createDataFrame(boxes, "k int, box_id int, xmin double, xmax double, ymin double, ymax double")
    got = sorted((r.point_id, r.box_id) for r in spatial.in_boxes(p, b, ["k"], "px", "py").collect())
    want = sorted((i, j) for k, i, x, y in points for l, j, x1, x2, y1, y2 in boxes if k == l and None not in (x, y, x1) and x1 <= x <= x2 and y1 <= y <= y2)  # noqa: E741
    assert got == want and len(set(got)) == len(got)


def test_pairs_grow_with_points_not_with_boxes(spark):
    """A page tiled by boxes: all pairs would be their product."""
    for n in (20, 60):
        boxes = spark.range(n * n).select(F.lit(0).alias("k"), F.col("id").alias("box_id"), *[e.cast("double").alias(c) for c, e in zip(spatial.BOX, (F.col("id") % n * 50, F.col("id") % n * 50 + 49, F.floor(F.col("id") / n) * 50, F.floor(F.col("id") / n) * 50 + 49))])
        points = spark.range(20_000).select(F.lit(0).alias("k"), F.col("id").alias("point_id"), (F.rand(1) * n * 50).alias("px"), (F.rand(2) * n * 50).alias("py"))
        assert spatial.box_pairs(points, boxes, ["k"], "px", "py").count() <= 4 * 20_000


def test_words_over_the_edge_of_a_region(spark):
    words = spark.createDataFrame([(0, "a", 0.0, 0.0, 20.0, 8.0), (0, "b", 95.0, 95.0, 500.0, 400.0), (0, "c", 101.0, 0.0, 5.0, 5.0), (0, "d", -19.0, -7.0, 20.0, 8.0), (1, "e", 0.0, 0.0, 9.0, 9.0)], "k int, text string, left double, top double, width double, height double")
    regions = spark.createDataFrame([(0, 1, 0.0, 100.0, 0.0, 100.0)], "k int, region_id int, rx1 double, rx2 double, ry1 double, ry2 double")
    assert [r.text for r in spatial.text_in_region(words, regions, ["k"]).collect()] == ["d a b"]
