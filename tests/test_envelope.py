"""The envelope adds pixels up by column before any window sees them."""

from pyspark.sql import functions as F

from tidemark.operators import cluster


def test_small_groups_go_and_windows_see_columns(spark):
    n = F.col("id")
    px = spark.range(5000).select((n % 2).cast("int").alias("g"), (n % 7).cast("int").alias("x"), (n % 11).cast("int").alias("y"), (n % 13).alias("coherence"))
    px = px.union(spark.range(9).select(F.lit(5), n.cast("int"), F.lit(1), n))
    out = cluster.envelope_by_coherence(px, ["g"])
    assert {r.g for r in out.collect()} == {0, 1} and out.count() == 14
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # what the lowest window stands over is added up
    assert "Aggregate" in plan.split("Window [")[-1]
