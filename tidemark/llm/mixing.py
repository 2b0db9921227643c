"""Mixing sources to target weights by Pareto order sampling.

Each source has a weight; all weights share a budget of words. No source is
repeated more than ``cap`` times: targets above that stop there, and what is
left is shared by weight again until no target is above its cap.

*Certain copies.* A source whose target is r times its size takes every
document floor(r) times. *Pareto order sample.* The rest of the target is a
fixed-size sample (fixed in words) with unequal probabilities: a document's
rank is its random odds u/(1-u) divided by its inclusion odds p/(1-p), and
documents are taken in order of rank until the words are there. A document's
inclusion probability p is in proportion to ``favour`` of its size, scaled for
its source so that the expected words are the rest of the target.

*Scale.* Ranks are cut into fine buckets; sums by (source, bucket) find the
bucket in which a source's sample ends, and only that bucket's documents (one
in 65,536 of a source, however large) are put in order. What is joined back to
the documents is one row per source; texts are never shuffled.

Defined cases: sources are ordered by code point, null last and a source of
its own; a null text has no words; documents without words get the certain
copies only; rows that repeat a doc_id of one source share its fate; a source
without words has target 0; on an empty table the result is empty. Columns
named like an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_side, word_count

BUCKETS = 65_536


def _rank(seed: int, odds: Column) -> Column:
    """Random odds over inclusion odds, mapped from (0, inf) to (0, 1)."""
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11)
    u = (draw + F.lit(0.5)) / F.lit(float(2**53))
    ratio = u / (F.lit(1.0) - u) / odds
    return ratio / (F.lit(1.0) + ratio)


def favour(size: Column) -> Column:
    """What inclusion probabilities are in proportion to: longer documents are somewhat likelier. A whole number, so that sums are exact."""
    return F.round(F.log(size + F.lit(2.0)) * 1000).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """Adds ``weight`` and ``target`` to one row per ``source`` with its ``source_size``."""
    n = len(weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    by_room = Window.orderBy("__room", F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_room.rowsBetween(0, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % n + 1).cast("int"))
    most = F.col("source_size") * F.lit(float(cap))
    return (
        sources.withColumn("weight", weight)
        .withColumn("__room", most / F.col("weight"))
        # words per weight if all sources with less room than this one stand at their cap
        .withColumn("__level", (F.sum("source_size").over(everything) - F.coalesce(F.sum(most).over(before), F.lit(0.0))) / F.sum("weight").over(onward))
        .withColumn("__full", F.col("__level") > F.col("__room"))
        .withColumn("__level", F.max(F.when(~F.col("__full"), F.col("__level"))).over(everything))
        .withColumn("target", F.when(F.col("__full"), most).otherwise(F.col("weight") * F.col("__level")).cast("double"))
        .drop("__room", "__level", "__full")
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 20) -> DataFrame:
    """All documents with ``size, source_size, target, copies`` and ``taken`` = copies * size."""
    added = ["size", "source_size", "target", "copies", "taken"]
    rows = docs.select(F.struct(*[c for c in docs.columns if c not in added]).alias("row"), "source", "doc_id", word_count(F.col("text")).alias("size"))
    sizes = materialize(rows.select("source", "doc_id", "size"), "sizes")
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(favour(F.col("size")) * F.col("size")).alias("favoured"))
    plan = (
        targets(totals, weights, cap)
        .withColumn("certain", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int"))
        .withColumn("rest", F.col("target") - F.col("certain") * F.col("source_size"))
        # inclusion probabilities scale * favour take the rest, in words, on average
        .select(F.col("source").alias("of"), "source_size", "target", "certain", "rest", F.when(F.col("favoured") > 0, F.col("rest") / F.col("favoured")).otherwise(F.lit(0.0)).alias("scale"))
    )
    plan = small_side(plan)
    same = F.col("source").eqNullSafe(F.col("of"))
    probability = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-12), F.col("scale") * favour(F.col("size"))))
    rank = _rank(seed, probability / (1 - probability))
    bucket = F.least(F.floor(rank * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    ranked = sizes.join(plan.select("of", "rest", "scale"), same).select("of", "doc_id", "size", "rest", rank.alias("rank"), bucket.alias("bucket"))

    running = Window.partitionBy("of").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ends = (
        ranked.groupBy("of", "bucket").agg(F.sum("size").alias("here"), F.first("rest").alias("rest"))
        .withColumn("upto", F.sum("here").over(running))
        .filter((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("here") <= F.col("rest")))
        .select(F.col("of").alias("of_end"), F.col("bucket").alias("end"), (F.col("upto") - F.col("here")).alias("before"))
    )
    ends = small_side(ends)
    taken_upto = F.sum("size").over(Window.partitionBy("of").orderBy("place").rangeBetween(Window.unboundedPreceding, 0))
    last = (
        ranked.join(ends, F.col("of").eqNullSafe(F.col("of_end")) & (F.col("bucket") == F.col("end")))
        .withColumn("place", F.struct("rank", "doc_id"))
        .withColumn("upto", F.col("before") + taken_upto)
        # the document at the border is taken if that comes nearer to the target
        .filter(F.col("upto") - F.col("size") / 2 <= F.col("rest"))
        .groupBy(F.col("of").alias("of_last"))
        .agg(F.max("place").alias("last"))
    )
    border = plan.join(ends, F.col("of").eqNullSafe(F.col("of_end")), "left").join(last, F.col("of").eqNullSafe(F.col("of_last")), "left")
    border = small_side(border.select("of", "source_size", "target", "certain", "rest", "scale", "end", "last"))
    drawn = (
        F.when(F.col("rest") <= 0, F.lit(False))
        .when(F.col("end").isNull(), F.lit(True))  # the rest is all that the source has
        .when(F.col("bucket") != F.col("end"), F.col("bucket") < F.col("end"))
        .otherwise(F.coalesce(F.struct("rank", "doc_id") <= F.col("last"), F.lit(False)))
    )
    copies = F.col("certain") + F.when((F.col("size") > 0) & drawn, F.lit(1)).otherwise(F.lit(0))
    out = rows.join(border, same).withColumn("rank", rank).withColumn("bucket", bucket).withColumn("copies", copies.cast("int"))
    return out.select("row.*", "size", "source_size", "target", "copies", (F.col("copies").cast("long") * F.col("size")).alias("taken"))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``."""
    taken = mix(docs.select(F.struct(*docs.columns).alias("whole"), "doc_id", "source", "text"), **options)
    return taken.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("whole.*")
