"""Running sums of groups of any size, in two levels.

Rows are dealt by ranges of (keys, order) and written once with the number of
their range. Each range adds up its own rows; the totals of the ranges that come
before are carried into it. A group that fills many ranges is worked on by as many
tasks, and no window sees more than one range of a group. A range boundary
splits one group at most, so there are fewer carried rows than ranges: these may
be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.shared import written

RANGE = "__range"


def same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", also: Column | None = None) -> DataFrame:
    """``left`` joined with ``right`` on equal keys, where nulls are equal too; keys appear once."""
    other = right.select(*[F.col(k).alias(f"__of_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = also if also is not None else F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    return left.join(other, on, how).drop(*[f"__of_{k}" for k in keys])


def spread(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``rows`` in ranges of (keys, order) of about equal size, written once, with the number of the range; equal places share a range."""
    return written(rows.repartitionByRange(*keys, order).withColumn(RANGE, F.spark_partition_id()))


def running(rows: DataFrame, keys: list[str], order: str, sums: dict[str, Column], descending: bool = False, strict: bool = False) -> DataFrame:
    """Adds to what ``spread`` gave, for each name, the sum of its value over the rows of the group up to this one.

    ``descending`` starts from the largest ``order``; ``strict`` leaves the row
    itself out. ``order`` must not repeat within a group.
    """
    totals = rows.groupBy(*keys, RANGE).agg(*[F.sum(v).alias(f"__sum_{c}") for c, v in sums.items()])
    here = totals.select(*keys, RANGE)
    past = totals.withColumnRenamed(RANGE, "__past")
    before = F.col("__past") > F.col(RANGE) if descending else F.col("__past") < F.col(RANGE)
    carried = same(here, past, keys, also=before).groupBy(*keys, RANGE).agg(*[F.sum(f"__sum_{c}").alias(f"__sum_{c}") for c in sums])
    place = Window.partitionBy(*keys, RANGE).orderBy(F.desc(order) if descending else F.asc(order))
    frame = place.rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    inside = rows.withColumns({f"__in_{c}": F.sum(v).over(frame) for c, v in sums.items()})
    # one row for each range at most that begins inside a group
    out = same(inside, F.broadcast(carried), [*keys, RANGE], "left")
    zero = F.lit(0)
    out = out.withColumns({c: F.coalesce(F.col(f"__in_{c}"), zero) + F.coalesce(F.col(f"__sum_{c}"), zero) for c in sums})
    return out.drop(*[f"__{kind}_{c}" for kind in ("in", "sum") for c in sums])
