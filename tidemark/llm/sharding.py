"""Sharding by vector bin packing.

Groups (equal texts) are balanced over shards in bytes, tokens and rows at
once: the largest group first, each into the shard where the dot product of
its demand and the shard's residual capacity is highest.

*Scale.* What is packed is bounded. Groups are dealt by hash into ``cells``
cells, and a cell is placed as one item. A group with more than
1/(32 * shards) of any of the three sums is an item of its own; at most
3 * 32 * shards groups can be so large. Such a group is split by row into
chunks no larger than a cell should be, so a text that a third of all rows
share is dealt over the shards, whatever their doc_ids are. The driver sees the items' sums (some
thousands of rows at any input size), never documents. Slots come from one
window per item plus the item's offset; texts are not shuffled.

Defined cases: a null text counts as empty for bytes, tokens, checksum and
grouping; empty texts weigh one byte each; repeated rows get slots of their
own; a null doc_id sorts first; rows alike in doc_id and text share slots in any
order, and of shards with equal dot products the first is taken; a very long
text is an item of its own; on an empty table the result is empty.
Columns named like an added one are replaced.
"""

from __future__ import annotations

from math import ceil

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, word_count

CELLS = 4096
PARTS = 32
DIMENSIONS = ("bytes", "tokens", "rows")


def pack(demands: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item; ``demands`` has a row for each item, columns are shares of the total."""
    room = np.full((shards, demands.shape[1]), 1.0 / shards)
    placed = np.zeros(len(demands), np.int64)
    for i in np.lexsort((np.arange(len(demands)), -demands.max(axis=1, initial=0))):
        placed[i] = s = int(np.argmax(room @ demands[i]))
        room[s] -= demands[i]
    return placed


def shard(docs: DataFrame, shards: int = 8, cells: int = CELLS) -> DataFrame:
    """``doc_id, size, text_crc32, tokens, shard, slot`` for every row; slots are gapless from 0 in each shard."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = materialize(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            word_count(text).alias("tokens"),
            F.xxhash64(text).alias("group"),
        ),
        "sharding",
    )
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    total = slim.agg(*sums).first()
    if not total["rows"]:
        return slim.select("doc_id", "size", "text_crc32", "tokens", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    whole = {d: max(total[d] or 0, 1) for d in DIMENSIONS}

    large = F.greatest(*[F.col(d) / F.lit(float(whole[d])) for d in DIMENSIONS])
    heavy = (
        slim.groupBy("group").agg(*sums).withColumn("share", large).filter(F.col("share") > 1.0 / (PARTS * shards))
        .orderBy("group").collect()  # at most 3 * PARTS * shards rows
    )
    rows, first = [], cells
    for r in heavy:
        chunks = ceil(r["share"] * PARTS * shards * 4)
        rows.append((r["group"], first, chunks))
        first += chunks
    heavy_items = spark.createDataFrame(rows, "group long, first int, chunks int")

    item = F.when(F.col("chunks").isNull(), F.pmod(F.col("group"), F.lit(cells))).otherwise(F.col("first") + F.pmod(F.xxhash64("row", F.lit(9)), F.col("chunks")))
    dealt = slim.join(F.broadcast(heavy_items), "group", "left").withColumn("item", item.cast("int"))
    items = dealt.groupBy("item").agg(*sums).orderBy("item").collect()  # at most cells + chunks rows
    demands = np.array([[(r[d] or 0) / whole[d] for d in DIMENSIONS] for r in items])
    placed = pack(demands, shards)
    offset, starts = [0] * shards, []
    for r, s in zip(items, placed):
        starts.append((r["item"], int(s), offset[s]))
        offset[s] += r["rows"]
    plan = spark.createDataFrame(starts, "item int, shard int, start long")
    order = Window.partitionBy("item").orderBy("doc_id", "group", "size")
    return dealt.join(F.broadcast(plan), "item").select(
        "doc_id", "size", "text_crc32", "tokens", "shard", (F.col("start") + F.row_number().over(order) - 1).alias("slot")
    )
