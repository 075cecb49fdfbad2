"""Byte-balanced sharding of indivisible groups (operator 3): Karmarkar-Karp differencing.

Rows with equal texts form a group that stays together. A partial partition holds one sum per shard; the two of largest
spread are combined again and again, the largest sum of one with the smallest of the other. Groups are dealt to blocks
of about ``BLOCK``; each block is differenced in its own task and leaves one partial partition, and these are
differenced in turn, level by level, so no task and not the driver sees more than a block. A group larger than its even
share fills a shard alone. A null text counts as empty; equal rows share a shard and take slots of their own;
an empty table gives no rows; other columns are ignored. A very long text is one weight: its bytes are counted and hashed
where it stands, and only its digest moves.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm.shared import numbered, partitions, settled, table

BLOCK = 20_000


def difference(vectors: list[tuple[int, ...]]) -> tuple[list[list[int]], tuple[int, ...]]:
    """(for each vector the shard of each of its sums, the sums of all). Any number of shards; at least one vector."""
    k = len(vectors[0])
    nodes: list[tuple[int, int, list[int]]] = []
    heap = []
    orders = []
    for i, v in enumerate(vectors):
        order = sorted(range(k), key=lambda j: -v[j])
        sums = tuple(v[j] for j in order)
        orders.append(order)
        heap.append((sums[-1] - sums[0], i, sums))
    heapq.heapify(heap)
    n = len(vectors)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        both = [p + q for p, q in zip(x, reversed(y))]
        order = sorted(range(k), key=lambda j: -both[j])
        sums = tuple(both[j] for j in order)
        nodes.append((a, b, order))
        heapq.heappush(heap, (sums[-1] - sums[0], n + len(nodes) - 1, sums))
    shard = {heap[0][1]: list(range(k))}
    placed: list[list[int]] = [[]] * n
    todo = [heap[0][1]]
    while todo:
        at = todo.pop()
        own = shard.pop(at)
        if at < n:
            placed[at] = [0] * k
            for position, j in enumerate(orders[at]):
                placed[at][j] = own[position]
            continue
        a, b, order = nodes[at - n]
        left, right = [0] * k, [0] * k
        for position, j in enumerate(order):
            left[j], right[k - 1 - j] = own[position], own[position]
        shard[a], shard[b] = left, right
        todo += [a, b]
    return placed, heap[0][2]


def _level(items: DataFrame, blocks: int) -> DataFrame:
    """items (item, sums) -> (item, block, shards, sums): sums, once a block, are those of the whole block."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("item", kind="stable")
        placed, sums = difference([tuple(map(int, s)) for s in block["sums"]])
        return pd.DataFrame({"item": block["item"].to_numpy(), "block": block["block"].to_numpy(), "shards": placed, "sums": [list(sums), *[None] * (len(block) - 1)]})

    kind = items.schema["item"].dataType.simpleString()
    return items.withColumn("block", F.pmod(F.xxhash64("item", F.lit(blocks)), F.lit(blocks))).groupBy("block").applyInPandas(run, f"item {kind}, block long, shards array<int>, sums array<long>")


def balance(weights: DataFrame, shards: int = 8, block: int = BLOCK) -> DataFrame:
    """(item, weight) with distinct items -> (item, shard)."""
    items = weights.select("item", F.concat(F.array(F.col("weight").cast("long")), F.array_repeat(F.lit(0).cast("long"), shards - 1)).alias("sums"))
    count = weights.count()
    out, last = None, False
    while not last:
        blocks = -(-count // block) or 1
        last = blocks == 1
        level = settled(_level(items, blocks))
        own = level.select("item", "block", "shards")
        if out is None:
            out = own.select("item", "block", F.col("shards")[0].alias("shard"))
        else:
            up = own.select(F.col("item").alias("_below"), F.col("block").alias("_block"), "shards")
            out = out.join(up, F.col("block") == F.col("_below")).select("item", F.col("_block").alias("block"), F.col("shards")[F.col("shard")].alias("shard"))
        items = level.where("sums is not null").select(F.col("block").alias("item"), "sums")
        count = blocks
    return out.select("item", "shard")


def assign(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 8) -> DataFrame:
    """One row per row of ``df``: ``key``, size, text_crc32, law, shard, slot, grown_shard."""
    spark = df.sparkSession
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = settled(df.select(key, (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(whole, 256)).alias("item")))
    groups = settled(rows.groupBy("item").agg(F.sum("size").alias("weight")))
    joined = settled(rows.join(balance(groups, shards), "item"))
    slots = numbered(joined, ["shard"], [F.col(key), F.col("item")], [F.col(key)], "slot", partitions(spark))
    return slots.select(key, "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))
