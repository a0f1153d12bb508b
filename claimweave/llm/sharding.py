"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing, level by level."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import doc_key, key_to_id, materialize, whole_text

#: Groups that one task differences at a time, composites that it leaves, small groups that it passes on whole.
BUCKET, COMPOSITES, FILLERS = 4_096, 256, 64
#: Items of the last differencing, which the driver does; the bound does not grow with the data.
LAST = 16_384
#: Rows of a block of slots.
SLOT_BLOCK = 4_096


def karmarkar_karp(weights: list[int], parts: int) -> list[int]:
    """Part 0..parts-1 of each weight, near equal in sum.

    The two partial partitions with the largest spread are combined until one is left, the largest sum of
    one with the smallest of the other. Ties go by position, so equal input gives equal output.
    """
    if not weights:
        return []
    # a partial partition: sums in falling order, and how its positions came from its halves
    heap = [(-w, k, [w] + [0] * (parts - 1), None) for k, w in enumerate(weights)]
    heapq.heapify(heap)
    made = len(weights)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        sums = [x + y for x, y in zip(a[2], reversed(b[2]))]
        order = sorted(range(parts), key=sums.__getitem__, reverse=True)
        sums = [sums[k] for k in order]
        heapq.heappush(heap, (sums[-1] - sums[0], made, sums, (a, b, order)))
        made += 1
    out = [0] * len(weights)
    stack = [(heap[0], list(range(parts)))]
    while stack:
        (_, number, _, halves), label = stack.pop()
        if halves is None:
            out[number] = label[0]
            continue
        a, b, order = halves
        left, right = [0] * parts, [0] * parts
        for position, k in enumerate(order):
            left[k] = right[parts - 1 - k] = label[position]
        stack += [(a, left), (b, right)]
    return out


def _compose(items: DataFrame, heavy: float, level: int) -> DataFrame:
    """Rows (item, weight, up): items of a bucket are differenced into COMPOSITES composite items.

    Items heavier than ``heavy`` and the FILLERS lightest of each bucket stay items of their own (up = item),
    so that the next level can still place large groups alone and even out the last bytes.
    """
    n = items.count()
    buckets = max(1, -(-n // BUCKET))

    def difference(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "item"], ascending=[False, True], ignore_index=True)
        weights = pdf["weight"].to_numpy()
        bucket = int(pdf["bucket"].iloc[0])
        alone = weights > heavy
        alone[max(0, len(weights) - FILLERS) :] = True
        up = pdf["item"].to_numpy(dtype=object).copy()
        rest = np.flatnonzero(~alone)
        up[rest] = [f"{level}-{bucket}-{p}" for p in karmarkar_karp(weights[rest].tolist(), COMPOSITES)]
        return pd.DataFrame({"item": pdf["item"], "weight": weights, "up": up})

    return items.withColumn("bucket", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(buckets))).groupBy("bucket").applyInPandas(difference, "item string, weight long, up string")


def balance(groups: DataFrame, n_shards: int) -> DataFrame:
    """Rows (item, shard) for the groups (item string, unique; weight long), near equal in weight by shard.

    Each level replaces about 4096 groups by 320, all in tasks of bounded size; the last LAST items or fewer
    are differenced on the driver. A group heavier than a 64th of a shard is never merged before that, and
    there are at most 64 x n_shards of these.
    """
    spark = groups.sparkSession
    total = groups.agg(F.sum("weight")).first()[0] or 0
    heavy = total / n_shards / 64
    steps, now = [], groups
    while now.count() > LAST:
        step = materialize(_compose(now, heavy, len(steps)), "difference")
        steps.append(step)
        now = step.groupBy(F.col("up").alias("item")).agg(F.sum("weight").alias("weight"))
    last = now.select("item", "weight").toPandas().sort_values(["weight", "item"], ascending=[False, True])
    last["shard"] = np.array(karmarkar_karp(last["weight"].tolist(), n_shards), dtype=np.int32)
    placed = spark.createDataFrame(last[["item", "shard"]], "item string, shard int")
    for step in reversed(steps):
        placed = step.join(placed.withColumnRenamed("item", "up"), "up").select("item", "shard")
    return placed


def shard_documents(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """Rows (key, size, text_crc32, shard, slot): all rows of ``docs`` (doc_id, text) in shards near equal in bytes.

    Size is the UTF-8 length of the text plus 1 (null: 1). Equal texts, null like empty, form a group that
    is never split; groups are told apart by SHA-256. Slots are gapless from 0 in each shard; they are
    counted by hash blocks of bounded size, so no task holds a shard. Rows that repeat a doc_id take a slot each.
    """
    base = materialize(
        docs.select(doc_key().alias("key"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.encode(whole_text(), "UTF-8")).alias("text_crc32"), F.sha2(whole_text(), 256).alias("item")),
        "sizes",
    )
    groups = base.groupBy("item").agg(F.sum("size").alias("weight"))
    placed = materialize(base.join(balance(groups, n_shards), "item").select("key", "size", "text_crc32", "shard", "item"), "placed")
    blocks = max(1, -(-placed.count() // SLOT_BLOCK))
    dealt = placed.withColumn("block", F.pmod(F.xxhash64("key", "item"), F.lit(blocks)))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "block").agg(F.count("*").alias("n")).select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "block").orderBy("key", "item")
    return (
        dealt.withColumn("nth", F.row_number().over(inside) - 1)
        .join(starts, ["shard", "block"])
        .select("key", "size", "text_crc32", "shard", (F.col("start") + F.col("nth")).alias("slot"))
    )


def sharding_result(docs: DataFrame) -> DataFrame:
    """The columns of op2; the law is ``bytes``, so no shard count is grown."""
    return shard_documents(docs).select(key_to_id("key").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding_result(spark.read.parquet(f"{sf_dir}/documents.parquet"))
