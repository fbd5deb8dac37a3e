"""Sharding by longest-processing-time scheduling of groups that must stay together.

Law ``bytes``: the sum of sizes of each shard is near equal. Groups (equal texts) go, largest first, to
the least-loaded shard through a heap. At scale this runs in levels: groups of at least 4/LAST of all
bytes are items by themselves; all others are dealt by hash into buckets of bounded length, each bucket
is scheduled onto ``shards`` bins, and its bins are the next level's items. The last level holds LAST
items at most, or 8 for each shard, whatever the input.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.common import Scratch, runs

LAST = 16384
BUCKET = 16384
#: Rows of a shard numbered by one task, about; and rows up to which bucket starts are broadcast.
SLOT_ROWS, FEW = 250_000, 500_000


def longest_first(sizes: list[int], keys: list, shards: int) -> list[int]:
    """Shard of each item: largest first (ties by key) to the least-loaded shard (ties by number)."""
    heap = [(0, s) for s in range(shards)]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], keys[i])):
        load, s = heap[0]
        out[i] = s
        heapq.heapreplace(heap, (load + sizes[i], s))
    return out


def _bins(shards: int):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in runs(batches, ["bucket"]):
            bins = longest_first(g["size"].tolist(), g["item"].tolist(), shards)
            name = str(g["bucket"].iloc[0])
            yield pd.DataFrame({"item": g["item"].array, "bin": [f"{name}/{b}" for b in bins], "size": g["size"].array})

    return run


def schedule(items: DataFrame, shards: int, scratch: Scratch) -> DataFrame:
    """(item, shard) of items (item string unique, size long)."""
    now = scratch.write(items.select("item", F.col("size").cast("long").alias("size")), "items")
    maps: list[DataFrame] = []
    last, bucket = max(LAST, 8 * shards), max(BUCKET, 4 * shards)  # a level has less than half the rows of the one before, plus last / 2
    while True:
        n, total = now.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
        if n <= last:
            break
        large = F.col("size") * (last // 4) >= F.lit(total)
        k = -(-n // bucket)
        rest = now.where(~large).withColumn("bucket", F.concat(F.lit(f"{len(maps)}:"), F.pmod(F.xxhash64("item"), F.lit(k)).cast("string")))
        binned = rest.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(_bins(shards), "item string, bin string, size long")
        own = now.where(large).select("item", F.col("item").alias("bin"), "size")
        level = scratch.write(binned.union(own), "level")
        maps.append(level.select("item", "bin"))
        now = scratch.write(level.groupBy(F.col("bin").alias("item")).agg(F.sum("size").alias("size")), "items")
    rows = now.collect()  # at most ``last`` rows, by the loop's condition
    placed = longest_first([r["size"] for r in rows], [r["item"] for r in rows], shards)
    out = scratch.spark.createDataFrame([(r["item"], s) for r, s in zip(rows, placed)], "item string, shard int")
    for level in reversed(maps):
        out = level.join(out.withColumnRenamed("item", "bin"), "bin").select("item", "shard")
    return scratch.write(out, "shards")


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of docs (doc_id, text).

    size is the text's UTF-8 bytes plus 1; a null text has no bytes, and equals the empty text. Equal
    texts, repeated rows included, share a shard. Slots number a shard's rows from 0 without gaps, by
    doc_id within hash buckets. law is ``bytes``, so grown_shard is null. An empty table gives none.
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha1(text).alias("item")
    )
    rows = scratch.write(rows, "rows")
    groups = rows.groupBy("item").agg(F.sum("size").alias("size"))
    buckets = max(8, -(-rows.count() // (shards * SLOT_ROWS)))
    placed = rows.join(schedule(groups, shards, scratch), "item").withColumn("b", F.pmod(F.xxhash64("doc_id", "item"), F.lit(buckets)))
    placed = scratch.write(placed.select("doc_id", "size", "text_crc32", "shard", "b"), "placed")
    counts = placed.groupBy("shard", "b").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    starts = F.broadcast(starts) if shards * buckets <= FEW else starts
    own = Window.partitionBy("shard", "b").orderBy("doc_id", "text_crc32")
    return placed.join(starts, ["shard", "b"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.row_number().over(own) - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
