"""Sharding: longest-processing-time scheduling of groups that stay together."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.operators.state import cut, salted_rank, table

SHARDS = 16
#: Groups of at least this share of a shard are scheduled one by one; there are at most
#: SHARDS / ALONE of them whatever the input. Lesser groups are scheduled in runs of one class.
ALONE = 1 / 256
#: Size classes to a doubling; sizes of a class differ by at most one part in CLASSES.
CLASSES = 128
#: Runs that a class is dealt in, at most.
RUNS = 64


def size_class(size):  # Column -> Column
    """Order-preserving class of a positive size: exact below CLASSES, then CLASSES to a doubling."""
    power = F.greatest(F.floor(F.log2(size.cast("double"))) - int(np.log2(CLASSES)), F.lit(0))
    width = F.pow(F.lit(2.0), power)
    return (power * CLASSES * 4 + F.floor(size / width)).cast("long")


def run_of(key: int, n: int) -> int:
    """Groups of a class that go to a shard at once; keys below 0 are groups that count alone."""
    return 1 if key < 0 else max(1, -(-n // RUNS))


def schedule(units: list[tuple[int, int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """Longest first to the least-loaded shard, by a heap.

    units: (key, number of groups, their bytes in all). Gives (key, first rank, ranks, shard).
    """
    heap = [(0, s) for s in range(shards)]
    out = []
    for key, n, total in sorted(units, key=lambda u: (-u[2] / u[1], u[0])):
        run = run_of(key, n)
        for first in range(0, n, run):
            k = min(run, n - first)
            load, s = heapq.heappop(heap)
            heapq.heappush(heap, (load + total * k / n, s))
            out.append((key, first, k, s))
    return out


def longest_first(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard, group_bytes for every row of `docs`.

    Size is the text's UTF-8 bytes plus 1. Equal texts form a group and share a shard; null
    counts as the empty text. Groups go, largest first, to the least-loaded shard. A group of a
    256th of a shard or more is scheduled by itself; lesser ones by size class, in up to 64 runs,
    so the driver holds a number of entries that does not grow with the input. slot numbers a
    shard's rows from 0 without gaps. The law is `bytes`; a single group larger than a shard's
    share is the one thing that can make shards uneven. Null ids and repeated rows are rows like
    others. Other columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("same"))
    rows = table(rows.withColumn("row", F.monotonically_increasing_id()), "sizes")
    groups = table(rows.groupBy("same").agg(F.sum("size").alias("group_bytes")), "groups")
    total = groups.agg(F.sum("group_bytes")).first()[0] or 0
    alone = max(1, int(total / shards * ALONE))
    groups = groups.withColumn("class", F.when(F.col("group_bytes") < alone, size_class(F.col("group_bytes"))).otherwise(F.lit(-1) - F.col("group_bytes")))
    ranked = salted_rank(groups, ["class"], "same", "rank")
    units = [(r[0], r[1], r[2]) for r in groups.groupBy("class").agg(F.count(F.lit(1)), F.sum("group_bytes")).collect()]
    plan = spark.createDataFrame(schedule(units, shards), "class long, first long, ranks long, shard int")
    # The run of a rank follows from the class's size: an equi-join, not a range join.
    sizes = spark.createDataFrame([(k, run_of(k, n)) for k, n, _ in units], "class long, run long")
    ranked = ranked.join(F.broadcast(sizes), "class").withColumn("first", F.col("rank") - F.col("rank") % F.col("run"))
    placed = cut(ranked.join(F.broadcast(plan), ["class", "first"]).select("same", "group_bytes", "shard"))
    dealt = rows.join(placed, "same").select("id", "row", "size", "text_crc32", "shard", "group_bytes")
    out = salted_rank(dealt, ["shard"], "row", "slot")
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "group_bytes")
