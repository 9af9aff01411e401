"""Longest-processing-time sharding: groups that must stay together, largest first, go to the least-loaded shard by a heap.

The heap runs on the driver over a bounded table whatever the input: every group above total / (shards * FINE) stands alone
(there are at most shards * FINE of these) and the smaller groups are pre-aggregated into shards * FINE bundles by a hash of
their key. Groups never split. A group in a bundle is at most 1 / FINE of a shard's fair share, a bundle holds the same on average,
but by chance of the hash several of the larger groups can meet in one; so loads end within the largest bundle or group of each
other. A single group above a shard's share makes its shard larger than the others.

Slots are dense within a shard: counts per (shard, bucket) are summed up, then rows are numbered within a bucket, so that a
shard with most of the rows is numbered by many tasks.

Defined results: null texts form one group of empty content; texts of any length are weighed whole; equal texts share a shard; a
table without rows gives none; rows with equal doc_id and text are numbered in an arbitrary but gapless order; a null doc_id stays
null; columns other than doc_id and text, whatever their names, do not matter.
"""

from __future__ import annotations

import heapq
import zlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm.common import as_bytes, materialize

FINE = 64
#: Rows that one task numbers.
BUCKET_ROWS = 200_000


def lpt(loads: list[tuple[int, str]], shards: int) -> dict[str, int]:
    """Assign (size, name) to shards: largest first, ties by name, each to the least-loaded shard, ties to the smaller shard."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for size, name in sorted(loads, key=lambda x: (-x[0], x[1])):
        load, s = heapq.heappop(heap)
        placed[name] = s
        heapq.heappush(heap, (load + size, s))
    return placed


def assign_shards(rows: DataFrame, group: str, size: str, shards: int) -> DataFrame:
    """rows with a column shard. group names a non-null string column, size a long column; rows is read three times, so pass a table."""
    spark = rows.sparkSession
    n = shards * FINE
    sums = materialize(rows.groupBy(group).agg(F.sum(size).alias("load")), "groups")
    total = sums.agg(F.sum("load")).head()[0] or 0
    bundle = F.pmod(F.crc32(F.col(group).cast("binary")), F.lit(n)).cast("int")
    large = F.col("load") > total / n
    big = {r[0]: r[1] for r in sums.where(large).select(group, "load").collect()}  # at most n rows
    small = {r[0]: r[1] for r in sums.where(~large).groupBy(bundle.alias("bundle")).agg(F.sum("load")).collect()}  # at most n rows
    placed = lpt([(v, f"g{k}") for k, v in big.items()] + [(v, f"b{k:06d}") for k, v in small.items()], shards)
    names = spark.createDataFrame([(k, placed[f"g{k}"]) for k in big], T.StructType([T.StructField("g__key", T.StringType()), T.StructField("g__shard", T.IntegerType())]))
    of_bundle = F.array(*[F.lit(placed.get(f"b{k:06d}", 0)) for k in range(n)])
    out = rows.join(F.broadcast(names), rows[group] == names.g__key, "left")  # at most n rows
    return out.withColumn("shard", F.coalesce("g__shard", F.element_at(of_bundle, bundle + 1)).cast("int")).drop("g__key", "g__shard")


def number_rows(rows: DataFrame, by: list[Column], buckets: int) -> DataFrame:
    """rows with a long column slot, gapless from 0 within each shard; rows is read twice."""
    bucketed = rows.withColumn("n__bucket", F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int"))
    counts = bucketed.groupBy("shard", "n__bucket").agg(F.count(F.lit(1)).alias("n__rows"))
    before = Window.partitionBy("shard").orderBy("n__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("n__start", F.coalesce(F.sum("n__rows").over(before), F.lit(0))).select(F.col("shard").alias("s__shard"), F.col("n__bucket").alias("s__bucket"), "n__start")
    own = bucketed.withColumn("n__own", F.row_number().over(Window.partitionBy("shard", "n__bucket").orderBy(*by)) - 1)
    joined = own.join(starts, (own.shard == starts.s__shard) & (own.n__bucket == starts.s__bucket))
    return joined.withColumn("slot", (F.col("n__start") + F.col("n__own")).cast("long")).drop("n__bucket", "n__start", "n__own", "s__shard", "s__bucket")


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) with law `bytes`: sizes near equal, equal texts together."""
    body = as_bytes()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).cast("long").alias("text_crc32"), F.sha2(body, 256).alias("key"))
    rows = materialize(rows, "sized")
    placed = materialize(assign_shards(rows, "key", "size", shards), "placed")
    buckets = max(64, -(-placed.count() // BUCKET_ROWS))
    slotted = number_rows(placed, [F.col("doc_id"), F.col("key")], buckets)
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), 24)


def shard_of_bundle(key: str, shards: int) -> int:
    """The bundle of a group key, as assign_shards computes it; for tests."""
    return zlib.crc32(key.encode()) % (shards * FINE)
