"""Sharding by longest-processing-time scheduling.

Rows with equal texts form a group that must stay in one shard.  Groups are jobs, sorted by
size, and a heap hands each to the least-loaded shard.  Only a bounded number of jobs reaches
that heap: every group above ``total / (shards * FINE)`` bytes is a job of its own (there can be
at most ``shards * FINE`` of them), and the smaller groups are bundled by hash into
``LEVELS * SLOTS`` jobs whose sizes fall geometrically, so the last jobs placed are tiny and
even out what the large ones left.  The bound holds at every input size.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import numbered, stored, table

FINE, LEVELS, SLOTS = 256, 13, 512
FILE_BYTES = 256 << 20


def lpt(sizes: dict, shards: int) -> dict:
    """Job -> shard: jobs by falling size (ties by key), each to the shard with the least load (ties by number)."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for job in sorted(sizes, key=lambda j: (-sizes[j], j)):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + sizes[job], shard))
        placed[job] = shard
    return placed


def sizes(docs: DataFrame, text: str = "text") -> tuple[Column, Column, Column]:
    """UTF-8 bytes plus 8, unsigned crc32 and the group key (sha-256; null texts are one group of their own)."""
    t = F.col(text)
    return F.coalesce(F.octet_length(t), F.lit(0)).cast("long") + 8, F.crc32(F.coalesce(t, F.lit(""))), F.coalesce(F.unhex(F.sha2(t, 256)), F.lit(b""))


def _bundle(group: Column) -> Column:
    """Job number of a small group: half of the groups spread over SLOTS jobs, a quarter over the next SLOTS, ..."""
    h = F.xxhash64(group)
    level = F.least(F.bit_count(h.bitwiseAND(-h) - 1), F.lit(LEVELS - 1))
    return (level * SLOTS + F.pmod(F.shiftrightunsigned(h, 20), F.lit(SLOTS))).cast("long")


def assign_shards(rows: DataFrame, shards: int = 24, size: str = "size", group: str = "group") -> DataFrame:
    """rows with a ``shard`` column.

    rows needs a non-negative ``size`` and a non-null ``group``; equal groups share a shard.
    An empty table gives an empty table; repeated rows count as often as they occur.
    """
    spark = rows.sparkSession
    groups = stored(rows.groupBy(group).agg(F.sum(size).alias("bytes")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    least = total / (shards * FINE)
    large = groups.where(F.col("bytes") > least)
    own = [(bytes(r[0]), r[1]) for r in large.select(group, "bytes").collect()]  # fewer than shards * FINE
    small = groups.where(F.col("bytes") <= least).groupBy(_bundle(F.col(group)).alias("job")).agg(F.sum("bytes").alias("bytes"))
    jobs = {("bundle", r[0], b""): r[1] for r in small.collect()}  # at most LEVELS * SLOTS
    jobs |= {("group", 0, g): b for g, b in own}
    placed = lpt(jobs, shards)
    by_bundle = spark.createDataFrame([(j[1], s) for j, s in placed.items() if j[0] == "bundle"] or [(-1, 0)], "job long, bundle_shard int")
    by_group = spark.createDataFrame([(bytearray(j[2]), s) for j, s in placed.items() if j[0] == "group"] or [(bytearray(b"-"), 0)], f"`{group}` binary, own_shard int")
    out = rows.join(F.broadcast(by_group), group, "left").withColumn("job", _bundle(F.col(group))).join(F.broadcast(by_bundle), "job", "left")
    return out.withColumn("shard", F.coalesce("own_shard", "bundle_shard")).drop("job", "own_shard", "bundle_shard")


def shard_plan(docs: DataFrame, shards: int = 24) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law ``bytes``: shard sizes are near equal.  Slots number a shard's rows from 0 by doc_id
    (nulls first; rows with equal doc_id by crc).  A null text counts 8 bytes, crc 0.
    """
    size, crc, group = sizes(docs)
    slim = docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"), group.alias("group"))
    placed = assign_shards(slim, shards).drop("group")
    out = numbered(placed, "shard", ["doc_id", "text_crc32"], "slot", "shards")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """All columns of docs and ``shard``.  Clashing names (size, group, shard) are replaced only for shard."""
    size, _, group = sizes(docs)
    names = docs.columns
    rows = docs.select(*[F.col(f"`{c}`").alias(f"d{i}") for i, c in enumerate(names)], size.alias("size"), group.alias("group"))
    placed = assign_shards(rows, shards)
    return placed.select(*[F.col(f"d{i}").alias(c) for i, c in enumerate(names) if c != "shard"], "shard")


def write_shards(docs: DataFrame, path: str, shards: int = 24, file_bytes: int = FILE_BYTES) -> None:
    """Writes one folder per shard (shard=K) in files of about file_bytes: each shard is split over as many tasks as its bytes ask for."""
    out = shard_documents(docs, shards)
    total = docs.agg(F.sum(sizes(docs)[0])).first()[0] or 0
    parts = max(1, -(-total // (shards * file_bytes)))
    # rows are dealt out in turn: also copies of one text spread
    out.repartition(shards * parts, "shard", F.pmod(F.monotonically_increasing_id(), F.lit(parts))).write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_plan(table(spark, sf_dir, "documents"))
