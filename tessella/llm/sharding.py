"""Sharding by fixed virtual slots.

A record's key is hashed into one of ``slots`` virtual slots, for ever. A small
stored table maps slots to shards. It has versions: the first deals slots out
evenly, each later one is stored as the slots that it moves, and no version is
ever changed. ``grown`` adds a shard that takes an equal share of slots from each
of the others and moves nothing else, and which slots these are depends on the
slot's number and the shard count only (the law ``key``). ``rebalanced`` moves
slots from heavy to light shards by the bytes that records have in each slot.

The map has ``slots`` rows whatever the data's size, so it is sent to every
executor; records are never moved to compute it. Rows and bytes per slot are
partial sums before they are shuffled.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.shared import new_path, remove, written

SLOTS = 8192
#: Bytes that a record takes besides its text.
OVERHEAD = 16
#: Rows of a slot that are numbered in one task; a slot with more is numbered in parts.
PART_ROWS = 100_000
MAP_SCHEMA = T.StructType([T.StructField(n, T.LongType(), False) for n in ("version", "slot", "shard")])


def _order(slot: int, count: int) -> int:
    return int.from_bytes(hashlib.sha256(f"{slot}:{count}".encode()).digest()[:8])


def first_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Shard of each slot, for one shard at first and then grown one by one; so any count is reached by moves into new shards only."""
    owner = [0] * slots
    for count in range(2, shards + 1):
        owner = grown(owner, count)
    return owner


def grown(owner: list[int], count: int) -> list[int]:
    """The map for ``count`` shards from that for one less: the new shard takes its share of slots, a few from each old one."""
    share = len(owner) // count
    by_shard: dict[int, list[int]] = {s: [] for s in range(count - 1)}
    for slot, shard in enumerate(owner):
        by_shard[shard].append(slot)
    queues = {s: sorted(v, key=lambda x: _order(x, count)) for s, v in by_shard.items()}
    out = list(owner)
    for _ in range(share):
        fullest = max(queues, key=lambda s: (len(queues[s]), -s))
        out[queues[fullest].pop(0)] = count - 1
    return out


def rebalanced(owner: list[int], sizes: list[int], most: float = 1.02) -> list[int]:
    """The map after moving slots, largest first, from shards above ``most`` times the mean to the lightest ones."""
    shards = max(owner) + 1
    load = [0] * shards
    held: list[list[int]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(owner):
        load[shard] += sizes[slot]
        held[shard].append(slot)
    out, mean = list(owner), sum(load) / shards
    for shard in sorted(range(shards), key=lambda s: -load[s]):
        for slot in sorted(held[shard], key=lambda x: (-sizes[x], x)):
            lightest = min(range(shards), key=lambda s: (load[s], s))
            if load[shard] <= most * mean:
                break
            if lightest != shard and load[lightest] + sizes[slot] < load[shard]:
                out[slot] = lightest
                load[shard] -= sizes[slot]
                load[lightest] += sizes[slot]
    return out


def store_map(spark: SparkSession, path: str, version: int, owner: list[int]) -> None:
    """Adds a version to the stored map: all slots at first, then those that differ from the version before. A version that is there already is an error."""
    try:
        before = load_map(spark, path, version - 1) if version > 1 else None
        if version <= spark.read.parquet(path).agg(F.max("version")).first()[0]:
            raise ValueError(f"the map has a version {version} already")
    except AnalysisException:
        if version > 1:
            raise
        before = None
    rows = [(version, slot, shard) for slot, shard in enumerate(owner) if before is None or before[slot] != shard]
    spark.createDataFrame(rows or [(version, -1, -1)], MAP_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def stored_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """slot, shard of one version of a stored map, the latest by default: of each slot the last edit up to it."""
    rows = spark.read.schema(MAP_SCHEMA).parquet(path).where("slot >= 0")
    rows = rows if version is None else rows.where(F.col("version") <= version)
    return rows.groupBy("slot").agg(F.max_by("shard", "version").alias("shard"))


def load_map(spark: SparkSession, path: str, version: int | None = None) -> list[int]:
    """A version as a list: the shard of each slot."""
    return [r["shard"] for r in stored_map(spark, path, version).orderBy("slot").collect()]


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of each row; texts go no further.

    A null text has no bytes and the checksum of the empty text; null doc_ids
    share a slot; repeated rows stay; very long texts are read whole; an empty
    table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), slot_of(F.col("doc_id").cast("long"), slots).alias("virtual_slot"))


def slot_totals(found: DataFrame) -> DataFrame:
    """virtual_slot, slot_rows, slot_bytes: of the slots that have records, so at most as many rows as there are slots."""
    return found.groupBy("virtual_slot").agg(F.count("*").alias("slot_rows"), F.sum("size").alias("slot_bytes"))


def slot_bytes(totals: DataFrame, slots: int = SLOTS) -> list[int]:
    """Bytes in each slot, for ``rebalanced``: at most ``slots`` rows reach the driver."""
    sizes = {r["virtual_slot"]: r["slot_bytes"] for r in totals.collect()}
    return [sizes.get(s, 0) for s in range(slots)]


def assigned(docs: DataFrame, shards: int, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """``records`` with their shard, the shard with one more of them, their place in the shard (gapless from 0) and their virtual slot's bytes.

    The map is stored at ``path`` (a new one by default) as version 1 and, with
    one more shard, version 2; both are read from there. Places are dealt slot
    by slot. A slot of more than ``PART_ROWS`` rows is numbered in parts by the
    row's number, so neither a hot slot nor copies of one record meet in one task.
    """
    spark = docs.sparkSession
    at = path or new_path(spark, "slot-map")
    owner = first_map(shards, slots)
    store_map(spark, at, 1, owner)
    store_map(spark, at, 2, grown(owner, shards + 1))
    found = written(records(docs, slots).withColumn("row", F.monotonically_increasing_id()), "records")
    totals = slot_totals(found).withColumn("parts", F.ceil(F.col("slot_rows") / PART_ROWS).cast("int"))
    first = stored_map(spark, at, 1).select(F.col("slot").cast("int").alias("virtual_slot"), F.col("shard").cast("int").alias("shard"))
    second = stored_map(spark, at, 2).select(F.col("slot").cast("int").alias("virtual_slot"), F.col("shard").cast("int").alias("grown_shard"))
    table = written(totals.join(first, "virtual_slot").join(second, "virtual_slot"), "slots")  # at most ``slots`` rows
    if path is None:
        remove(spark, at)
    found = found.join(F.broadcast(table), "virtual_slot").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    counts = found.groupBy("shard", "virtual_slot", "part").agg(F.count("*").alias("n"))  # a row for every PART_ROWS, besides one for each slot
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1))
    start = counts.select("virtual_slot", "part", F.coalesce(before, F.lit(0)).alias("start"))
    number = F.row_number().over(Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "row")) - 1
    return found.withColumn("number", number).join(start, ["virtual_slot", "part"]).withColumn("slot", (F.col("start") + F.col("number")).cast("long"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards under the law ``key``."""
    found = assigned(spark.read.parquet(f"{sf_dir}/documents.parquet"), 40)
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "virtual_slot", "slot_bytes")
