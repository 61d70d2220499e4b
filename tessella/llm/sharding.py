"""Sharding by fixed virtual slots.

A record's slot never changes: it is a hash of the record, modulo a fixed number of slots. A small
table maps slots to shards; it is kept in versions, and rebalancing edits it instead of rehashing
records. Everything is DataFrame operations. The map has ``SLOTS`` rows whatever the data's size, so
it may be broadcast and be held in one row.

Null ids and texts hash as nulls; rows that are equal in id and text share a slot. An empty table
gives the full map and no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, refuse_taken

SLOTS = 4096


def virtual_slot(*columns: Column, slots: int = SLOTS) -> Column:
    """The fixed slot of a record."""
    return F.pmod(F.xxhash64(*columns), F.lit(slots)).cast("int")


def slot_sizes(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Bytes and rows of every slot, the empty ones included: (virtual_slot, bytes, rows)."""
    used = records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    every = records.sparkSession.range(0, slots, 1, 1).select(F.col("id").cast("int").alias("virtual_slot"))
    zero = F.lit(0).cast("bigint")
    return every.join(F.broadcast(used), "virtual_slot", "left").select(
        "virtual_slot", F.coalesce("bytes", zero).alias("bytes"), F.coalesce("rows", zero).alias("rows")
    )


def _place(sized: DataFrame, loads: Column) -> Column:
    """Largest slot first, each to the shard with the fewest bytes so far (lowest number on ties)."""
    order = F.array_sort(F.collect_list(F.when(F.col("shard").isNull(), F.struct((-F.col("bytes")).alias("minus"), F.col("virtual_slot").alias("slot")))))

    def step(state, slot):
        lightest = (F.array_position(state["loads"], F.array_min(state["loads"])) - 1).cast("int")
        return F.struct(
            F.transform(state["loads"], lambda x, i: F.when(i == lightest, x - slot["minus"]).otherwise(x)).alias("loads"),
            F.concat(state["placed"], F.array(F.struct(slot["slot"].alias("virtual_slot"), lightest.alias("shard")))).alias("placed"),
        )

    empty = F.array().cast("array<struct<virtual_slot:int,shard:int>>")
    return F.aggregate(order, F.struct(loads.alias("loads"), empty.alias("placed")), step, lambda state: state["placed"])


def _placed(sized: DataFrame, shards: int) -> DataFrame:
    """Slots without a shard get one; the others keep theirs and count as load."""
    per_shard = [F.coalesce(F.sum(F.when(F.col("shard") == s, F.col("bytes"))), F.lit(0)).cast("bigint") for s in range(shards)]
    kept = F.collect_list(F.when(F.col("shard").isNotNull(), F.struct("virtual_slot", "shard")))
    one = sized.agg(F.concat(kept, _place(sized, F.array(*per_shard))).alias("slots"))
    return one.select(F.explode("slots").alias("s")).select("s.virtual_slot", "s.shard")


def first_map(sizes: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the map: shards of nearly equal bytes. (virtual_slot, shard)"""
    return _placed(sizes.withColumn("shard", F.lit(None).cast("int")), shards)


def rebalance(slot_map: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """An edited map for ``shards`` shards: slots leave only shards that are over their share, or gone.

    A shard keeps its slots, largest first, up to the share (total bytes / shards). What is over
    goes to the lightest shards, so a new shard only receives and no slot moves between two full ones.
    """
    total = sizes.agg(F.sum("bytes")).scalar()
    upto = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    stays = (F.col("shard") < shards) & (F.sum("bytes").over(upto) <= F.ceil(total / shards))
    sized = slot_map.join(F.broadcast(sizes), "virtual_slot")
    return _placed(sized.withColumn("shard", F.when(stays, F.col("shard"))).select("virtual_slot", "bytes", "shard"), shards)


def save_map(slot_map: DataFrame, folder: str, version: int) -> None:
    """Write one version; a version is never written over."""
    slot_map.coalesce(1).write.parquet(f"{folder}/version={version}")


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """One version of the map, by default the latest: (virtual_slot, shard, version)."""
    versions = spark.read.schema("virtual_slot int, shard int, version int").parquet(folder)
    if version is None:
        version = versions.agg(F.max("version")).first()[0]
    return versions.filter(F.col("version") == version)


def place(records: DataFrame, slot_map: DataFrame, sizes: DataFrame, order: list[str], into: tuple[str, str, str] = ("shard", "version", "slot")) -> DataFrame:
    """Records with their shard, the map's version and their gapless position in the shard, from 0.

    The position is the rows of the shard's earlier slots plus the rank within the slot, so no
    window holds more than one slot. ``into`` names the three new columns; a name that the records
    have already is an error. Other columns of the records are passed through, whatever their names.
    """
    refuse_taken(records.columns, into)
    shard, version, slot = into
    rows_before, in_slot = free_name(records, "rows_before"), free_name(records, "in_slot")
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slot_map.join(F.broadcast(sizes), "virtual_slot").select(
        "virtual_slot", F.col("shard").alias(shard), F.col("version").alias(version), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias(rows_before)
    )
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(*order))
    return (
        records.withColumn(in_slot, rank)
        .join(F.broadcast(offsets), "virtual_slot")
        .withColumn(slot, (F.col(rows_before) + F.col(in_slot) - 1).cast("bigint"))
        .drop(rows_before, in_slot)
    )
