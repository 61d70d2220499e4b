"""op8 against a plain placement in Python, and placed records with columns of any name."""

import struct
import zlib

import pytest
import xxhash
from conftest import SMALL
from pyspark.sql import functions as F

from tessella.llm import queries, sharding


def plain_slot(doc_id, text):
    """Nulls leave the hash as it is; each value is hashed with the hash so far as seed."""
    seed = 42
    if doc_id is not None:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", doc_id), seed)
    if text is not None:
        seed = xxhash.xxh64_intdigest(text.encode(), seed)
    return seed % sharding.SLOTS


def plain_rows(docs, shards=8):
    records = []
    for doc_id, text in docs:
        raw = (text or "").encode()
        records.append((plain_slot(doc_id, text), doc_id, zlib.crc32(raw), len(raw) + 1))
    loads, shard_of, size_of = [0] * shards, {}, dict.fromkeys(range(sharding.SLOTS), 0)
    for slot, _, _, size in records:
        size_of[slot] += size
    for slot in sorted(size_of, key=lambda s: (-size_of[s], s)):
        shard_of[slot] = loads.index(min(loads))
        loads[shard_of[slot]] += size_of[slot]
    filled, out = [0] * shards, []
    null_first = lambda r: (r[0], r[1] is not None, r[1] or 0, r[2], r[3])
    for slot, doc_id, crc, size in sorted(records, key=null_first):
        shard = shard_of[slot]
        out.append((doc_id, size, crc, "bytes", shard, filled[shard], None, slot, 1))
        filled[shard] += 1
    return out


def as_bag(found):
    return sorted(map(repr, found))


def test_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert as_bag(tuple(r) for r in queries.op8_virtual_slots(spark, SMALL).collect()) == as_bag(plain_rows(docs))


def test_query_awkward_rows(spark, tmp_path):
    docs = [(1, None), (2, ""), (None, "x"), (None, "x"), (None, None), (5, "same"), (5, "same"), (7, "é" * 100_000)]
    for name, given in (("some", docs), ("none", [])):
        spark.createDataFrame(given, "doc_id bigint, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        assert as_bag(tuple(r) for r in queries.op8_virtual_slots(spark, f"{tmp_path}/{name}").collect()) == as_bag(plain_rows(given))


def test_names_that_clash(spark):
    records = spark.range(200).select(
        "id", F.lit(1).alias("size"), sharding.virtual_slot(F.col("id"), slots=8).alias("virtual_slot"),
        F.lit("a").alias("rows_before"), F.lit("b").alias("In_Slot"), F.lit("c").alias("bytes"), F.lit("d").alias("rows"), F.lit("e").alias("Shard"),
    )
    sizes = sharding.slot_sizes(records.select("virtual_slot", "size"), 8)
    slot_map = sharding.first_map(sizes, 3).withColumn("version", F.lit(1))
    with pytest.raises(ValueError, match="Shard|shard"):
        sharding.place(records, slot_map, sizes, ["id"])
    placed = sharding.place(records, slot_map, sizes, ["id"], into=("to_shard", "map_version", "slot"))
    assert set(placed.columns) == {*records.columns, "to_shard", "map_version", "slot"}
    found = placed.toPandas()
    assert len(found) == 200 and set(found["In_Slot"]) == {"b"} and set(found["Shard"]) == {"e"}
    for _, group in found.groupby("to_shard"):
        assert sorted(group.slot) == list(range(len(group)))
