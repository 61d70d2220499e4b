"""Blocks, vocabularies and packing against plain loops, also with hot keys."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import blocks as B
from tessella.operators import ordering as O


def texts(spark, rows):
    return spark.createDataFrame(rows, "key long, text string")


def test_golden_blocks(spark):
    made = B.token_blocks(texts(spark, [(0, "a b  c"), (1, ""), (2, "\td e")]), 2).orderBy("block_id").collect()
    assert [(r.block_id, r.tokens) for r in made] == [(0, ["a", "b"]), (1, ["c", "d"])]
    with pytest.raises(ValueError, match="no token blocks"):
        B.require_blocks(B.token_blocks(texts(spark, [(0, "a")]), 2))


@pytest.mark.parametrize("parts", [1, 4, 64])
@pytest.mark.parametrize("length", [1, 7, 64])
def test_blocks_against_loop(spark, parts, length):
    """One text holds a third of all tokens; many are empty; keys reach over several chunks."""
    rng = random.Random(3)
    rows = [(i * 7, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([0, 0, 1, 5, 9])))) for i in range(600)]
    total = sum(len(t.split()) for _, t in rows)
    rows[11] = (77, " ".join(f"h{i}" for i in range(total // 2)))
    joined = " ".join(t for _, t in rows).split()
    expected = [joined[i : i + length] for i in range(0, len(joined) - len(joined) % length, length)]
    made = B.token_blocks(texts(spark, rows).repartition(parts), length)
    assert [r.tokens for r in made.orderBy("block_id").collect()] == expected


def test_text_column_is_required(spark):
    with pytest.raises(ValueError, match="expected a 'text' column"):
        B.read_texts(spark.range(1), "id")


def test_mask_and_preview(spark):
    blocks = spark.createDataFrame([(0, ["<|x|>", "a", "b"]), (1, ["c" * 300, "d" * 99, "e"]), (2, ["f"])], "block_id long, tokens array<string>")
    assert B.with_attention_mask(blocks, 3).first().attention_mask == [1, 1, 1]
    shown = B.preview_blocks(blocks, 2, show_ids=True).orderBy("block_id").collect()
    assert [r.preview for r in shown] == ["a b", "c" * 300 + " " + "d" * 99 + " …"]
    assert shown[0].tokens == ["<|x|>", "a", "b"]


@pytest.mark.parametrize("limit", [O.BROADCAST_BYTES, 0])
def test_encode_and_decode(spark, limit, monkeypatch):
    """The same results with the vocabulary broadcast and with salted keys; one word is hot."""
    monkeypatch.setattr(O.join_checked, "__defaults__", ("inner", limit, 32))
    rows = [(i, "the " * 40 + f"x{i % 5} <|end|>") for i in range(50)]
    source = texts(spark, rows)
    vocab = B.build_vocabulary(source)
    coded = B.encode(source, vocab)
    assert coded.count() == 50 and coded.filter(F.size("ids") != 42).count() == 0
    back = {r.key: r.text for r in B.decode(coded, vocab).collect()}
    assert back == {k: " ".join(t.split()) for k, t in rows}
    plain = {r.key: r.text for r in B.decode(coded, vocab, skip_special=True).collect()}
    assert plain[3] == ("the " * 40 + "x3")


def test_large_vocabulary_is_looked_up_by_buckets(spark, monkeypatch):
    """With a vocabulary beyond the broadcast: the same ids and texts."""
    monkeypatch.setattr(O, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(B, "BUCKET_BYTES", 512)
    rows = [(None, "the z"), (-5, ""), (-6, "   "), *[(i, "the " * 40 + f"x{i % 5} <|end|>") for i in range(50)]]
    source = spark.createDataFrame(rows, "key long, text string")
    vocab = B.build_vocabulary(source)
    ids = {r.token: r.id for r in vocab.collect()}
    coded = B.encode(source, vocab)
    assert {r.key: r.ids for r in coded.collect()} == {k: [ids[w] for w in t.split()] for k, t in rows}
    assert {r.key: r.text for r in B.decode(coded, vocab).collect()} == {k: " ".join(t.split()) for k, t in rows}
    nested = coded.select("key", F.array("ids", F.slice("ids", 1, 1)).alias("ids"))
    assert {(r.key, r.row): r.text for r in B.decode(nested, vocab).collect()} == {(k, n): " ".join(t.split()[: 1 if n else None]) for k, t in rows for n in (0, 1)}
    few = vocab.filter("token <> 'the'")
    assert {r.key: r.ids for r in B.encode(source, few, unknown=99).collect()} == {k: [99 if w == "the" else ids[w] for w in t.split()] for k, t in rows}
    with pytest.raises(Exception, match="not in the vocabulary"):
        B.encode(source, few).collect()


def test_id_shapes(spark):
    flat = spark.createDataFrame([(1, [3, 4])], "k long, ids array<int>")
    assert [(r.row, r.ids) for r in B.as_rows(flat, "k", "ids").collect()] == [(0, [3, 4])]
    nested = spark.createDataFrame([(1, [[3], [4, 5]])], "k long, ids array<array<int>>")
    assert [(r.row, r.ids) for r in B.as_rows(nested, "k", "ids").orderBy("row").collect()] == [(0, [3]), (1, [4, 5])]
    with pytest.raises(ValueError, match="one or two dimensional"):
        B.as_rows(spark.createDataFrame([(1, [[[3]]])], "k long, ids array<array<array<int>>>"), "k", "ids")


@pytest.mark.parametrize("shards", [1, 20])
def test_packing(spark, shards):
    lengths = spark.range(2000).select(F.col("id").alias("key"), (F.col("id") * 37 % 700 + 1).alias("num_tokens"))
    packed = B.pack_sequences(lengths, 512, shards)
    assert packed.count() == 2000 and packed.select("key").distinct().count() == 2000
    assert {r.shard for r in packed.select("shard").distinct().collect()} == set(range(shards))
    stats = B.packing_stats(packed, 512).first()
    assert stats.fullest_bin <= 512 and stats.sequences == 2000 and stats.fill > 0.6
    values = [i * 37 % 700 + 1 for i in range(2000)]
    assert stats.truncated_tokens == sum(max(0, v - 512) for v in values)
    again = B.pack_sequences(lengths.repartition(64), 512, shards)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, packed.collect()))


def test_checked_join_spreads_a_hot_key(spark):
    big = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id")
    small = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    narrow = O.join_checked(big, small, ["k"], ["id"], limit=0)
    assert sorted(map(tuple, narrow.collect())) == sorted(map(tuple, big.join(small, "k").collect()))
    assert [r.k for r in O._hot_keys(big, ["k"]).collect()] == [7]
    left = O.join_checked(big, small.filter("k = 7"), ["k"], ["id"], how="left", limit=0)
    assert left.count() == 3000 and left.filter("v = 14").count() == 1001


@pytest.mark.parametrize("chunk", [1, 3, 10_000])
def test_running_total(spark, chunk):
    rows = spark.range(500).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 4)).alias("g"),
        F.floor(F.col("id") / chunk).alias("chunk"), "id", (F.col("id") % 5).alias("w"),
    )
    found = O.running_total(rows, F.col("w"), "t", ["g"], "chunk", ["id"]).collect()
    sums, expected = {}, {}
    for r in sorted(found, key=lambda r: r.id):
        sums[r.g] = sums.get(r.g, 0) + r.w
        expected[r.id] = sums[r.g]
    assert {r.id: r.t for r in found} == expected


@pytest.mark.parametrize("buckets", [8, 37])
def test_every_bucket_has_a_partition_of_its_own(spark, buckets):
    """buckets numbered in a row fell together, several into one task and none into others."""
    rows = spark.createDataFrame([(n,) for n in B._bucket_names(spark, buckets)], "_bucket long")
    sizes = [len(part) for part in rows.repartition(buckets, "_bucket").rdd.glom().collect()]
    assert sizes == [1] * buckets
