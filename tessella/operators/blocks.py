"""Fixed-length token blocks, vocabularies, and packing of sequences into bins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.columns import compute_once
from tessella.functions.text import SPECIAL_TOKEN, right_strip, strip, words
from tessella.operators import ordering
from tessella.operators.ordering import before_by_integer, is_dense, rank_rows
from tessella.storage import kept

BUCKET_BYTES = 1 << 22


def read_texts(df: DataFrame, key: str) -> DataFrame:
    """Key and text of a table in key order; a table without a text column is an error."""
    if "text" not in df.columns:
        raise ValueError(f"expected a 'text' column, found {df.columns}")
    return df.select(F.col(key).cast("long").alias("key"), "text").filter(F.col("text").isNotNull())


def _listed_words(texts: DataFrame) -> DataFrame:
    return compute_once(texts.select("key", "text"), "words", words(F.col("text")))


def token_blocks(texts: DataFrame, length: int) -> DataFrame:
    """Blocks of ``length`` tokens over all texts joined in key order; the short tail is dropped.

    Keys are unique; a null key comes first. Keys that are not dense integers are replaced by their
    positions, so that no window holds more than a bounded number of rows. Each text learns how many tokens come before it, cuts
    itself at the block limits it crosses, and only these slices meet again, per block. No task
    ever holds more than its texts and ``length`` tokens per block.
    """
    counted = _listed_words(texts).select(
        "key", F.size("words").cast("long").alias("n"), F.array_join("words", " ").alias("body")
    )
    if is_dense(texts, "key"):
        sizes = kept(counted.select("key", "n"), "sizes")  # narrow, and read for several levels of totals
    else:
        counted = rank_rows(counted, ["key", "body"], "_ord").drop("key").withColumnRenamed("_ord", "key")
        sizes = counted
    # Pieces move as texts, which are half the size of lists of tokens.
    pack, unpack = lambda part: F.array_join(part, " "), lambda parts: F.split(F.array_join(parts, " "), " ")
    return _cut(counted, sizes, "body", F.split("body", " "), length, pack, unpack).withColumnRenamed("values", "tokens")


def id_blocks(encoded: DataFrame, length: int) -> DataFrame:
    """Blocks of ``length`` ids over all id lists (``key``, ``ids``) in key order, with their mask; the
    same cut as ``token_blocks``, so block by block the ids of its tokens."""
    # Read several times, for the keys, their chunks and the ids.
    counted = kept(encoded.select("key", F.size("ids").cast("long").alias("n"), F.col("ids").cast("array<int>").alias("ids")), "ids")
    if not is_dense(counted, "key"):
        counted = rank_rows(counted, ["key", "ids"], "_ord").drop("key").withColumnRenamed("_ord", "key")
    cut = _cut(counted, counted, "ids", F.col("ids"), length, lambda part: part, F.flatten)
    return with_attention_mask(cut.select("block_id", F.col("values").alias("input_ids")), length)


def _cut(
    counted: DataFrame,
    sizes: DataFrame,
    packed: str,
    values: Column,
    length: int,
    pack: Callable[[Column], Column],
    unpack: Callable[[Column], Column],
) -> DataFrame:
    """Blocks of ``values``, arrays of ``n`` entries in the order of the dense integer ``key``; ``sizes`` has each ``key`` and ``n``.

    Pieces of them move as ``pack`` makes them, and ``unpack`` makes one array of a list of these. The column
    ``packed`` has whole rows in that form; rows that lie within one block move as they are and are not cut.
    """
    placed = before_by_integer(counted, "key", "n", "start", weights=sizes).filter(F.col("n") > 0)
    start, end = F.col("start"), F.col("start") + F.col("n")
    size = F.lit(length).cast("long")
    first, last = F.floor(start / size).cast("long"), F.floor((end - 1) / size).cast("long")
    cut_up = F.when(first < last, values)
    listed = compute_once(placed.select(start.alias("start"), end.alias("end"), F.col(packed).alias("whole"), cut_up.alias("words")), "words", F.col("words"))

    def piece(block: Column) -> Column:
        low = F.greatest(block * size, F.col("start"))
        high = F.least((block + 1) * size, F.col("end"))
        part = pack(F.slice("words", (low - F.col("start") + 1).cast("int"), (high - low).cast("int")))
        return F.struct(
            block.alias("block_id"),
            low.alias("low"),
            F.when(F.col("words").isNull(), F.col("whole")).otherwise(part).alias("part"),
        )

    first = F.floor(F.col("start") / size).cast("long")
    last = F.floor((F.col("end") - 1) / size).cast("long")
    cut = compute_once(listed, "_pieces", F.transform(F.sequence(first, last), piece))
    pieces = cut.select(F.explode("_pieces").alias("p")).select("p.*")
    joined = pieces.groupBy("block_id").agg(F.sort_array(F.collect_list(F.struct("low", "part"))).alias("_parts"))
    tokens = unpack(F.transform("_parts", lambda x: x["part"]))
    return compute_once(joined, "values", tokens).select("block_id", "values").filter(F.size("values") == length)


def require_blocks(blocks: DataFrame) -> DataFrame:
    if blocks.isEmpty():
        raise ValueError("no token blocks: the corpus has fewer tokens than one block")
    return blocks


def with_attention_mask(blocks: DataFrame, length: int) -> DataFrame:
    return blocks.withColumn("attention_mask", F.array_repeat(F.lit(1), length))


def _shown(text: Column, max_chars: int) -> Column:
    return F.when(F.length(text) > max_chars, F.concat(right_strip(F.substring(text, 1, max_chars)), F.lit(" …"))).otherwise(text)


def preview_blocks(blocks: DataFrame, n: int = 3, max_chars: int = 400, show_ids: bool = False) -> DataFrame:
    """The first blocks as text without special tokens; long ones are cut and marked.

    ``show_ids`` adds the tokens; ``preview_id_blocks`` shows blocks of ids.
    """
    text = F.array_join(F.filter("tokens", lambda t: ~t.rlike(SPECIAL_TOKEN)), " ")
    kept = blocks.filter(F.col("block_id") < n).withColumn("_text", text)
    return kept.select("block_id", _shown(F.col("_text"), max_chars).alias("preview"), *([F.col("tokens")] if show_ids else []))


def preview_id_blocks(blocks: DataFrame, vocabulary: DataFrame, n: int = 3, max_chars: int = 400, show_ids: bool = False) -> DataFrame:
    """The same of blocks of ids, which are decoded; ``show_ids`` adds the ids themselves."""
    kept = blocks.filter(F.col("block_id") < n).select(F.col("block_id").alias("key"), F.col("input_ids").cast("array<bigint>").alias("ids"))
    texts = decode(kept, vocabulary, skip_special=True).select(F.col("key").alias("block_id"), _shown(F.col("text"), max_chars).alias("preview"))
    if not show_ids:
        return texts
    return texts.join(kept.select(F.col("key").alias("block_id"), "ids"), "block_id")


def build_vocabulary(texts: DataFrame) -> DataFrame:
    """Distinct white-space tokens with ids from 0 in token order."""
    found = _listed_words(texts).select(F.explode("words").alias("token")).distinct()
    return rank_rows(found, ["token"], "_ord").select((F.col("_ord") - 1).alias("id"), "token")


def encode(texts: DataFrame, vocabulary: DataFrame, unknown: int | None = None) -> DataFrame:
    """Texts as id lists, one row per text; an empty text has an empty list.

    A token that the vocabulary lacks gets the id ``unknown``; without one it is an error.
    """
    found = _look_up(texts.select("key", "text"), "text", words, "token", vocabulary, "id", F.octet_length("text"))
    missing = F.raise_error(F.concat(F.lit("token not in the vocabulary: "), "token")).cast("long")
    coded = F.coalesce("id", F.lit(unknown).cast("long") if unknown is not None else missing)
    return _gathered(found, ["key"], coded, "ids")


def _look_up(rows: DataFrame, packed: str, items: Callable[[Column], Column], name: str, vocabulary: DataFrame, wanted: str, size: Column) -> DataFrame:
    """Every item of every row with what the vocabulary has for it: the other columns, ``pos``, ``name``, ``wanted``.

    ``items`` makes the list of a row from its column ``packed``. Rows are dealt out by key. With a vocabulary
    that can be broadcast (its size is measured) items never leave their task. Beyond that, buckets of keys take
    about ``BUCKET_BYTES`` of rows each, ``size`` being a row's bytes: only the different items of a bucket are
    joined with the vocabulary, come back to their bucket as its dictionary, and meet the items there. So rows
    move packed as they are, and no item moves once for each time it occurs.
    """
    by = [c for c in rows.columns if c != packed]
    if ordering.table_bytes(vocabulary) <= ordering.BROADCAST_BYTES:
        listed = compute_once(rows.repartition("key"), "_items", items(F.col(packed)))
        exploded = listed.select(*by, F.posexplode_outer("_items").alias("pos", name))
        return exploded.join(F.broadcast(vocabulary.select(name, wanted)), name, "left")
    cores = rows.sparkSession.sparkContext.defaultParallelism
    buckets = max(2 * cores, (rows.agg(F.sum(size)).first()[0] or 0) // BUCKET_BYTES + 1)
    names = F.split(F.lit(",".join(map(str, _bucket_names(rows.sparkSession, buckets)))), ",").cast("array<bigint>")
    dealt = rows.withColumn("_bucket", F.get(names, F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")))
    different = compute_once(dealt.repartition(buckets, "_bucket").select("_bucket", packed), "_items", F.array_distinct(items(F.col(packed))))
    asked = different.select("_bucket", F.explode("_items").alias(name)).distinct()
    entries = asked.join(vocabulary.select(name, wanted).hint("merge"), name)
    types = {**dict(rows.dtypes), **dict(vocabulary.dtypes)}
    none = lambda c: F.lit(None).cast(types[c]).alias(c)
    both = dealt.select("_bucket", *by, packed, none(name), none(wanted), F.lit(False).alias("_entry")).unionByName(
        entries.select("_bucket", *[none(c) for c in (*by, packed)], name, wanted, F.lit(True).alias("_entry"))
    )
    each = F.when(F.col("_entry"), F.array(name)).otherwise(items(F.col(packed)))
    listed = compute_once(both.repartition(buckets, "_bucket"), "_items", each).drop(name)
    exploded = listed.select("_bucket", *by, F.posexplode_outer("_items").alias("pos", name), wanted, "_entry")
    same = Window.partitionBy("_bucket", name)
    return exploded.withColumn(wanted, F.max(wanted).over(same)).filter(~F.col("_entry")).drop("_entry")


def _bucket_names(spark: SparkSession, buckets: int) -> list[int]:
    """A number for each bucket, such that a shuffle by it into as many partitions gives every bucket its own. Numbers
    in a row would leave a third of the partitions empty and put several buckets into others."""
    part = F.pmod(F.hash("id"), F.lit(buckets))
    found = spark.range(64 * buckets).groupBy(part.alias("part")).agg(F.min("id").alias("id")).orderBy("part")
    names = {r["part"]: r["id"] for r in found.collect()}
    return [names.get(part, 64 * buckets + part) for part in range(buckets)]


def _gathered(found: DataFrame, by: list[str], value: Column, out: str) -> DataFrame:
    """The values of each group in order of ``pos``; a null ``pos`` stands for an empty list."""
    part = F.when(F.col("pos").isNotNull(), F.struct("pos", value.alias("value")))
    # The rows of a bucket lie together, so with it they are grouped where they are.
    grouped = found.groupBy(*[c for c in ("_bucket",) if c in found.columns], *by).agg(F.sort_array(F.collect_list(part)).alias("_parts"))
    return grouped.select(*by, F.transform("_parts", lambda x: x["value"]).alias(out))


def decode(ids: DataFrame, vocabulary: DataFrame, skip_special: bool = False, unknown: str | None = None) -> DataFrame:
    """Id lists as stripped texts: one text per row, or one per (key, row) where ``ids`` are lists of lists
    or ``as_rows`` made rows of them. Other shapes are an error.

    An id that the vocabulary lacks becomes the token ``unknown``; without one it is an error. A row
    without ids, or with special tokens only, is an empty text. Tokens are looked up as in ``encode``.
    """
    rows = as_rows(ids, "key", "ids") if _depth(ids, "ids") == 2 else ids
    by = [c for c in ("key", "row") if c in rows.columns]
    listed = rows.select(*by, F.col("ids").cast("array<bigint>").alias("ids"))
    if ordering.table_bytes(vocabulary) > ordering.BROADCAST_BYTES:
        listed = kept(listed, "lists")  # read for its size, its dictionaries and its ids
    found = _look_up(listed, "ids", lambda ids: ids, "id", vocabulary, "token", F.size("ids") * 8)
    missing = F.raise_error(F.concat(F.lit("id not in the vocabulary: "), F.col("id").cast("string"))).cast("string")
    token = F.coalesce("token", F.lit(unknown) if unknown is not None else missing)
    listed = _gathered(found, by, token, "_t")
    shown = F.filter("_t", lambda t: ~t.rlike(SPECIAL_TOKEN)) if skip_special else F.col("_t")
    return listed.select(*by, strip(F.array_join(shown, " ")).alias("text"))


def _depth(df: DataFrame, ids: str) -> int:
    kind = df.schema[ids].dataType.simpleString()
    for depth, shapes in ((1, {"array<int>", "array<bigint>"}), (2, {"array<array<int>>", "array<array<bigint>>"})):
        if kind in shapes:
            return depth
    raise ValueError(f"ids must be one or two dimensional, got {kind}")


def as_rows(df: DataFrame, key: str, ids: str) -> DataFrame:
    """One row per id list, from a column of lists or of lists of lists; other shapes are an error."""
    if _depth(df, ids) == 1:
        return df.select(key, F.lit(0).alias("row"), F.col(ids).cast("array<bigint>").alias("ids"))
    nested = df.select(key, F.posexplode(ids).alias("row", "ids"))
    return nested.withColumn("ids", F.col("ids").cast("array<bigint>"))


def pack_sequences(lengths: DataFrame, max_length: int, shards: int = 1) -> DataFrame:
    """Put sequences (``key``, ``num_tokens``) into bins of at most ``max_length`` tokens.

    Longer sequences are truncated to the limit. Bins are filled next-fit, longest first, equal
    lengths in key order; with more than one shard, within shards of the hashed key. The filling
    follows from how often each length occurs: a walk over this histogram (at most ``max_length`` + 1
    rows a shard) says in which bin a length starts and how many of its rows still fit there, and
    a row's bin is arithmetic on its rank within its length.
    """
    prepared = lengths.select(
        "key",
        F.col("num_tokens").cast("long").alias("num_tokens"),
        F.least("num_tokens", F.lit(max_length)).cast("long").alias("packed_tokens"),
        F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"),
    )
    order = [F.col("shard"), F.col("packed_tokens").desc(), F.col("key")]
    ranked = rank_rows(prepared, order, "_rank")
    counts = prepared.groupBy("shard", "packed_tokens").agg(F.count("*").alias("rows"))
    earlier = Window.orderBy("shard", F.desc("packed_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).cast("long"))
    walked = before.groupBy("shard").agg(
        F.sort_array(F.collect_list(F.struct("packed_tokens", "rows", "before")), asc=False).alias("lengths")
    )
    limit, zero = F.lit(max_length).cast("long"), F.lit(0).cast("long")

    def step(state: Column, x: Column) -> Column:
        n, rows = x["packed_tokens"], x["rows"]
        fit = F.when(n == 0, rows).otherwise(F.least(rows, F.floor((limit - state["used"]) / F.greatest(n, zero + 1))))
        to_bin = F.greatest(F.floor(limit / F.greatest(n, zero + 1)), zero + 1)
        rest = rows - fit
        start = F.struct(n.alias("packed_tokens"), x["before"].alias("before"), state["bin"].alias("first"), fit.alias("fit"), to_bin.alias("to_bin"))
        return F.struct(
            F.when(rest > 0, state["bin"] + 1 + F.floor((rest - 1) / to_bin)).otherwise(state["bin"]).alias("bin"),
            F.when(rest > 0, ((rest - 1) % to_bin + 1) * n).otherwise(state["used"] + rows * n).alias("used"),
            F.concat(state["starts"], F.array(start)).alias("starts"),
        )

    none = F.array().cast("array<struct<packed_tokens:bigint,before:bigint,first:bigint,fit:bigint,to_bin:bigint>>")
    state = F.struct(zero.alias("bin"), zero.alias("used"), none.alias("starts"))
    starts = walked.select("shard", F.explode(F.aggregate("lengths", state, step, lambda s: s["starts"])).alias("s")).select("shard", "s.*")
    placed = ranked.join(F.broadcast(starts), ["shard", "packed_tokens"])  # at most max_length + 1 rows a shard
    rank = F.col("_rank") - 1 - F.col("before")
    placed_bin = F.when(rank < F.col("fit"), F.col("first")).otherwise(F.col("first") + 1 + F.floor((rank - F.col("fit")) / F.col("to_bin")))
    return placed.select("key", "num_tokens", "packed_tokens", "shard", placed_bin.alias("bin"))


def packing_stats(packed: DataFrame, max_length: int) -> DataFrame:
    bins = packed.groupBy("shard", "bin").agg(
        F.sum("packed_tokens").alias("used"), F.sum("num_tokens").alias("whole"), F.count("*").alias("rows")
    )
    return bins.agg(
        F.count("*").alias("bins"),
        F.sum("rows").cast("long").alias("sequences"),
        F.max("used").cast("long").alias("fullest_bin"),
        F.sum("used").cast("long").alias("packed_tokens"),
        F.round(F.sum("used") / (F.count("*") * max_length), 6).alias("fill"),
        F.sum(F.col("whole") - F.col("used")).cast("long").alias("truncated_tokens"),
    )
