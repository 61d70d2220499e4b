"""Positions, running totals and rank cuts over tables too large for one window.

Three tools, none of which puts an unbounded group of rows into one task:

* ``running_total``: sums within bounded chunks plus what the chunks before them carry.
* ``before_by_integer``: the same over a dense integer key, where the chunks follow from the key.
* ``rank_rows``: positions in any sort order, from a range sort that is checkpointed once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.storage import cut_lineage

CHUNK_BITS = 10
TOP_ROWS = 10_000
HOT_SHARE = 1000
BROADCAST_BYTES = 64 * 1024 * 1024
ROW_IN_PARTITION = (1 << 33) - 1


def spread(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Give every core a share of an input that comes in fewer splits than there are cores.

    A file of one row group is one task, whatever is computed from it. Inputs of cluster size have
    more splits than cores and are returned as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def input_bytes(df: DataFrame) -> int:
    """Size of the files a table is read from, as the planner knows it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def carried(totals: DataFrame, group: Sequence[str], chunk: str, total: str, out: str) -> DataFrame:
    """Sum of the chunks before each chunk. ``totals`` has one narrow row per chunk."""
    earlier = Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*group, chunk, F.coalesce(F.sum(total).over(earlier), F.lit(0)).cast("long").alias(out))


def running_total(
    df: DataFrame, weight: Column, out: str, group: Sequence[str], chunk: str, position: Sequence[str]
) -> DataFrame:
    """Inclusive running sum of ``weight`` in (chunk, position) order within each group.

    A group may hold any share of the table: its rows are spread over its chunks, and only the
    chunk totals (one row each) meet in one window. Callers give chunks of bounded size, such as
    file blocks. The join is a merge on the partitioning and order the window needs anyway, so the
    rows move and are sorted once, and nothing is broadcast that grows with the table.
    """
    weighed = df.withColumn("_w", weight.cast("long"))
    totals = weighed.groupBy(*group, chunk).agg(F.sum("_w").alias("_t"))
    inner = Window.partitionBy(*group, chunk).orderBy(*position).rowsBetween(Window.unboundedPreceding, 0)
    return (
        weighed.withColumn("_inner", F.sum("_w").over(inner))
        .join(carried(totals, group, chunk, "_t", "_before").hint("merge"), [*group, chunk])
        .withColumn(out, F.col("_inner") + F.col("_before"))
        .drop("_w", "_inner", "_before")
    )


def before_by_integer(
    df: DataFrame, key: str, weight: str, out: str, group: Sequence[str] = (), levels: int = 2, weights: DataFrame | None = None
) -> DataFrame:
    """Sum of ``weight`` over all smaller keys of the group.

    ``key`` is a unique, non-negative and fairly dense integer (``rank_rows`` makes one from any
    other order). A chunk is 1,024 neighbouring keys, so it cannot hold more rows than that; the
    chunk totals are chunked again, which leaves one row per million keys for the last window. They
    are taken from ``weights``, a table of the same keys and weights, if it is given.
    """
    if levels == 0:
        earlier = Window.partitionBy(*group).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, F.coalesce(F.sum(weight).over(earlier), F.lit(0)).cast("long"))
    chunk = f"_chunk{levels}"
    number = F.shiftright(F.col(key).cast("long"), CHUNK_BITS)
    chunked = df.withColumn(chunk, number)
    totals = (df if weights is None else weights).withColumn(chunk, number).groupBy(*group, chunk).agg(F.sum(weight).alias("_t"))
    carry = before_by_integer(totals, chunk, "_t", f"_carry{levels}", group, levels - 1).drop("_t")
    inner = Window.partitionBy(*group, chunk).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return (
        chunked.withColumn("_inner", F.coalesce(F.sum(weight).over(inner), F.lit(0)))
        .join(carry.hint("merge"), [*group, chunk])
        .withColumn(out, (F.col("_inner") + F.col(f"_carry{levels}")).cast("long"))
        .drop("_inner", f"_carry{levels}", chunk)
    )


def rank_rows(df: DataFrame, order: Sequence[Column | str], out: str = "ordinal") -> DataFrame:
    """Add the position (from 1) of every row in a total order.

    The range sort is spread evenly whatever the values are, as long as the order has no ties.
    It is checkpointed because two runs of it may pick other range limits; after that, partition
    number and row number within the partition are facts on disk, and the position needs only the
    partition sizes: one row per partition, which bounds the broadcast. Pass narrow tables.
    """
    fixed = cut_lineage(df.orderBy(*order))
    placed = fixed.withColumn("_part", F.spark_partition_id()).withColumn(
        "_row", F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_IN_PARTITION))
    )
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = carried(sizes, [], "_part", "_n", "_start")
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(out, F.col("_start") + F.col("_row") + 1)
        .drop("_part", "_row", "_start")
    )


def ordinals(df: DataFrame, key: str, out: str = "ordinal") -> DataFrame:
    """Positions from 1 by one unique column; null keys come first.

    A dense integer key is counted in place, any other one is sorted. Both give the same positions.
    """
    if is_dense(df, key):
        counted = before_by_integer(df.withColumn("_one", F.lit(1)), key, "_one", "_b")
        return counted.withColumn(out, F.col("_b") + 1).drop("_b", "_one")
    return rank_rows(df, [key], out)


def is_dense(df: DataFrame, key: str) -> bool:
    """Whether ``before_by_integer`` may be used: no null, not negative, at most 64 numbers to a row."""
    if df.schema[key].dataType.typeName() not in {"long", "integer", "short", "byte"}:
        return False
    low, high, rows, known = df.agg(F.min(key), F.max(key), F.count("*"), F.count(key)).first()
    return not rows or (known == rows and low >= 0 and high <= 64 * rows)


def take_slice(df: DataFrame, n: int, key: str) -> DataFrame:
    """``rows[:n]`` of a list in key order: a negative ``n`` leaves out that many rows at the end.

    Null keys come first; rows of one key are ordered by a hash of the row, whatever ``n`` is. Few
    rows are a distributed top-k, more take positions in the same order.
    """
    order = [F.col(key).asc_nulls_first(), F.xxhash64(*df.columns)]
    if 0 <= n <= TOP_ROWS:
        return df.orderBy(*order).limit(n)
    if n < 0:
        n = max(0, df.count() + n)
    return rank_rows(df, order, "_ord").filter(F.col("_ord") <= n).drop("_ord")


def table_bytes(df: DataFrame) -> int:
    row = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))).alias("b")).first()
    return row.b or 0


def _hot_keys(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys that hold more than a thousandth of the rows each; there are fewer than a thousand."""
    counts = df.groupBy(*on).agg(F.count("*").alias("_rows"))
    total = counts.agg(F.sum("_rows").alias("n")).first().n or 0
    return cut_lineage(counts.filter(F.col("_rows") > total // HOT_SHARE).select(*on, F.lit(True).alias("_hot")))


def join_checked(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    limit: int = BROADCAST_BYTES,
    salts: int = 32,
) -> DataFrame:
    """Join with a side that is usually small, after measuring it.

    Within ``limit`` bytes it is broadcast. Beyond, both sides shuffle and merge. Keys that hold a
    noticeable share of ``big`` are then salted: their rows go to ``salts`` tasks by the ``spread``
    columns and the few matching rows of ``small`` are repeated; all other rows move once, as they are.
    """
    if table_bytes(small) <= limit:
        return big.join(F.broadcast(small), list(on), how)
    hot = F.broadcast(_hot_keys(big, on))
    last = F.lit(salts - 1).cast("long")
    none = F.lit(0).cast("long")
    salted = big.join(hot, list(on), "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), last + 1)).otherwise(none)
    )
    repeated = small.join(hot, list(on), "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), F.sequence(none, last)).otherwise(F.array(none)))
    )
    return salted.drop("_hot").join(repeated.drop("_hot").hint("merge"), [*on, "_salt"], how).drop("_salt")
