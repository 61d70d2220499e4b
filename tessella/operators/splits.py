"""Exact, repeatable train / test / validation splits."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.storage import cut_lineage

# Share of the whole set aside first, then share of that which is validation.
# A preset without a second share has two parts.
SPLIT_PRESETS: dict[str, tuple[float, float | None, str]] = {
    "local": (0.10, 0.5, "test"),
    "hub": (0.20, 0.25, "test"),
    "legacy": (0.20, 0.25, "test"),
    "validation_only": (0.05, None, "val"),
    "holdout": (0.10, None, "test"),
}
PREFIX_STEP = 3
DIGEST_LENGTH = 32
COLLECT_ROWS = 10_000


def digest(keys: Sequence[str], seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def _histogram(digests: DataFrame, width: int) -> list[tuple[str, int]]:
    """Rows per digest prefix, in order. At most 4,096 more prefixes than at the width before."""
    rows = digests.groupBy(F.substring("d", 1, width).alias("p")).count().orderBy("p").collect()
    return [(r["p"], r["count"]) for r in rows]


def _locate(histogram: Sequence[tuple[str, int]], rank: int, below: int = 0) -> tuple[str, int, int]:
    """Prefix that holds the row of this rank, rows below the prefix, and rows with it."""
    for prefix, count in histogram:
        if below + count >= rank:
            return prefix, below, count
        below += count
    raise AssertionError("rank beyond the table")


def _bound(digests: DataFrame, rank: int, prefix: str, below: int, inside: int) -> str:
    """Text ``b`` such that exactly ``rank`` digests are smaller, narrowing the prefix step by step;
    the last few rows are read directly. "g" is larger than every hex digit."""
    wanted = rank - below
    if wanted == inside:
        return prefix + "g"
    here = digests.filter(F.col("d").startswith(prefix))
    if inside <= COLLECT_ROWS:
        rows = [r.d for r in here.orderBy("d").limit(wanted + 1).collect()]
        if rows[wanted - 1] == rows[wanted]:
            raise ValueError("split key is not unique: two rows share a digest at the cut")
        return rows[wanted - 1] + "g"
    width = len(prefix) + PREFIX_STEP
    if width > DIGEST_LENGTH:
        raise ValueError("split key is not unique: too many rows share a digest at the cut")
    return _bound(digests, rank, *_locate(_histogram(here, width), rank, below))


def rank_bounds(digests: DataFrame, ranks_of: Callable[[int], list[int]]) -> list[str]:
    """Bounds for the ranks that ``ranks_of`` names for the number of rows.

    The table is read twice: for the first histogram, which also counts it, and for the digests of
    the few prefixes the cuts fall into. These are kept on disk if more steps are needed.
    """
    first = _histogram(digests, PREFIX_STEP)
    ranks = ranks_of(sum(count for _, count in first))
    places = {rank: _locate(first, rank) for rank in ranks if rank > 0}
    open_places = {r: p for r, p in places.items() if r - p[1] != p[2]}
    if open_places:
        prefixes = sorted({p[0] for p in open_places.values()})
        digests = digests.filter(F.substring("d", 1, PREFIX_STEP).isin(prefixes))
        if max(p[2] for p in open_places.values()) > COLLECT_ROWS:
            digests = cut_lineage(digests)
    return [_bound(digests, rank, *places[rank]) if rank > 0 else "" for rank in ranks]


def hash_split(
    df: DataFrame,
    keys: Sequence[str],
    first: float,
    second: float | None = None,
    seed: int = 42,
    second_name: str = "val",
    first_name: str = "test",
) -> DataFrame:
    """Add ``split``: exactly ``ceil(first * n)`` rows leave the training part.

    The order is ``md5(seed|key)``; the rows set aside are its first ones, and of these the first
    ``ceil(second * m)`` are the second part. The two cut points are found as digest texts, so the
    result is a plain projection of ``df``: no sort, no shuffle, no join. Keys must be unique.
    """

    def ranks(total: int) -> list[int]:
        aside = math.ceil(first * total)
        return [math.ceil(second * aside) if second is not None else 0, aside]

    low, high = rank_bounds(df.select(digest(keys, seed).alias("d")), ranks)
    d = digest(keys, seed)
    return df.withColumn(
        "split", F.when(d < low, F.lit(second_name)).when(d < high, F.lit(first_name)).otherwise(F.lit("train"))
    )


def preset_split(df: DataFrame, keys: Sequence[str], preset: str, seed: int = 42) -> DataFrame:
    first, second, first_name = SPLIT_PRESETS[preset]
    return hash_split(df, keys, first, second, seed, first_name=first_name)


def split_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("rows"))


def resolve_splits(df: DataFrame, keys: Sequence[str], asked: str = "train", seed: int = 42) -> DataFrame:
    """Use the splits a table comes with, or make the missing ones.

    With train and test present these are kept, and validation is carved from train if there is
    none. Otherwise all three are carved from the part asked for.
    """
    has = df.agg(
        *[F.bool_or(F.col("split") == name).alias(name) for name in ("train", "test", "validation")]
    ).first()
    if has.train and has.test:
        test = df.filter(F.col("split") == "test")
        train = df.filter(F.col("split") == "train")
        if has.validation:
            held = df.filter(F.col("split") == "validation").withColumn("split", F.lit("val"))
            return train.unionByName(test).unionByName(held)
        return preset_split(train.drop("split"), keys, "validation_only", seed).unionByName(test)
    return preset_split(df.filter(F.col("split") == asked).drop("split"), keys, "hub", seed)
