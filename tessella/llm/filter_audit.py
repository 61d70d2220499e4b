"""What each of five filters removes, alone and in every order, from one pass of additive counts.

Filters, as bits of a row's mask (words are maximal runs without ASCII white space, case-sensitive):

* A: under 200 words; B: fewer distinct words than half the words;
* C: more than 2 in 100 code points are A-Z; D: any of ``#$%&*|``;
* E: the text equals that of a row with a smaller id, wherever in the table.

E needs whole texts to meet, which is what the prepass keeps small. Every text gets ``HASHES`` cells of a
counting Bloom sketch of ``CELLS`` cells a row. Each task's partial counts are its sketch, and the
shuffle adds them up. A text with a cell that was counted once is unique for certain: it is cleared where
it is read. Only possible repeats are grouped, by their full text, for the smallest id. The merged sketch
is sent around as one bit a cell (counted twice or more): at most 2^MAX_BITS bits, 128 MB, which
serves 134 million rows at ``CELLS`` cells each. Beyond that it has fewer cells a row, so more unique texts
move to the grouping; results never depend on the sketch.

The marks of E join the other four and the labels on narrow rows. Rows are then counted by (part, mask),
at most 32 counts a part, and all orders and steps follow from these sums.

Null texts are empty texts (no words: A holds, B and C do not). A null part is the empty string. A row
with a null id has no label and is never E, nor does it make another row E. Rows equal in id and text do
not make each other E. Labels of one id are merged: it is good or toxic if any row says so. Without
rows there is no part and no result. Only the named columns are read, so further ones may clash.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut_lineage
from .common import map_texts

FILTERS = "ABCDE"
HASHES, CELLS, MAX_BITS = 3, 8, 30
BITMAP = 1 << 15  # bits of one bitmap of Spark's bitmap functions (fixed)
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
SYMBOLS = b"#$%&*|"


def text_mask(text: str | None) -> int:
    """The bits of the filters A to D."""
    data = (text or "").encode()
    words = data.split()  # of bytes: at ASCII white space
    capitals = len(data) - len(data.translate(None, CAPITALS))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    fails = len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 2 * len(text or ""), symbols > 0
    return sum(bit << i for i, bit in enumerate(fails))


def _whole(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def _facts(df: DataFrame, part: str, key: str, text: str) -> DataFrame:
    """(part, id, print, mask) of every row; ``print`` is a 64-bit hash of the text."""
    narrow = df.select(
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.col(key).alias("id"),
        F.xxhash64(_whole(text)).alias("print"),
        F.col(text).alias("text"),
    )
    return map_texts(narrow, "text", lambda: lambda texts: {"mask": pa.array(list(map(text_mask, texts)), pa.int32())}, "mask int")


def _cells(prints: Column, bits: int) -> list[Column]:
    return [F.shiftrightunsigned(F.xxhash64(prints, F.lit(i)), 64 - bits) for i in range(HASHES)]


def sketch_bits(rows: int) -> int:
    """Cells of the sketch as a power of two: ``CELLS`` a row, up to the size that may be sent around."""
    return min(MAX_BITS, max(15, (CELLS * rows - 1).bit_length()))


def repeated_cells(prints: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of the cells that were counted twice or more, merged over all partitions."""
    counted = prints.select(F.explode(F.array(*_cells(F.col("print"), bits))).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    bitmaps = (
        counted.filter("n > 1")
        .groupBy(F.shiftright("cell", 15).alias("at"))
        .agg(F.bitmap_construct_agg(F.col("cell") % BITMAP).alias("bits"))
    )
    merged = np.zeros(1 << max(0, bits - 3), np.uint8)
    for row in cut_lineage(bitmaps).toLocalIterator():  # one bitmap of 4 KB after the other
        merged[row["at"] * BITMAP // 8 :][: BITMAP // 8] = np.frombuffer(row["bits"], np.uint8)[: len(merged)]
    return merged


def possible_repeats(df: DataFrame, bitmap: np.ndarray, bits: int) -> DataFrame:
    """The rows whose ``print`` has no cell that was counted once; all others are unique for certain."""
    shared = df.sparkSession.sparkContext.broadcast(bitmap)  # at most 2^MAX_BITS bits

    @F.pandas_udf("boolean")
    def repeated(*cells: pd.Series) -> pd.Series:
        found = np.ones(len(cells[0]), bool)
        for cell in cells:
            at = cell.to_numpy(np.int64)
            found &= (shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return pd.Series(found)

    return df.filter(repeated(*_cells(F.col("print"), bits)))


def masks(
    df: DataFrame, labels: DataFrame, part: str = "source", key: str = "doc_id", text: str = "text", quality: str = "quality", toxic: str = "toxic", bits: int | None = None
) -> DataFrame:
    """(part, mask, n, good, toxic): rows by the filters that they fail, and how many of them have each label."""
    facts = cut_lineage(_facts(df, part, key, text))
    bits = sketch_bits(facts.count()) if bits is None else bits
    bitmap = repeated_cells(facts.select("print"), bits)
    texts = df.select(F.col(key).alias("id"), F.xxhash64(_whole(text)).alias("print"), _whole(text).alias("text"))
    # One row a text: its smallest id. Equal texts are combined before they are shuffled.
    firsts = possible_repeats(texts.filter("id IS NOT NULL"), bitmap, bits).groupBy("text").agg(F.min("id").alias("id"), F.first("print").alias("print"))
    named = possible_repeats(facts.filter("id IS NOT NULL"), bitmap, bits).select("part", "id", "print", "mask")
    marked = cut_lineage(named.join(firsts.hint("merge"), ["id", "print"], "left_anti"))
    # Counts add up: all rows under their four bits, and the repeats once more, moved from there to the bit of E.
    judged = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(
        F.max(F.coalesce((F.col(quality) == 1).cast("int"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col(toxic) == 1).cast("int"), F.lit(0))).alias("toxic")
    )
    signed = (
        facts.select("part", "id", "mask", F.lit(1).alias("n"))
        .unionByName(marked.select("part", "id", F.col("mask").bitwiseOR(16).alias("mask"), F.lit(1).alias("n")))
        .unionByName(marked.select("part", "id", "mask", F.lit(-1).alias("n")))
    )
    summed = signed.groupBy("part", "mask").agg(F.sum("n").alias("n"))
    # Labels are of some rows only; the narrow rows of those meet them, and ids that have none stay behind.
    labelled = signed.filter("id IS NOT NULL").join(judged.filter("good + toxic > 0"), "id").groupBy("part", "mask").agg(F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    return (
        summed.select("part", "mask", "n", F.lit(0).cast("bigint").alias("good"), F.lit(0).cast("bigint").alias("toxic"))
        .unionByName(labelled.select("part", "mask", F.lit(0).cast("bigint").alias("n"), "good", "toxic"))
        .groupBy("part", "mask")
        .agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    )


def orders(counts: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from the counts by mask."""
    gathered = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # at most 32
    every = gathered.select("part", "masks", F.explode(F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])).alias("filter_order"))
    stepped = every.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step")).select(
        "*",
        F.transform(F.split("filter_order", ""), lambda c: F.pow(F.lit(2), F.ascii(c) - ord("A")).cast("int")).alias("bits"),
    )
    ready = stepped.select(
        "part", "filter_order", "step", "masks",
        F.get("bits", F.col("step") - 1).alias("mine"),
        F.aggregate(F.slice("bits", F.lit(1), F.col("step") - 1), F.lit(0), lambda a, b: a + b).alias("before"),
    )
    fails = lambda m: m["mask"].bitwiseAND(F.col("mine")) != 0
    gone = lambda m: m["mask"].bitwiseAND(F.col("before")) != 0

    def total(test, weight=lambda m: m["n"]) -> Column:
        chosen = F.transform(F.filter("masks", test), weight)
        return F.aggregate(chosen, F.lit(0).cast("bigint"), lambda a, b: a + b)

    taken = lambda m: fails(m) & ~gone(m)
    everyone = len(list(permutations(FILTERS)))
    return ready.select(
        "part", "filter_order", "step",
        total(lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        total(taken).alias("removed"),
        total(lambda m: fails(m) & gone(m)).alias("redundant"),
        total(lambda m: m["mask"] == F.col("mine")).alias("unique_fails"),
        total(taken, lambda m: m["good"]).alias("good_lost"),
        total(taken, lambda m: m["toxic"]).alias("toxic_lost"),
        # Of the filters that a row fails each comes first in an equal share of the orders.
        total(fails, lambda m: m["n"] * (F.lit(everyone) / F.bit_count(m["mask"])).cast("bigint")).alias("shapley"),
    )


def audit(df: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """What every filter removes at every step of every order, by part."""
    return orders(masks(df, labels, **columns))
