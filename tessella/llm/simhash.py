"""SimHash near-duplicates with pivot distance tables.

Every distinct fingerprint carries a table: its Hamming distances to ``PIVOTS`` fixed reference
fingerprints. Distances obey the triangle inequality, so two fingerprints whose tables differ by more
than ``radius`` in any coordinate are farther apart than ``radius``; the pair is discarded without
looking at the fingerprints, and survivors are verified bit by bit.

Which pairs are looked at: the 64 bits are cut into ``radius + 2`` blocks. Two fingerprints within
``radius`` bits agree in at least two blocks, so rows that share the values of some two blocks are the
only possible pairs (tables alone can't choose pairs: for one pivot, more than half of all random pairs
differ by 4 or less). Rows that share a key are compared

* in a join whose condition is the table test and the verification, up to ``SMALL`` rows to a key;
* beyond that, by walking the group: a member is compared with those not yet reached, which are sorted
  by their first coordinate and filtered by the other ones, and leave the list once reached. It yields
  a spanning forest, so a group of n members gives fewer than n links, however many pairs are close.
  Groups above ``TILE`` members are dealt out as pairs of tiles.

Both ways give the same components; neither leaves out a pair. Null and empty texts and texts without a
word have fingerprint zero and are linked like any other. Rows may repeat.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut_lineage
from .common import arrow_map, free_name, map_texts
from .components import components

SHINGLE = 4
RADIUS = 4
SEED = 42
PIVOTS = 8
SMALL = 64
TILE = 4_096
STEP = 1 << 16  # shingles whose bits are summed at once
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Reference fingerprints: a fixed sequence of hashes.
REFERENCES = [xxhash.xxh64_intdigest(f"pivot {i}", 0) for i in range(PIVOTS)]


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words (of all words, if there are fewer), joined by spaces."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest, seed = xxhash.xxh64_intdigest, SEED
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    return np.array([digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[size - 1 :] or ends[-1:])], np.uint64)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Each bit is 1 if more than half of the shingles' hashes have it."""
    return fingerprint_of(shingle_hashes(text, size) if text else np.zeros(0, np.uint64))


def fingerprint_of(hashes: np.ndarray) -> int:
    """The fingerprint of shingles given by their hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), STEP):
        part = hashes[at : at + STEP]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def with_fingerprints(df: DataFrame, text: str = "text", size: int = SHINGLE, into: str = "simhash", keep: list[str] | None = None) -> DataFrame:
    """Add the fingerprint as a signed 64-bit number; by default the text goes."""

    def make():
        def compute(texts):
            return {into: pa.array(np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64))}

        return compute

    return map_texts(df, text, make, f"`{into}` bigint", keep)


def row_hash(key: str, text: str) -> Column:
    return F.xxhash64(key, text)


def hex_digits(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _blocks(count: int) -> list[tuple[int, int]]:
    """(first bit, bits) of nearly equal blocks of 64 bits."""
    edges = [64 * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _keyed(prints: DataFrame, radius: int) -> DataFrame:
    """One row for every two blocks: (key, fp, table)."""
    keys = []
    for number, ((a, m), (b, n)) in enumerate(itertools.combinations(_blocks(radius + 2), 2)):
        low = F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << m) - 1))
        high = F.shiftrightunsigned("fp", b).bitwiseAND(F.lit((1 << n) - 1))
        keys.append(F.lit(number << 48).bitwiseOR(F.shiftleft(high, m)).bitwiseOR(low))
    return prints.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _tabled(df: DataFrame) -> DataFrame:
    """Add the pivot table: p0, p1, ... are the distances to the reference fingerprints."""
    return df.withColumns({f"p{i}": F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(r)))).cast("byte") for i, r in enumerate(REFERENCES)})


def _spanning(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (fp, fp) that connect what is within ``radius``, fewer than there are fingerprints."""
    values = fps.view(np.uint64)
    tables = np.stack([np.bitwise_count(values ^ np.uint64(r)).astype(np.int8) for r in REFERENCES])
    order = np.argsort(tables[0], kind="stable")
    values, tables = values[order], tables[:, order]
    left = np.arange(len(values))  # not yet reached, sorted by the first coordinate
    links: list[tuple[int, int]] = []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            first = tables[0, left]
            low, high = np.searchsorted(first, tables[0, at] - radius), np.searchsorted(first, tables[0, at] + radius, "right")
            near = np.arange(low, high)
            for table in tables[1:]:
                near = near[np.abs(table[left[near]] - table[at]) <= radius]
            near = near[np.bitwise_count(values[left[near]] ^ values[at]) <= radius]
            reached = left[near]
            links += [(int(values[at].view(np.int64)), int(values[r].view(np.int64))) for r in reached]
            frontier += list(reached)
            left = np.delete(left, near)
    return links


def links(prints: DataFrame, radius: int = RADIUS, small: int = SMALL, tile: int = TILE) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` that connect all within ``radius`` bits."""
    keyed = _keyed(prints.select("fp").distinct(), radius)
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    shared = cut_lineage(keyed.join(sizes, "key"))

    few = _tabled(shared.filter(F.col("n") <= small).drop("n"))
    other = few.select(*[F.col(c).alias(f"{c}_2") for c in few.columns])
    tables_agree = F.greatest(*[F.abs(F.col(f"p{i}").cast("int") - F.col(f"p{i}_2").cast("int")) for i in range(PIVOTS)]) <= radius
    verified = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_2"))) <= radius
    pairs = few.join(other, (F.col("key") == F.col("key_2")) & (F.col("fp") < F.col("fp_2")) & tables_agree & verified)

    # A large group meets as pairs of tiles (i <= j); each member goes to every pair its tile is in.
    tiles = F.ceil(F.col("n") / tile)
    many = shared.filter(F.col("n") > small).select("key", "fp", tiles.cast("int").alias("tiles"), F.pmod(F.xxhash64("fp"), tiles).cast("int").alias("tile"))
    dealt = many.select("key", "fp", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("with")).select(
        "key", "fp", F.least("tile", "with").alias("i"), F.greatest("tile", "with").alias("j")
    )

    def walk(batches):
        for batch in batches:
            found = [link for fps in batch.column(0).to_pylist() for link in _spanning(np.array(fps, np.int64), radius)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    met = dealt.groupBy("key", "i", "j").agg(F.collect_list("fp").alias("fps")).select("fps")
    walked = arrow_map(met, walk, "a bigint, b bigint")
    return pairs.select(F.col("fp").alias("a"), F.col("fp_2").alias("b")).unionByName(walked)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, radius: int = RADIUS, small: int = SMALL, tile: int = TILE) -> DataFrame:
    """(key, row, simhash, component, root): the smallest key that links reach, itself included.

    Rows of one fingerprint are one node, so copies never make pairs. Null keys stay rows; they only
    name a component that has no other key. ``root``, the component's smallest fingerprint, tells such
    components apart; ``row`` (see ``row_hash``) tells rows of one key apart.
    """
    prints = cut_lineage(with_fingerprints(df.select(key, text, row_hash(key, text).alias("row")), text, size))
    nodes = prints.groupBy(F.col("simhash").alias("fp")).agg(F.min(key).alias("least"))
    roots = cut_lineage(components(links(nodes, radius, small, tile)))
    grouped = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = grouped.groupBy("root").agg(F.min("least").alias("component"))
    of_print = grouped.join(named, "root").select(F.col("fp").alias("simhash"), "component", "root")
    return prints.join(of_print, "simhash").select(key, "row", "simhash", "component", "root")


def first_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", group: Callable[..., DataFrame] = near_duplicates) -> DataFrame:
    """Of each component of ``group`` the row with the smallest key; equal rows, and other rows of that key, go too."""
    groups = group(df, key, text).filter(F.col(key).eqNullSafe(F.col("component")))
    row, first_row, first_key = (free_name(df, name) for name in ("row", "first_row", "first_key"))
    first = cut_lineage(groups.groupBy("root").agg(F.min("row").alias(first_row), F.first("component").alias(first_key))).drop("root")
    hashed = df.withColumn(row, row_hash(key, text))
    kept = hashed.join(first, F.col(f"`{key}`").eqNullSafe(F.col(first_key)) & (F.col(row) == F.col(first_row)), "left_semi")
    return kept.dropDuplicates([key, row]).drop(row)
