"""Near copies by exact similarity: Jaccard similarity of the sets of five-word shingles, ``SIMILARITY`` or more.

Fingerprints with pivot tables (``simhash.links``) name the pairs within four bits. A copy at similarity 0.8
is about 8 of 64 bits away, and blocks that miss no pair at such a radius are 3 or 4 bits wide, so nearly all
pairs would be compared. What four bits miss comes from min-hashes: ``BANDS`` keys of ``ROWS`` minima each; a
pair at similarity s shares none of them with probability (1 - s^ROWS)^BANDS, which is 3 in a million at 0.8
and less above. Every link of both is then verified on the shingles themselves; no pair below ``SIMILARITY`` is linked.

Texts with the same shingles are one node, so copies never make pairs. Groups of one key are compared in
pairs up to ``SMALL`` nodes. Beyond that every node is compared with the group's smallest; only groups
whose nodes are then not yet connected are walked (see ``_walk``), in pairs of tiles. Texts without a
word are copies of each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut_lineage
from . import simhash
from .common import map_texts
from .components import components
from .simhash import fingerprint_of, row_hash, shingle_hashes

SHINGLE = 5
SIMILARITY = (4, 5)  # a fraction, so that the test is exact
ROWS = 4
BANDS = 24
SMALL = 64
TILE = 512
STEP = 1 << 12  # shingles whose minima are taken at once
SEEDS = np.array([xxhash.xxh64_intdigest(f"minimum {i}", 0) for i in range(ROWS * BANDS)], np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingles' hashes, ascending."""
    return np.unique(shingle_hashes(text, SHINGLE)) if text else np.zeros(0, np.uint64)


def fingerprint_pairs(prints: DataFrame) -> DataFrame:
    """(a, b): nodes of equal fingerprints, each with the smallest, and the links between these within four bits.

    A node's fingerprint is that of its set of shingles, so texts of one node have one."""
    nodes = prints.select("node", "fp").distinct()
    first = cut_lineage(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    equal = nodes.join(first, "fp").filter(F.col("node") != F.col("first")).select(F.col("first").alias("a"), F.col("node").alias("b"))
    linked = simhash.links(first).withColumnsRenamed({"a": "fp_a", "b": "fp_b"})
    of = lambda end: first.select(F.col("fp").alias(f"fp_{end}"), F.col("first").alias(end))
    return equal.unionByName(linked.join(of("a"), "fp_a").join(of("b"), "fp_b").select("a", "b"))


def node(hashes: np.ndarray) -> int:
    """One number for equal sets."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), 1) if len(hashes) else 0


def bands(hashes: np.ndarray) -> list[int]:
    """The keys: hashes of ``ROWS`` minima each, every minimum under a mixing of its own."""
    least = np.full(len(SEEDS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), STEP):
        x = hashes[None, at : at + STEP] ^ SEEDS[:, None]
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(32)
        least = np.minimum(least, x.min(axis=1))
    data = least.tobytes()
    return [xxhash.xxh64_intdigest(data[8 * ROWS * i : 8 * ROWS * (i + 1)], i) for i in range(BANDS)]


def _with_bands(df: DataFrame, text: str) -> DataFrame:
    """Add node, fingerprint and bands (none for a text without a word); the text goes."""

    def make():
        def compute(texts):
            sets = [shingle_set(t) for t in texts]
            keys = [np.array(bands(s) if len(s) else [], np.uint64).view(np.int64) for s in sets]
            signed = lambda numbers: pa.array(np.array(numbers, np.uint64).view(np.int64))
            return {"node": signed([node(s) for s in sets]), "fp": signed([fingerprint_of(s) for s in sets]), "bands": pa.array(keys, pa.list_(pa.int64()))}

        return compute

    return map_texts(df, text, make, "node bigint, fp bigint, bands array<bigint>")


def _with_sets(df: DataFrame, text: str) -> DataFrame:
    """Add the set of shingles; the text goes."""

    def make():
        def compute(texts):
            return {"shingles": pa.array([shingle_set(t).view(np.int64) for t in texts], pa.list_(pa.int64()))}

        return compute

    return map_texts(df, text, make, "shingles array<bigint>")


def _walk(nodes: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what is similar, fewer than there are nodes; ``flat`` has the sets one after another."""
    part, whole = SIMILARITY
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(len(nodes)), sizes)
    left = np.ones(len(nodes), bool)  # not yet reached
    links: list[tuple[int, int]] = []
    for first in range(len(nodes)):
        frontier = [first] if left[first] else []
        left[first] = False
        while frontier and left.any():
            at = frontier.pop()
            own = flat[starts[at] : starts[at] + sizes[at]]
            place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            both = np.bincount(owner[own[place] == flat], minlength=len(nodes))
            reached = np.flatnonzero(left & (both * whole >= part * (sizes + sizes[at] - both)))
            links += [(int(nodes[at]), int(nodes[r])) for r in reached]
            left[reached] = False
            frontier += reached.tolist()
    return links


def _walk_group(group: pa.Table) -> pa.Table:
    sets = group.column("shingles").combine_chunks()
    flat, offsets = sets.flatten().to_numpy(), sets.offsets.to_numpy()
    sizes = np.diff(offsets)
    # Signed numbers as Spark has them: a set is sorted anew, as the walk searches it.
    flat = flat.copy()
    for a, b in zip(offsets[:-1] - offsets[0], offsets[1:] - offsets[0]):
        flat[a:b].sort()
    found = _walk(group.column("node").to_numpy(), flat, sizes)
    return pa.table([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    part, whole = SIMILARITY
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    counted = both.select("a", "b", F.size(F.array_intersect("x", "y")).cast("bigint").alias("n"), (F.size("x") + F.size("y")).cast("bigint").alias("sum"))
    return counted.filter(F.col("n") * whole >= (F.col("sum") - F.col("n")) * part).select("a", "b")


def near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", small: int = SMALL, tile: int = TILE) -> DataFrame:
    """(key, row, component, root), as ``simhash.near_duplicates`` has them."""
    texts = df.select(F.col(key), F.col(text).alias("text"), row_hash(key, text).alias("row"))
    prints = cut_lineage(_with_bands(texts, "text"))
    nodes = prints.groupBy("node").agg(F.min(key).alias("least"))
    keyed = prints.select("node", F.explode("bands").alias("key")).distinct()
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hub")).filter(F.col("n") > 1)
    shared = cut_lineage(keyed.join(sizes, "key"))

    # One text of each node that has a candidate.
    close = cut_lineage(fingerprint_pairs(prints))
    met = shared.select("node").unionByName(close.select(F.col("a").alias("node"))).unionByName(close.select(F.col("b").alias("node")))
    wanted = prints.join(met.distinct(), "node", "left_semi").groupBy("node").agg(F.min("row").alias("row"))
    chosen = texts.select("text", "row").join(wanted, "row").dropDuplicates(["node"])
    sets = cut_lineage(_with_sets(chosen.select("node", "text"), "text"))

    few = shared.filter(F.col("n") <= small).select("key", F.col("node").alias("a"))
    other = few.select("key", F.col("a").alias("b"))
    many = shared.filter(F.col("n") > small)
    pairs = few.join(other, "key").filter(F.col("a") < F.col("b")).select("a", "b")
    pairs = pairs.unionByName(many.filter(F.col("node") != F.col("hub")).select(F.col("hub").alias("a"), F.col("node").alias("b")))
    pairs = pairs.unionByName(close.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
    linked = cut_lineage(_similar(pairs, sets))
    roots = cut_lineage(components(linked))

    # Large groups that are not connected yet meet as pairs of tiles (i <= j).
    parts = many.join(roots, "node", "left").groupBy("key").agg(F.min(F.coalesce("root", "node")).alias("low"), F.max(F.coalesce("root", "node")).alias("high"))
    still = many.join(parts.filter(F.col("low") != F.col("high")).select("key"), "key", "left_semi")
    tiles = F.ceil(F.col("n") / tile)
    placed = still.select("key", "node", tiles.cast("int").alias("tiles"), F.pmod(F.xxhash64("node"), tiles).cast("int").alias("tile"))
    dealt = placed.select("key", "node", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("with")).select(
        "key", "node", F.least("tile", "with").alias("i"), F.greatest("tile", "with").alias("j")
    )
    walked = cut_lineage(dealt.join(sets, "node").groupBy("key", "i", "j").applyInArrow(_walk_group, "a bigint, b bigint"))
    if not walked.isEmpty():
        roots = cut_lineage(components(linked.unionByName(walked)))

    grouped = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = grouped.groupBy("root").agg(F.min("least").alias("component"))
    return prints.drop("bands", "fp").join(grouped.join(named, "root").select("node", "component", "root"), "node").select(key, "row", "component", "root")
