"""Benchmark decontamination: SimHash of item-sized windows, candidates by Hamming blocks, exact check.

A benchmark item of n words is compared with the windows of n words of every document, and with the
whole document if that is shorter. Words are lower case, separated by white space and ASCII
punctuation; shingles are five words. Similarity is the weighted Jaccard similarity of the shingles: sum
of smaller counts over sum of larger counts; a document is contaminated by an item if a window reaches
``SIMILARITY``.

1. Every shingle of every text is hashed, and looked up among the items' shingles. A window without a
   common shingle has similarity 0, so only windows around common shingles go on; nothing else is
   skipped.
2. These windows get SimHash fingerprints, from running sums over their shingles' hashes. Candidates
   are items whose fingerprint is within ``RADIUS`` bits: the fingerprint is cut into RADIUS + 1 blocks,
   one of which must be equal, so looking all blocks up misses none.
3. Candidates are verified by counting the shingles themselves, word by word.
4. Items longer than the text need no fingerprints: those of whose shingles the text has a share of
   ``SIMILARITY`` are verified against the whole text. With fewer, the similarity can't be reached.

The benchmark is sent to the executors in blocks of at most ``ITEMS`` items; more items mean more passes
over the texts. Items with equal words are one item, with the smallest id. Items of fewer than five
words have no shingle and match nothing, and neither do null items. Null and empty texts match nothing.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, map_texts

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 20
ITEMS = 20_000
STEP = 1 << 20  # bytes of text that are hashed at once
FILTER = 22  # bits of the first look-up table
ROOT = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
UNROOT = np.uint64(pow(int(ROOT), -1, 1 << 64))
#: Bytes after lower(): ASCII punctuation, control bytes and white space all separate words.
SEPARATE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def _plain(text: str) -> bytes:
    return text.lower().encode().translate(SEPARATE)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """ROOT^i and its inverse, for as many i as a text has had bytes."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < size:
            for name, root in (("up", ROOT), ("down", UNROOT)):
                series = np.full(size, root, np.uint64)
                series[0] = 1
                setattr(self, name, np.cumprod(series, dtype=np.uint64))
        return self.up[:size], self.down[:size]


def shingles(texts: list[bytes], powers: _Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, word number) of every shingle of the texts."""
    buffer = np.frombuffer(b" ".join([*texts, b""]) + b" ", np.uint8)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    word = buffer != 32
    edges = np.flatnonzero(word[1:] != word[:-1]) + 1
    if word[0]:
        edges = np.concatenate([[0], edges])
    begin, end = edges[0::2], edges[1::2]
    up, down = powers.get(len(buffer) + 1)
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * up[: len(buffer)], out=sums[1:])
    hashes = _mixed((sums[end] - sums[begin]) * down[begin])
    of = owner[begin]
    if len(hashes) < SHINGLE:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = len(hashes) - SHINGLE + 1
    total = np.zeros(size, np.uint64)
    for i in range(SHINGLE):
        total = total * ROOT + hashes[i : i + size]
    first = np.searchsorted(of, np.arange(len(texts)))  # number of a text's first word
    whole = of[:size] == of[SHINGLE - 1 :]
    number = np.arange(size) - first[of[:size]]
    return _mixed(total)[whole], of[:size][whole], number[whole]


def _running(hashes: np.ndarray) -> np.ndarray:
    """Row i: how many of the first i hashes have each bit."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])


def _prints(running: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of all windows of ``size`` shingles: bits that more than half of them have."""
    ones = running[size:] - running[:-size]
    return np.packbits(ones * 2 > size, axis=1, bitorder="little").view(np.uint64).ravel()


def similarity(a: Counter, b: Counter) -> float:
    either = sum((a | b).values())
    return sum((a & b).values()) / either if either else 0.0


def _counted(words: list[bytes]) -> Counter:
    return Counter(tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1))


class Benchmark:
    """The index of one block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.powers = _Powers()
        by_words: dict[tuple, int] = {}
        for item_id, text in items:
            words = tuple(_plain(text or "").split())
            if len(words) >= SHINGLE and item_id is not None:
                by_words[words] = min(item_id, by_words.get(words, item_id))
        self.items = [(item_id, list(words)) for words, item_id in sorted(by_words.items(), key=lambda x: x[1])]
        self.counts = [_counted(words) for _, words in self.items]
        parts = [shingles([b" ".join(words)], self.powers)[0] for _, words in self.items]
        self.sizes = np.array([len(p) for p in parts], np.int64)  # shingles
        self.longest = max((len(words) for _, words in self.items), default=0)
        self.prints = np.array([_prints(_running(p), len(p))[0] for p in parts], np.uint64)
        owners = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        hashes = np.concatenate([np.zeros(0, np.uint64), *parts])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owners = hashes[order], owners[order]
        self.filter = np.zeros(1 << FILTER, bool)
        self.filter[(hashes & np.uint64((1 << FILTER) - 1)).astype(np.int64)] = True
        edges = [64 * i // (RADIUS + 1) for i in range(RADIUS + 2)]
        self.blocks = [(np.uint64(a), np.uint64((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:])]
        # Per window size and block: block value -> items.
        self.index: dict[int, list[dict[int, list[int]]]] = {}
        for i, (_, words) in enumerate(self.items):
            tables = self.index.setdefault(len(words), [defaultdict(list) for _ in self.blocks])
            for table, (shift, mask) in zip(tables, self.blocks):
                table[int(self.prints[i] >> shift & mask)].append(i)

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the shingles are some item's."""
        maybe = np.flatnonzero(self.filter[(hashes & np.uint64((1 << FILTER) - 1)).astype(np.int64)])
        if not len(maybe):
            return maybe
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        return maybe[self.hashes[at] == hashes[maybe]]

    def candidates(self, prints: np.ndarray, size: int) -> set[tuple[int, int]]:
        """(window, item) pairs of items of ``size`` words within RADIUS bits."""
        pairs = set()
        for table, (shift, mask) in zip(self.index[size], self.blocks):
            values = (prints >> shift) & mask
            for value, items in table.items():
                windows = np.flatnonzero(values == value)
                for i in items if len(windows) else ():
                    pairs.update((int(w), i) for w in windows[np.bitwise_count(prints[windows] ^ self.prints[i]) <= RADIUS])
        return pairs

    def longer(self, words: int, hashes: np.ndarray) -> list[int]:
        """Items of more than ``words`` words that a text with the shingles ``hashes`` can be similar to."""
        if words >= self.longest:
            return []
        hashes = np.unique(hashes)
        low = np.searchsorted(self.hashes, hashes)
        high = np.searchsorted(self.hashes, hashes, "right")
        owners, common = np.unique(np.concatenate([self.owners[a:b] for a, b in zip(low, high)]), return_counts=True)
        sizes = self.sizes[owners]
        return owners[(sizes > words - SHINGLE + 1) & (common >= SIMILARITY * sizes - 1e-6)].tolist()

    def matches(self, text: bytes, hashes: np.ndarray, hits: np.ndarray) -> dict[int, float]:
        """Item id -> highest similarity, for a text whose shingles at ``hits`` are some item's."""
        words = text.split()
        best: dict[int, float] = {}
        low = np.searchsorted(self.hashes, hashes[hits])
        high = np.searchsorted(self.hashes, hashes[hits], "right")
        near: dict[int, list[int]] = defaultdict(list)  # window size -> places of shingles of its items
        for place, a, b in zip(hits.tolist(), low, high):
            for size in {len(self.items[i][1]) for i in self.owners[a:b]}:
                near[size].append(place)
        for item in self.longer(len(words), hashes[hits]):
            value = similarity(_counted(words), self.counts[item])
            if value >= SIMILARITY:
                item_id = self.items[item][0]
                best[item_id] = max(value, best.get(item_id, 0.0))
        for size, places in near.items():
            if size > len(words):  # compared above
                continue
            length = size - SHINGLE + 1
            for first, last in _regions(places, length):
                begin, end = max(0, first - length + 1), min(len(hashes), last + length)
                if end - begin < length:
                    continue
                prints = _prints(_running(hashes[begin:end]), length)
                counted: dict[int, Counter] = {}
                for window, item in sorted(self.candidates(prints, size)):
                    at = begin + window
                    if window not in counted:
                        counted[window] = _counted(words[at : at + size])
                    value = similarity(counted[window], self.counts[item])
                    if value >= SIMILARITY:
                        item_id = self.items[item][0]
                        best[item_id] = max(value, best.get(item_id, 0.0))
        return best

    def search(self, texts: list[str | None]) -> list[dict[int, float]]:
        """For each text its items and their highest similarity."""
        found: list[dict[int, float]] = [{} for _ in texts]
        if not self.items:
            return found
        held: list[int] = []
        plain: list[bytes] = []
        size = 0
        for number, text in enumerate([*texts, None]):
            if text:
                held.append(number)
                plain.append(_plain(text))
                size += len(plain[-1])
            if held and (size >= STEP or number == len(texts)):
                hashes, of, _ = shingles(plain, self.powers)
                known = self.known(hashes)
                edges = np.searchsorted(of, np.arange(len(plain) + 1))
                for i in np.unique(of[known]):
                    hits = known[(known >= edges[i]) & (known < edges[i + 1])] - edges[i]
                    found[held[i]] = self.matches(plain[i], hashes[edges[i] : edges[i + 1]], hits)
                held, plain, size = [], [], 0
        return found


def _regions(places: list[int], reach: int) -> list[tuple[int, int]]:
    """Places that windows of ``reach`` shingles can share, as (first, last)."""
    regions = [[places[0], places[0]]]
    for place in places[1:]:
        if place - regions[-1][1] < 2 * reach:
            regions[-1][1] = place
        else:
            regions.append([place, place])
    return [(a, b) for a, b in regions]


def contaminated(
    df: DataFrame, benchmark: DataFrame, text: str = "text", keep: list[str] | None = None, block: int = ITEMS, into: tuple[str, str] = ("item_ids", "similarity")
) -> DataFrame:
    """The columns ``keep`` (default: all) with item_ids (ascending) and similarity (of the closest item).

    ``benchmark``: item_id, text. Texts without a match have no item ids and similarity 0. ``into``
    names the two columns.
    """
    items = benchmark.select("item_id", "text").filter(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    blocks = max(1, math.ceil(items.count() / block))
    numbered = items.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks)))  # equal texts meet
    keep = df.columns if keep is None else keep
    pairs = pa.list_(pa.struct([("id", pa.int64()), ("similarity", pa.float64())]))
    names = []
    for number in range(blocks):
        rows = [(r["item_id"], r["text"]) for r in numbered.filter(F.col("block") == number).collect()]  # one block
        shared = df.sparkSession.sparkContext.broadcast(rows)
        name = free_name(df, "found")
        names.append(name)

        def make(shared=shared, name=name):
            index = Benchmark(shared.value)

            def compute(texts):
                return {name: pa.array([[{"id": i, "similarity": s} for i, s in sorted(f.items())] for f in index.search(texts)], pairs)}

            return compute

        last = number == blocks - 1
        wanted = list(dict.fromkeys([*keep, *names[:-1]] if last else [*df.columns]))
        df = map_texts(df, text, make, f"`{name}` array<struct<id:bigint,similarity:double>>", wanted)
    every = F.flatten(F.array(*names))
    return df.select(
        *[F.col(f"`{c}`") for c in keep],
        F.array_sort(F.array_distinct(F.transform(every, lambda x: x["id"]))).alias(into[0]),
        F.coalesce(F.array_max(F.transform(every, lambda x: x["similarity"])), F.lit(0.0)).alias(into[1]),
    )
