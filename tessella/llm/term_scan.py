"""Ranked lexical search without an index: an automaton of all query terms reads the documents.

Terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII; A-Z are
lower-cased. A text's other characters become line feeds, and every term of the items enters an
Aho-Corasick automaton between two line feeds, so it is found as a whole term only. What the automaton
puts out are term numbers, whose counts are the term frequencies; lists of the items that hold a
term turn them into scores.

Documents are read twice and nothing is kept of them in between. The first reading counts, in every
task, the documents with a term, their terms, and the documents that hold each item term; the second
scores them. Each task keeps the best ``TOP`` of every item, which are merged in two steps.

With N documents that have a term, L terms in them, df documents holding a term, n terms in a
document and tf occurrences there, a score sums, over the item's different terms,

    floor(1000 ln((2N + 2) / (2 df + 1))) * (10^9 tf div (1000 tf + 20 m)),  m = 50 + (50 n N) div L

in 64-bit integers. Equal scores go by id, ascending and null last.

The items' terms are sent around in blocks of at most ``BLOCK`` bytes (a term and its place in the
item lists count ``PAIR`` bytes beside its text) and one item more; each block has its own two
readings. Rows with one item_id are one item; a null item_id is an item of its own. Null and empty
texts have no term: such documents are not counted and have no score, such items no result.
Repeated documents are ranked each by itself. Without documents or items there is no result.
Ids of documents are integers. Only the named columns are read, so further ones may clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import running_total
from ..storage import cut_lineage
from .common import arrow_map

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
TOP = 50
BLOCK, PAIR = 32 << 20, 64
STEP = 256  # documents that are scored at one time
CELLS = 1 << 22  # scores and list entries that are held at one time
HELD = 1 << 20  # candidates beyond the best that a task holds
SALTS = 64
#: Each byte as it stands in a text for the automaton: ASCII but letters and digits is a line feed.
GUARDED = bytes(b if b >= 0x80 or chr(b).isalnum() else 10 for b in range(256)).lower()


def guarded(text: str | None) -> bytes:
    """The text with a line feed for all that is not in a term, and one at either end."""
    return b"\n" + (text or "").encode().translate(GUARDED) + b"\n"


def count_terms(data: bytes) -> int:
    gap = np.frombuffer(data, np.uint8) == 10
    return int(np.count_nonzero(gap[:-1] & ~gap[1:]))


def automaton(terms: list[str]):
    """All terms between line feeds; its outputs are their numbers. None without terms."""
    made = ahocorasick.Automaton()
    for number, term in enumerate(terms):
        made.add_word(f"\n{term}\n", number)
    made.make_automaton()
    return made if terms else None


def frequencies(data: bytes, machine) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the item terms in a guarded text, and how often each is there."""
    found = Counter(map(itemgetter(1), machine.iter(data.decode())))
    return np.fromiter(found.keys(), np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))


@dataclass
class Block:
    """Terms of some items: what is sent to the tasks."""

    terms: list[str]
    starts: np.ndarray  # where the items of a term begin in ``items``
    items: np.ndarray
    n_items: int
    weights: np.ndarray | None = None  # of the terms, once they are counted
    documents: int = 0
    total: int = 0


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, block, at, term): each item's different terms; ``at`` numbers the items of a block."""
    low = F.translate(F.col(text), UPPER, UPPER.lower())
    pairs = cut_lineage(items.select(F.col(key).alias("item"), F.explode(F.regexp_extract_all(low, F.lit(f"({TERM})"), F.lit(1))).alias("term")).distinct())
    sizes = pairs.groupBy("item").agg(F.sum(F.octet_length("term") + PAIR).alias("bytes"))
    chunks = max(1, sizes.count() // 1_000)
    weighed = running_total(sizes.withColumn("chunk", F.pmod(F.xxhash64("item"), F.lit(chunks))), F.col("bytes"), "through", [], "chunk", ["item"])
    dealt = weighed.select("item", F.floor((F.col("through") - F.col("bytes")) / BLOCK).alias("block"))
    # A block is bounded, and so is this window.
    numbered = dealt.select(F.col("item").alias("named"), "block", (F.row_number().over(Window.partitionBy("block").orderBy("item")) - 1).alias("at"))
    return cut_lineage(pairs.join(numbered, F.col("item").eqNullSafe(F.col("named"))).select("item", "block", "at", "term"))


def _block(pairs: DataFrame, block: int) -> Block:
    held = pairs.filter(F.col("block") == block).select("term", "at").orderBy("term", "at").toPandas()  # at most BLOCK bytes and an item
    found = held["term"].to_numpy(object)
    first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    return Block([str(t) for t in found[first]], np.append(first, len(found)), held["at"].to_numpy(np.int64), int(held["at"].max()) + 1)


def _counts(docs: DataFrame, block: Block) -> DataFrame:
    """(term, n): documents that hold each term of the block; under -1 all with a term, under -2 their terms."""
    shared = docs.sparkSession.sparkContext.broadcast(block)  # at most BLOCK bytes and an item

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value.terms
        machine = automaton(terms)
        holding, documents, total = np.zeros(len(terms), np.int64), 0, 0
        for batch in batches:
            for text in batch.column(1):
                data = guarded(text.as_py())
                n = count_terms(data)
                if n:
                    documents, total = documents + 1, total + n
                    holding[frequencies(data, machine)[0]] += 1
        seen = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, [-1, -2])), pa.array(np.append(holding[seen], [documents, total]))], ["term", "n"])

    return arrow_map(docs, run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def count(docs: DataFrame, block: Block) -> Block:
    """The block with its terms' weights, and the counts of the whole table."""
    known = dict(map(tuple, cut_lineage(_counts(docs, block)).collect()))  # a row a term of the block
    n = known.get(-1, 0)
    holding = np.array([known.get(i, 0) for i in range(len(block.terms))], float)
    weights = np.floor(1000 * np.log((2.0 * n + 2) / (2 * holding + 1))).astype(np.int64)
    return Block(block.terms, block.starts, block.items, block.n_items, weights, n, known.get(-2, 0))


class Best:
    """The best ``top`` documents of every item among those that were offered."""

    def __init__(self, n_items: int, top: int):
        self.top = top
        self.least = np.ones(n_items, np.int64)  # a smaller score cannot get in
        self.held: list[tuple] = []
        self.size = 0

    def offer(self, items, ids, known, scores) -> None:
        self.held.append((items, ids, known, scores))
        self.size += len(items)
        if self.size > HELD + 2 * self.top * len(self.least):
            self.prune()

    def prune(self) -> tuple:
        items, ids, known, scores = map(np.concatenate, zip(*self.held))
        order = np.lexsort((ids, ~known, -scores, items))
        items, ids, known, scores = items[order], ids[order], known[order], scores[order]
        first = np.flatnonzero(np.concatenate([[True], items[1:] != items[:-1]]))
        rank = np.arange(len(items)) - np.repeat(first, np.diff(np.append(first, len(items))))
        last = rank == self.top - 1
        self.least[items[last]] = scores[last]
        stay = rank < self.top
        self.held = [(items[stay], ids[stay], known[stay], scores[stay])]
        self.size = int(stay.sum())
        return self.held[0]


def _score(docs: list[tuple[np.ndarray, np.ndarray, int]], block: Block) -> np.ndarray:
    """Scores of documents (terms, frequencies, length) for every item, in rows."""
    out = np.zeros((len(docs), block.n_items), np.int64)
    flat, lengths = out.ravel(), np.diff(block.starts)
    for row, (terms, tf, n) in enumerate(docs):
        m = 50 + (50 * n * block.documents) // block.total
        part = block.weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
        sizes = lengths[terms]
        ends = np.cumsum(sizes)
        for first in range(0, int(ends[-1]) if len(ends) else 0, CELLS):
            # Entries first.. of the lists of all terms, one after the other.
            at = np.arange(first, min(first + CELLS, ends[-1]))
            of = np.searchsorted(ends, at, side="right")
            item = block.items[block.starts[terms[of]] + at - (ends[of] - sizes[of])]
            np.add.at(flat, row * block.n_items + item, part[of])
    return out


def _ranked(docs: DataFrame, block: Block, top: int) -> DataFrame:
    """(at, doc, score): the best documents of every item in each task."""
    shared = docs.sparkSession.sparkContext.broadcast(block)  # at most BLOCK bytes and an item

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        machine = automaton(held.terms)
        best = Best(held.n_items, top)
        step = max(1, min(STEP, CELLS // max(1, held.n_items)))
        for batch in batches:
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                known = part.column(0).is_valid().to_numpy(zero_copy_only=False)
                ids = part.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                counted = [(*frequencies(data, machine), count_terms(data)) for data in (guarded(t.as_py()) for t in part.column(1))]
                scores = _score(counted, held)
                row, item = np.nonzero(scores >= best.least)
                if len(row):
                    best.offer(item, ids[row], known[row], scores[row, item])
        if best.held:
            item, ids, known, scores = best.prune()
            yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int64)), pa.array(ids, mask=~known), pa.array(scores)], ["at", "doc", "score"])

    return arrow_map(docs, run, "at bigint, doc bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` documents with a score above 0."""
    pairs = item_terms(items, item, item_text)
    narrow = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text"))
    found = docs.sparkSession.createDataFrame([], "block bigint, at bigint, doc bigint, score bigint")
    for number in sorted(r["block"] for r in pairs.select("block").distinct().collect()):
        block = count(narrow, _block(pairs, number))
        if block.documents:
            found = found.unionByName(_ranked(narrow, block, top).select(F.lit(number).cast("bigint").alias("block"), "at", "doc", "score"))
    order = [F.desc("score"), F.asc_nulls_last("doc")]
    # Every task sends its best: first merged in parts of an item, then the parts.
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc", "score"), F.lit(SALTS)))
    part = salted.withColumn("rank", F.row_number().over(Window.partitionBy("block", "at", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("block", "at").orderBy(*order))).filter(F.col("rank") <= top)
    names = pairs.select("block", "at", F.col("item").alias(item)).distinct()
    return ranked.join(names, ["block", "at"]).select(item, F.col("rank").cast("int").alias("rank"), F.col("doc").alias(key), "score")
