"""Language identification by prediction by partial matching over bytes.

For every language one byte context tree of order ``ORDER`` is counted over all its training texts.
The counts are frozen, and a text's code length under a tree is exact: a byte that followed its
context n times costs -log2(n / (total + distinct)); otherwise an escape of -log2(distinct / (total +
distinct)) is paid and the context gets one byte shorter, down to a uniform code of 8 bits. The
language with the shortest code wins (first in name order on ties).

All counted entries are kept, as a Spark table. A language's code lengths need its own entries only, so
languages are sent around in blocks: as many as fit in ``CELLS`` numbers (entries times languages). Each
block has its own pass over the texts. A language of more entries is dealt out by the context of
an entry to several passes, whose code lengths add up; each also has the shorter contexts, of which
there are at most 2^24 a language.

Texts start in a context of zero bytes. Null texts and texts without a letter are ``und`` with score 0,
and so is everything when there is nothing to learn from. The score is the winner's share when the
languages are weighed by 2^-(code length). Rows may repeat; the names in ``into`` must be free in the table, a
clash is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import compute_once
from ..storage import cut_lineage
from .common import arrow_map, map_texts, refuse_taken

ORDER = 3
CELLS = 1 << 22  # entries times languages of what is sent around at once
HELD = 1_600_000  # entries a counting task holds before it passes them on
MIX = 2_654_435_761
STEP = 1 << 21  # bytes that are worked on at once
LETTER = regex.compile(r"\p{L}")


def _codes(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(codes, starts, rows): for each byte its last ``ORDER`` bytes and itself as one number.

    ``starts`` are the places in ``codes`` where a row's bytes begin; a long text comes in several steps.
    """
    held: list[tuple[int, bytes]] = []
    size = 0

    def flush():
        buffer = np.frombuffer(b"".join(data for _, data in held), np.uint8).astype(np.uint32)
        lengths = np.array([len(data) for _, data in held])
        ends = np.cumsum(lengths)
        codes = buffer[ORDER:].copy()
        for back in range(1, ORDER + 1):
            codes |= buffer[ORDER - back : len(buffer) - back] << np.uint32(8 * back)
        real = np.ones(len(codes), bool)
        for back in range(1, ORDER + 1):
            real[(ends - back)[ends - back < len(codes)]] = False
        starts = np.concatenate([[0], np.cumsum(lengths - ORDER)[:-1]])
        return codes[real], starts, np.array([row for row, _ in held])

    for row, text in enumerate(texts):
        data = text.encode()
        for at in range(0, len(data), STEP):
            piece = (data[at - ORDER : at] if at else bytes(ORDER)) + data[at : at + STEP]
            held.append((row, piece))
            size += len(piece)
            if size >= STEP:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def count_contexts(df: DataFrame, label: str, text: str = "text") -> DataFrame:
    """(label, code, n): how often each byte follows each context of ``ORDER`` bytes, per label."""

    def run(batches):
        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def add(name, codes):
            held = totals.get(name)
            values, counts = np.unique(codes, return_counts=True)
            if held is not None:
                values, back = np.unique(np.concatenate([held[0], values]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([held[1], counts])).astype(np.int64)
            totals[name] = values, counts

        def rows():
            for name, (values, counts) in totals.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(values), pa.string()), pa.array(values.astype(np.int64)), pa.array(counts.astype(np.int64))], ["label", "code", "n"])

        for batch in batches:
            by: dict[str, list[str]] = {}
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(name, []).append(t)
            for name, texts in by.items():
                for codes, _, _ in _codes(texts):
                    add(name, codes)
            if sum(len(values) for values, _ in totals.values()) > HELD:  # pass on, and start anew
                yield from rows()
                totals.clear()
        yield from rows()

    learned = df.filter(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).cast("string"), text)
    return arrow_map(learned, run, "label string, code bigint, n bigint").groupBy("label", "code").agg(F.sum("n").alias("n"))


def part_of(contexts: np.ndarray, parts: int) -> np.ndarray:
    """Which of ``parts`` passes has the entries of a context."""
    return ((contexts.astype(np.int64) * MIX & 0xFFFFFFFF) >> 16) % parts


class ContextTrees:
    """Frozen trees of several languages, as tables that are looked up for many bytes at once.

    ``lower``: label ids, codes without the first byte of the context, and counts, where ``codes`` are
    those of one part only. Bytes in contexts of other parts have length 0.
    """

    def __init__(self, labels: list[str], label_ids: np.ndarray, codes: np.ndarray, counts: np.ndarray, lower: tuple | None = None, part: int = 0, parts: int = 1):
        self.labels, self.part, self.parts = labels, part, parts
        self.symbols: list[np.ndarray] = []  # per order: known (context, byte) codes
        self.costs: list[np.ndarray] = []  # and their code lengths in each language
        self.contexts: list[np.ndarray] = []  # per order: known contexts
        self.escapes: list[np.ndarray] = []  # and the code length of an escape from them
        whole = label_ids, codes, counts
        for order in range(ORDER + 1):
            label_ids, codes, counts = lower if lower is not None and order < ORDER else whole
            known, at = np.unique(codes & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
            table = np.zeros((len(known), len(labels)))
            np.add.at(table, (at, label_ids), counts)
            context, of = np.unique(known >> 8, return_inverse=True)
            total, distinct = np.zeros((2, len(context), len(labels)))
            np.add.at(total, of, table)
            np.add.at(distinct, of, table > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(distinct > 0, -np.log2(distinct / (total + distinct)), 0)
                cost = -np.log2(table / (total + distinct)[of])
            shorter = self.lengths(order - 1, known & ((1 << 8 * order) - 1))
            self.symbols.append(known.astype(np.uint32))
            self.costs.append(np.where(table > 0, cost, escape[of] + shorter).astype(np.float32))
            self.contexts.append(context.astype(np.uint32))
            self.escapes.append(escape.astype(np.float32))

    def lengths(self, order: int, codes: np.ndarray) -> np.ndarray:
        """Code lengths in bits, one row per code and one column per language."""
        if order < 0:
            return np.full((len(codes), len(self.labels)), 8, np.float32)
        at, known = self._find(self.symbols[order], codes)
        out = self.costs[order][at] if len(self.costs[order]) else np.zeros((len(codes), len(self.labels)), np.float32)
        if not known.all():
            new = codes[~known]
            found, seen = self._find(self.contexts[order], new >> 8)
            escape = np.where(seen[:, None], self.escapes[order][found], 0) if seen.any() else np.float32(0)
            out[~known] = escape + self.lengths(order - 1, new & ((1 << 8 * order) - 1))
        return out

    @staticmethod
    def _find(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values = values.astype(np.uint32)
        if not len(table):
            return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
        at = np.minimum(np.searchsorted(table, values), len(table) - 1)
        return at, table[at] == values

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        total = np.zeros((len(texts), len(self.labels)))
        for codes, starts, rows in _codes(texts):
            if self.parts == 1:
                found = self.lengths(ORDER, codes)
            else:
                found = np.zeros((len(codes), len(self.labels)), np.float32)
                mine = part_of(codes >> np.uint32(8), self.parts) == self.part
                found[mine] = self.lengths(ORDER, codes[mine])
            np.add.at(total, rows, np.add.reduceat(found, starts, axis=0, dtype=np.float64))
        return total


@dataclass
class Learned:
    """All counted entries, as a table, and which passes take which of them."""

    counts: DataFrame
    passes: list[tuple[list[str], int, int]]  # languages, part, parts

    @property
    def labels(self) -> list[str]:
        return list(dict.fromkeys(label for labels, _, _ in self.passes for label in labels))

    def trees(self, labels: list[str], part: int, parts: int) -> ContextTrees:
        """The trees of one pass: at most ``CELLS`` numbers of the longest contexts."""
        mine = self.counts.filter(F.col("label").isin(labels))
        at = F.pmod(F.shiftright((F.shiftright("code", 8) * F.lit(MIX)).bitwiseAND(F.lit(0xFFFFFFFF)), 16), F.lit(parts))
        top = self._rows(mine.filter(at == part), labels)
        if parts == 1:
            return ContextTrees(labels, *top)
        short = mine.groupBy("label", F.col("code").bitwiseAND(F.lit(0xFFFFFF)).alias("code")).agg(F.sum("n").alias("n"))
        return ContextTrees(labels, *top, self._rows(cut_lineage(short), labels), part, parts)

    @staticmethod
    def _rows(entries: DataFrame, labels: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        names = F.array(*[F.lit(x) for x in labels])
        rows = entries.select((F.array_position(names, F.col("label")) - 1).cast("int").alias("i"), "code", "n").toPandas()
        return rows["i"].to_numpy(np.int64), rows["code"].to_numpy(np.int64), rows["n"].to_numpy(np.float64)


def learn(df: DataFrame, label: str = "lang", text: str = "text", cells: int | None = None) -> Learned | None:
    """Counts of all labelled texts, and the passes that apply them; None if there are none."""
    cells = CELLS if cells is None else cells
    counts = cut_lineage(count_contexts(df, label, text))
    passes: list[tuple[list[str], int, int]] = []
    held: list[str] = []
    entries = 0
    for name, n in sorted(map(tuple, counts.groupBy("label").count().collect())):  # a row a language
        if held and (entries + n) * (len(held) + 1) > cells:
            passes.append((held, 0, 1))
            held, entries = [], 0
        if n > cells:
            parts = -(-n // cells)
            passes += [([name], part, parts) for part in range(parts)]
        else:
            held, entries = [*held, name], entries + n
    if held:
        passes.append((held, 0, 1))
    return Learned(counts, passes) if passes else None


def identify(df: DataFrame, learned: Learned | None, text: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Every column but the text, with the language and score of the whole text under the names ``into``."""
    keep = [c for c in df.columns if c != text]
    refuse_taken(keep, into)
    if learned is None:
        return df.select(*[F.col(f"`{c}`") for c in keep], F.lit("und").alias(into[0]), F.lit(0.0).alias(into[1]))
    rows = df
    columns: dict[str, list[str]] = {}
    for number, (labels, part, parts) in enumerate(learned.passes):
        shared = df.sparkSession.sparkContext.broadcast(learned.trees(labels, part, parts))  # bounded by CELLS

        def make(shared=shared, out=f"\x01bits{number}"):
            model = shared.value

            def compute(texts):
                known = [t if t and LETTER.search(t) else "" for t in texts]
                bits = model.code_lengths(known)
                return {out: pa.array([b.tolist() if t else None for t, b in zip(known, bits)], pa.list_(pa.float64()))}

            return compute

        columns.setdefault("\x00".join(labels), []).append(f"\x01bits{number}")
        last = number == len(learned.passes) - 1
        rows = map_texts(rows, text, make, f"`\x01bits{number}` array<double>", [c for c in rows.columns if c != text or not last])
    # Parts of one language add up; then the languages stand in name order.
    sums = []
    for parts in columns.values():
        total = F.col(f"`{parts[0]}`")
        for name in parts[1:]:
            total = F.zip_with(total, F.col(f"`{name}`"), lambda a, b: a + b)
        sums.append(total)
    bits = compute_once(rows.select(*[F.col(f"`{c}`") for c in keep], F.concat(*sums).alias("\x01bits")), "\x01bits", F.col("`\x01bits`"))
    least = F.array_min("`\x01bits`")
    share = 1 / F.aggregate("`\x01bits`", F.lit(0.0), lambda a, b: a + F.pow(F.lit(2.0), F.greatest(least - b, F.lit(-1000.0))))
    best = F.get(F.array(*[F.lit(x) for x in learned.labels]), (F.array_position("`\x01bits`", least) - 1).cast("int"))
    return bits.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(best, F.lit("und")).alias(into[0]), F.coalesce(share, F.lit(0.0)).alias(into[1]))


def learn_and_identify(df: DataFrame, held: Column, label: str = "lang", text: str = "text") -> DataFrame:
    """Trees from the rows that are not held out, applied to all rows."""
    return identify(df, learn(df.filter(~held), label, text), text)
