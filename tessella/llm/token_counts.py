"""Exact token counts from a compiled finite-state transducer.

The merge vocabulary is compiled to one deterministic automaton that reads a word symbol by symbol
and knows, in every state, which vocabulary entries end there. The tokens of a prefix follow from
those of a shorter one: exactly one of these entries is *compatible* with the last token before it
(merging the two strings from scratch gives the same two tokens). So every transition is annotated
with the number of tokens emitted up to it, and the final one (the word-end mark) with that of the
whole word. Counts of words are kept in a table of bounded size, which is emptied when it is full.

A chunk of text maps to (count, open left end, open right end). These maps compose associatively:
only the word across the join is counted anew. So long texts are cut anywhere, chunks are counted as
rows of their own, and their maps are composed pairwise.

Texts: null and empty count 0. Control strings of the vocabulary inside a text count one token each,
as the tokenizer library reads them by default.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, free_name, map_texts, row_key

CHUNK = 65_536  # code points of a text that are one row
MAX_WORDS = 800_000
NEVER = 1 << 60
END = "\x00"  # no byte symbol, so free to mark the end of a word
# White space of the vocabulary's own patterns; Python's split() also takes the four separators.
SPACE = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
SEPARATORS = regex.compile(r"[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbols, spare = [""] * 256, 256
    for byte in range(256):
        if byte in plain:
            symbols[byte] = chr(byte)
        else:
            symbols[byte], spare = chr(spare), spare + 1
    return symbols


class Transducer(dict):
    """Piece without white space -> number of tokens; pieces are counted when first looked up."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab = model["vocab"]
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
        self.end = model.get("end_of_word_suffix") or ""
        self.symbols = dict(enumerate(byte_symbols()))
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        marks = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.marks = regex.compile("|".join(map(regex.escape, marks)))
        self.made_by = {"".join(pair): (rank, pair) for pair, rank in self.ranks.items()}
        self.left_edges: dict[str, list[tuple[str, int]]] = {}
        self.right_edges: dict[str, list[tuple[str, int]]] = {}
        self.fits: dict[int, bool] = {}
        self.word_counts: dict[str, int] = {}
        self.names = {i: name for name, i in self.vocab.items()}
        self.automaton = ahocorasick.Automaton()
        for name, i in self.vocab.items():
            body = name.removesuffix(self.end) if self.end else name
            self.automaton.add_word(body + END if len(body) < len(name) else name, (len(body), i))
        self.automaton.make_automaton()

    def edges(self, token: str, right: bool) -> list[tuple[str, int]]:
        """The symbols at one end of a token while it is being merged, each with the rank that ends it."""
        known = self.right_edges if right else self.left_edges
        chain = known.get(token)
        if chain is None:
            rank, pair = self.made_by.get(token, (0, None))
            if pair is None:
                chain = [(token, NEVER)]
            else:
                inner = self.edges(pair[right], right)
                chain = [*inner[:-1], (inner[-1][0], rank), (token, NEVER)]
            known[token] = chain
        return chain

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the two strings from scratch leaves exactly these two tokens.

        No merge may join the symbols that face each other while both last. At equal rank the
        leftmost merge goes first: one inside the left token, then one across, then one inside the right.
        """
        xs, ys, i, j = self.edges(self.names[left], True), self.edges(self.names[right], False), 0, 0
        while True:
            (x, x_ends), (y, y_ends) = xs[i], ys[j]
            rank = self.ranks.get((x, y), NEVER)
            if rank < x_ends and rank <= y_ends:
                return False
            if x_ends == y_ends == NEVER:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def count_word(self, word: str) -> int:
        """Tokens of one word of byte symbols."""
        size = len(word)
        last, emitted, fits = [-1] * (size + 2), [0] * (size + 2), self.fits
        for at, (length, token) in self.automaton.iter(word + END):
            start = at - length if at == size else at + 1 - length
            if emitted[at + 1]:
                continue
            if start:
                before = last[start]
                pair = before << 20 | token
                fit = fits.get(pair)
                if fit is None:
                    if len(fits) >= MAX_WORDS:
                        fits.clear()
                    fit = fits[pair] = self.compatible(before, token)
                if not fit:
                    continue
            last[at + 1], emitted[at + 1] = token, emitted[start] + 1
        return emitted[size + 1]

    def __missing__(self, piece: str) -> int:
        if len(self) > MAX_WORDS:
            self.clear()
        total, parts = 0, [piece]
        if "<" in piece:
            total, parts = len(self.marks.findall(piece)), self.marks.split(piece)
        for part in parts:
            # Lower case goes by single characters, so a final capital sigma has no form of its own.
            plain = part.lower() if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            for word in [plain] if plain.isalpha() and plain.isascii() else self.words.findall(plain):
                known = self.word_counts.get(word)
                if known is None:
                    if len(self.word_counts) >= MAX_WORDS:
                        self.word_counts.clear()
                    simple = word.isascii() and word.isprintable()
                    known = self.count_word(word if simple else word.encode().decode("latin-1").translate(self.symbols))
                    self.word_counts[word] = known
                total += known
        self[piece] = total
        return total

    def pieces(self, text: str) -> list[str]:
        return text.split() if not SEPARATORS.search(text) else [p for p in SPACE.split(text) if p]

    def count(self, text: str | None) -> int:
        return sum(map(self.__getitem__, self.pieces(text))) if text else 0

    def chunk_map(self, chunk: str) -> tuple[int, str, str | None]:
        """(count of whole pieces, open left end, open right end); no right end: all one open piece."""
        first = SPACE.search(chunk)
        if first is None:
            return 0, chunk, None
        *_, last = SPACE.finditer(chunk)
        return self.count(chunk[first.end() : last.start()]), chunk[: first.start()], chunk[last.end() :]

    def compose(self, left: tuple, right: tuple) -> tuple:
        if left[2] is None and right[2] is None:
            return 0, left[1] + right[1], None
        if left[2] is None:
            return right[0], left[1] + right[1], right[2]
        if right[2] is None:
            return left[0], left[1], left[2] + right[1]
        joint = left[2] + right[1]
        return left[0] + right[0] + (self[joint] if joint else 0), left[1], right[2]

    def closed(self, chunk: tuple) -> int:
        return chunk[0] + sum(self[end] for end in chunk[1:] if end)


@functools.lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """One machine per worker process and file, so its tables last from task to task."""
    return Transducer(path)


def count_tokens(df: DataFrame, tokenizer: str, text: str = "text", into: str = "n_tokens", chunk: int = CHUNK) -> DataFrame:
    """Every column of ``df`` and the token count of its whole text.

    ``tokenizer`` is the path of a tokenizer file (merges with a word-end mark) that every executor
    can open. Texts of up to ``chunk`` code points are counted where they are. Longer ones are cut
    into rows, and the maps of the chunks meet again by a key of the text; repeated rows are counted
    once and all get the count.
    """

    def short():
        machine = transducer(tokenizer)
        return lambda texts: {into: pa.array([machine.count(t) for t in texts], pa.int64())}

    long = F.coalesce(F.length(text) > chunk, F.lit(False))
    keep = [c for c in df.columns if c != into]
    wanted = [*keep, into]
    key = free_name(df, "text_key")
    # The text itself goes back to the caller, so it is passed along beside the counted copy.
    copy = free_name(df, "text_copy")
    counted = map_texts(df.filter(~long).select(*keep, F.col(text).alias(copy)), copy, short, f"`{into}` bigint")

    keyed = df.filter(long).select(*keep, row_key(text).alias(key))
    starts = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / chunk).cast("int"))
    chunks = (
        keyed.dropDuplicates([key])
        .select(F.col(key).alias("key"), F.col(text).alias("t"), F.explode(starts).alias("seq"))
        .select("key", "seq", F.substring("t", F.col("seq") * chunk + 1, F.lit(chunk)).alias("t"))
    )

    def maps():
        machine = transducer(tokenizer)

        def compute(texts):
            found = [machine.chunk_map(t) for t in texts]
            return {"n": pa.array([m[0] for m in found], pa.int64()), "left": pa.array([m[1] for m in found], pa.string()), "right": pa.array([m[2] for m in found], pa.string())}

        return compute

    def composed(rows):
        machine = transducer(tokenizer)
        for batch in rows:
            totals = []
            for row in batch.column(1).to_pylist():
                level = [(r["n"], r["left"], r["right"]) for r in sorted(row, key=lambda r: r["seq"])]
                while len(level) > 1:  # neighbours first, as in a scan
                    level = [machine.compose(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
                totals.append(machine.closed(level[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64())], ["key", "total"])

    gathered = (
        map_texts(chunks.repartition("key", "seq"), "t", maps, "n bigint, `left` string, `right` string")
        .groupBy("key")
        .agg(F.collect_list(F.struct("seq", "n", "left", "right")).alias("maps"))
    )
    summed = arrow_map(gathered, composed, "key string, total bigint")
    back = keyed.join(summed, F.col(key) == F.col("key")).select(*keep, F.col("total").alias(into))
    return counted.select(*wanted).unionByName(back.select(*wanted))
