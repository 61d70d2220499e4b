"""Byte-pair encoding and decoding of whole texts, long unsplit ones by tree concatenation.

The vocabulary's pattern splits a text into pieces, and merges never cross a piece. A piece is
encoded as a whole up to ``LEAF`` symbols. A longer one is halved until the halves fit; the halves are
encoded on their own and joined: the last tokens of the left and the first tokens of the right are
encoded again together, in a window that doubles until its first token is the left side's and its
last token is the right side's. All neighbours in the joined list then are neighbours of some
encoding, and a token list whose neighbours all fit is the encoding of its text, so the join is exact.

A text of more than ``BLOCK`` code points becomes rows: whole pieces are grouped into blocks and the
leaves of a longer piece stay rows of their own, so they are encoded in parallel; the tree joins them
when the rows of the text meet again. Results do not depend on either limit.

Null and empty texts have no tokens and decode to the empty text. A control string of the vocabulary
inside a text is its single token, as the tokenizer library reads it by default.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import models

from .common import arrow_map, free_name, map_texts, row_key
from .token_counts import byte_symbols

LEAF = 2_048  # symbols that are encoded at once
BLOCK = 65_536  # code points of a text that are one row
MAX_PIECES = 200_000
# The split pattern of this byte-level vocabulary (fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

Ids = np.ndarray
EMPTY = np.zeros(0, "<u4")


class BytePairs(dict):
    """Piece -> its ids as little-endian bytes; pieces are encoded when first looked up."""

    def __init__(self, path: str, leaf: int = LEAF):
        super().__init__()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.model = models.BPE(model["vocab"], merges)
        self.symbols = dict(enumerate(byte_symbols()))
        bytes_of = {symbol: byte for byte, symbol in self.symbols.items()}
        self.marks = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max(max(model["vocab"].values()), *self.marks.values()) + 1
        self.bytes = [b""] * size
        for token, i in model["vocab"].items():
            self.bytes[i] = bytes(bytes_of[c] for c in token)
        for content, i in self.marks.items():
            self.bytes[i] = content.encode()
        self.cut = regex.compile("(" + "|".join(regex.escape(m) for m in sorted(self.marks, key=len, reverse=True)) + ")")
        self.split = regex.compile(PIECES)
        self.leaf = leaf

    def plain(self, data: bytes) -> Ids:
        """Merges alone, of bytes that hold no control string."""
        word = data.decode("latin-1").translate(self.symbols)
        return np.array([t.id for t in self.model.tokenize(word)], "<u4")

    def window(self, left: Ids, right: Ids) -> Ids:
        return self.plain(b"".join(self.bytes[i] for i in [*left, *right]))

    def join(self, left: Ids, right: Ids) -> Ids:
        """The encoding of two neighbouring strings, from the encodings of each."""
        if not len(left) or not len(right):
            return np.concatenate([left, right])
        size = 4
        while True:
            a, b = min(size, len(left)), min(size, len(right))
            seam = self.window(left[len(left) - a :], right[:b])
            left_agrees = a == len(left) or seam[0] == left[len(left) - a]
            right_agrees = b == len(right) or seam[-1] == right[b - 1]
            if left_agrees and right_agrees:
                return np.concatenate([left[: len(left) - a], seam, right[b:]])
            size *= 2

    def tree(self, parts: list[Ids]) -> Ids:
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else EMPTY

    def halves(self, data: bytes) -> list[bytes]:
        if len(data) <= self.leaf:
            return [data]
        middle = len(data) // 2
        return [*self.halves(data[:middle]), *self.halves(data[middle:])]

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MAX_PIECES:
            self.clear()
        data = piece.encode()
        if len(data) > self.leaf:  # not kept: it is long and won't come again
            return self.tree([self.plain(h) for h in self.halves(data)]).tobytes()
        found = self[piece] = self.plain(data).tobytes()
        return found

    def sections(self, text: str) -> Iterator[tuple[str, bool]]:
        """(part, is a control string)"""
        if "<" not in text:
            yield text, False
            return
        for i, part in enumerate(self.cut.split(text)):
            if part:
                yield part, i % 2 == 1

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text, as little-endian unsigned 32-bit integers."""
        out = []
        for part, mark in self.sections(text or ""):
            out.append(np.uint32(self.marks[part]).astype("<u4").tobytes() if mark else b"".join(map(self.__getitem__, self.split.findall(part))))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")

    def rows(self, text: str, block: int) -> Iterator[tuple[int, bool, bytes]]:
        """(seq, leaf, text): blocks of whole pieces, and the leaves of pieces longer than a leaf.

        The leaves of one piece share a seq; blocks and control strings have one each.
        """
        seq = 0
        for part, mark in self.sections(text):
            start, blank, spaces = 0, 0, []  # the open block, where the white space that ends it begins, its pieces
            for match in [] if mark else self.split.finditer(part):
                begin, end = match.span()
                data = match.group().encode() if end - begin > self.leaf // 4 else b""
                if len(data) > self.leaf:
                    # White space before a cut would be split otherwise: its pieces stay rows of their own.
                    if blank > start:
                        yield seq, False, part[start:blank].encode()
                        seq += 1
                    for piece in spaces:
                        yield seq, True, piece.encode()
                        seq += 1
                    for half in self.halves(data):
                        yield seq, True, half
                    seq += 1
                    start, blank, spaces = end, end, []
                elif part[end - 1].isspace():
                    spaces.append(match.group())
                else:
                    blank, spaces = end, []
                    if end - start >= block:
                        yield seq, False, part[start:end].encode()
                        seq += 1
                        start = end
            if mark or len(part) > start:
                yield seq, False, part[start:].encode()
                seq += 1


@functools.lru_cache(maxsize=4)
def byte_pairs(path: str, leaf: int = LEAF) -> BytePairs:
    """One encoder per worker process, so its table of pieces lasts from task to task."""
    return BytePairs(path, leaf)


def _split_long(df: DataFrame, text: str, tokenizer: str, block: int, leaf: int) -> DataFrame:
    def run(batches):
        machine = byte_pairs(tokenizer, leaf)
        for batch in batches:
            for key, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = list(machine.rows(whole, block))
                columns = [pa.array([key] * len(rows)), pa.array(range(len(rows)), pa.int32()), *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.bool_(), pa.binary())))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "at", "seq", "leaf", "part"])

    return arrow_map(df.select("key", F.col(text).alias("t")), run, "key string, at int, seq int, leaf boolean, part binary")


def encode_texts(
    df: DataFrame, tokenizer: str, digest: Callable[[BytePairs, bytes], dict], fields: dict[str, pa.DataType], text: str = "text", block: int = BLOCK, leaf: int = LEAF
) -> DataFrame:
    """Every column of ``df`` but the text, and what ``digest(machine, ids)`` makes of the text's ids.

    ``tokenizer`` is the path of a byte-level tokenizer file that every executor can open. The ids of
    a text are one value, like the text itself; they reach the caller only as ``digest`` returns them.
    """
    keep = [c for c in df.columns if c != text and c not in fields]
    spark_types = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}
    schema = ", ".join(f"`{name}` {spark_types[kind]}" for name, kind in fields.items())

    def columns(machine, all_ids):
        made = [digest(machine, ids) for ids in all_ids]
        return {name: pa.array([m[name] for m in made], kind) for name, kind in fields.items()}

    def short():
        machine = byte_pairs(tokenizer, leaf)
        return lambda texts: columns(machine, map(machine.encode, texts))

    long = F.coalesce(F.length(text) > block, F.lit(False))
    direct = map_texts(df.filter(~long).select(*keep, text), text, short, schema, keep)

    key = free_name(df, "text_key")
    keyed = df.filter(long).select(*keep, F.col(text), row_key(text).alias(key))
    parts = _split_long(keyed.dropDuplicates([key]).select(F.col(key).alias("key"), text), text, tokenizer, block, leaf)

    def encode_parts(batches):
        machine = byte_pairs(tokenizer, leaf)
        for batch in batches:
            leaves, texts = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            ids = [machine.plain(t).tobytes() if is_leaf else machine.encode(t.decode()) for is_leaf, t in zip(leaves, texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.binary())], ["key", "at", "seq", "ids"])

    def meet(batches):
        machine = byte_pairs(tokenizer, leaf)
        for batch in batches:
            whole = []
            for row in batch.column(1).to_pylist():
                by_seq: dict[int, list[Ids]] = {}
                for r in sorted(row, key=lambda r: r["at"]):
                    by_seq.setdefault(r["seq"], []).append(np.frombuffer(r["ids"], "<u4"))
                whole.append(b"".join(machine.tree(leaves).tobytes() for leaves in by_seq.values()))
            made = columns(machine, whole)
            yield pa.RecordBatch.from_arrays([batch.column(0), *made.values()], ["key", *made])

    encoded = arrow_map(parts.repartition("key", "at"), encode_parts, "key string, at int, seq int, ids binary")
    gathered = encoded.groupBy("key").agg(F.collect_list(F.struct("at", "seq", "ids")).alias("parts"))
    met = arrow_map(gathered, meet, f"key string, {schema}")
    back = keyed.drop(text).join(met, F.col(key) == F.col("key")).select(*keep, *fields)
    return direct.unionByName(back)


def decode_ids(df: DataFrame, tokenizer: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """``ids`` (little-endian unsigned 32-bit integers, binary) read back as text; null stays null."""

    def make():
        machine = byte_pairs(tokenizer)
        return lambda rows: {into: pa.array([None if r is None else machine.decode(r) for r in rows], pa.string())}

    return map_texts(df, ids, make, f"`{into}` string", [c for c in df.columns if c not in (ids, into)])


def with_ids(df: DataFrame, tokenizer: str, text: str = "text", into: str = "ids") -> DataFrame:
    """The ids themselves, as binary, in place of the text."""
    return encode_texts(df, tokenizer, lambda machine, ids: {into: ids}, {into: pa.binary()}, text)


def round_trip(df: DataFrame, tokenizer: str, text: str = "text", block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of the encoding of each text and of its decoding."""

    def digest(machine, ids):
        decoded = machine.decode(ids).encode()
        return {"n_tokens": len(ids) // 4, "ids_sha256": hashlib.sha256(ids).hexdigest(), "decoded_sha256": hashlib.sha256(decoded).hexdigest()}

    return encode_texts(df, tokenizer, digest, {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}, text, block, leaf)
