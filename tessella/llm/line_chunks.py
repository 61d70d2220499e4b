"""Line dedup by content-defined chunks. DataFrame operations only.

A text's lines are grouped into chunks at boundaries that depend on nearby lines only, so an insertion
elsewhere does not move them: a line of ``LONG`` words or more stands alone, and in a run of shorter
lines a boundary follows where a rolling hash over the last two line hashes (of the run) is divisible
by ``DIVISOR``. Chunks that occur more than once anywhere are found by grouping on the hash and the
bytes. A hash with two different texts counts as not repeated. All but the first occurrence go, in
order of (id, text, place), when consecutive repeated chunks of a text together have at least
``MIN_WORDS`` words; shorter repeats, such as a common title line, stay.

Every row comes back. Null text stays null; a text of which nothing is left is empty. Rows that are
equal in id and text are one document and get equal results. Null ids come first in the order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import compute_once
from ..storage import cut_lineage
from .common import WORD, free_name

LONG = 8
DIVISOR = 4
MIN_WORDS = 20


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("bigint")


def _with_starts(df: DataFrame, text: str, lines: str, facts: str, starts: str) -> DataFrame:
    """Add the lines, their (words, hash) and the numbers of the lines that chunks begin with."""
    counts = free_name(df, "counts")
    df = compute_once(df, lines, F.coalesce(F.split(text, "\n"), F.array().cast("array<string>")))
    df = compute_once(df, counts, F.transform(lines, lambda line: F.regexp_count(line, F.lit(WORD))))
    df = compute_once(df, facts, F.zip_with(lines, counts, lambda line, n: F.struct(n.alias("words"), F.when(n < LONG, _line_hash(line)).alias("hash"))))
    hash_at = lambda i: F.get(facts, i)["hash"]  # null: a long line
    # A boundary before line i: beside a long line, or where the two lines before it say so.
    begins = lambda i: (
        (i == 0)
        | hash_at(i).isNull()
        | hash_at(i - 1).isNull()
        | ((F.coalesce(F.when(i > 1, hash_at(i - 2)), F.lit(0)) * 31 + hash_at(i - 1)) % DIVISOR == 0)
    )
    return compute_once(df, starts, F.filter(_places(lines), begins)).drop(counts)


def _places(items: str) -> Column:
    return F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1)).otherwise(F.array().cast("array<int>"))


def with_chunks(df: DataFrame, text: str, into: str) -> DataFrame:
    """Add the chunks of each text: array of (words, text), in order. Null text: no chunk."""
    lines, facts, starts = (free_name(df, name) for name in ("lines", "facts", "starts"))
    df = _with_starts(df, text, lines, facts, starts)
    size = lambda s, k: F.coalesce(F.get(starts, k + 1), F.size(lines)) - s
    chunk = lambda s, k: F.struct(
        F.aggregate(F.slice(facts, s + 1, size(s, k)), F.lit(0), lambda n, f: n + f["words"]).alias("words"),
        F.array_join(F.slice(lines, s + 1, size(s, k)), "\n").alias("text"),
    )
    return compute_once(df, into, F.transform(starts, chunk)).drop(lines, facts, starts)


def with_units(df: DataFrame, text: str, into: str) -> DataFrame:
    """Add the chunks and the windows of each text: array of (kind, at, words, text).

    ``at`` is the first line and ``words`` has the words of each line. From every short line that has
    words a window reaches forward, and another one back, to the nearest line that makes it ``LONG``
    words, which is at most ``LONG`` lines with words away. So every short line of a passage of
    2 * ``LONG`` words or more is in a window that lies in the passage, whatever surrounds it.
    """
    lines, facts, starts, full, sizes, spans = (free_name(df, name) for name in ("lines", "facts", "starts", "full", "sizes", "spans"))
    df = _with_starts(df, text, lines, facts, starts)
    df = compute_once(df, full, F.filter(_places(lines), lambda i: F.get(facts, i)["words"] > 0))
    df = compute_once(df, sizes, F.transform(full, lambda i: F.get(facts, i)["words"]))
    enough = lambda words: F.aggregate(  # lines of ``words`` up to LONG words, null if there are fewer
        words,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("k")),
        lambda so, n: F.when(so["n"] >= LONG, so).otherwise(F.struct((so["n"] + n).alias("n"), (so["k"] + 1).alias("k"))),
        lambda so: F.when(so["n"] >= LONG, so["k"]),
    )
    short = F.filter(_places(full), lambda j: F.get(sizes, j) < LONG)
    span = lambda kind, first, last: F.struct(F.lit(kind).alias("kind"), first.alias("first"), last.alias("last"))
    ahead = lambda j: span(1, F.get(full, j), F.get(full, j + enough(F.slice(sizes, j + 1, F.lit(LONG))) - 1))
    back = lambda j: span(
        2, F.get(full, j + 1 - enough(F.reverse(F.slice(sizes, F.greatest(j + 2 - LONG, F.lit(1)), F.least(j + 1, F.lit(LONG)))))), F.get(full, j)
    )
    chunks = F.transform(starts, lambda s, k: span(0, s, F.coalesce(F.get(starts, k + 1), F.size(lines)) - 1))
    windows = F.concat(F.transform(short, ahead), F.transform(short, back))
    df = compute_once(df, spans, F.concat(chunks, F.filter(windows, lambda s: s["first"].isNotNull() & s["last"].isNotNull())))
    part = lambda of, s: F.slice(of, s["first"] + 1, s["last"] - s["first"] + 1)
    unit = lambda s: F.struct(
        s["kind"].alias("kind"),
        s["first"].alias("at"),
        F.transform(part(facts, s), lambda f: f["words"]).alias("words"),
        F.array_join(part(lines, s), "\n").alias("text"),
    )
    return compute_once(df, into, F.transform(spans, unit)).drop(lines, facts, starts, full, sizes, spans)


def repeated_hashes(chunks: DataFrame) -> DataFrame:
    """(hash) of chunk texts that occur more than once; ``chunks`` has hash and text.

    Grouping compares bytes, and copies meet first within each task, so a chunk of any number of
    copies is a few rows by the time it is shuffled.
    """
    texts = chunks.groupBy("hash", "text").agg(F.count(F.lit(1)).alias("n"))
    hashes = texts.groupBy("hash").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"))
    return hashes.filter((F.col("n") > 1) & (F.col("texts") == 1)).select("hash")


def _doc(key: str, text: str) -> list[Column]:
    """What tells documents apart: the id and a hash of it and the text."""
    return [F.col(key).alias("id"), F.xxhash64(key, text).alias("doc")]


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", n_removed: str = "n_removed") -> DataFrame:
    """``df`` with repeated chunks taken out of its texts, and the number of chunks that went.

    Texts are read three times: to group the chunks' bytes, for the places of the chunks (numbers
    only, kept in the checkpoint folder), and to cut.
    """
    own = with_chunks(df.select(*_doc(key, text), F.col(text).alias("text")), "text", "chunks").drop("text")
    chunks = own.select("id", "doc", F.posexplode("chunks").alias("at", "c")).select(
        "id", "doc", "at", F.col("c.words").alias("words"), F.col("c.text").alias("text"), F.xxhash64("c.text").alias("hash")
    )
    repeated = repeated_hashes(chunks.select("hash", "text"))
    found = cut_lineage(chunks.drop("text").join(repeated, "hash"))
    firsts = found.groupBy("hash").agg(F.min(F.struct("id", "doc", "at")).alias("first"))
    later = found.join(firsts, "hash").filter(F.struct("id", "doc", "at") != F.col("first"))  # null ids are equal here

    # Repeated rows bring the same chunk several times; consecutive chunks of a text are one run.
    removed = _long_runs(later.select("id", "doc", "at", "words"))
    return _without(df, removed, key, text, n_removed, lambda texts, name, into: with_chunks(texts, name, into).withColumn(into, F.col(f"`{into}`.text")))


def dedup_passages(df: DataFrame, key: str = "doc_id", text: str = "text", n_removed: str = "n_removed") -> DataFrame:
    """``df`` without repeated passages, to the line, and the number of lines that went.

    As ``dedup_lines``, but the windows over short lines (see ``with_units``) count besides the chunks:
    a line in a chunk or window that is not the first of its bytes is repeated, and runs of repeated
    lines go from ``MIN_WORDS`` words on. A line that goes is in an earlier place too, of which the
    first stays.
    """
    own = with_units(df.select(*_doc(key, text), F.col(text).alias("text")), "text", "units").drop("text")
    units = own.select("id", "doc", F.explode("units").alias("u")).select(
        "id", "doc", F.col("u.at").alias("at"), F.col("u.words").alias("words"), F.col("u.text").alias("text"), F.xxhash64("u.text", "u.kind").alias("hash")
    )
    repeated = repeated_hashes(units.select("hash", "text"))
    found = cut_lineage(units.drop("text").join(repeated, "hash"))
    firsts = found.groupBy("hash").agg(F.min(F.struct("id", "doc", "at")).alias("first"))
    later = found.join(firsts, "hash").filter(F.struct("id", "doc", "at") != F.col("first"))  # null ids are equal here
    lines = later.select("id", "doc", "at", F.posexplode("words").alias("line", "n")).select("id", "doc", (F.col("at") + F.col("line")).alias("at"), F.col("n").alias("words"))
    return _without(df, _long_runs(lines), key, text, n_removed, lambda texts, name, into: compute_once(texts, into, F.split(name, "\n")))


def _long_runs(later: DataFrame) -> DataFrame:
    """(id, doc, gone): the places in runs of ``MIN_WORDS`` words or more; ``later`` has id, doc, at, words."""
    places = Window.partitionBy("doc", "id").orderBy("at")
    runs = later.distinct().withColumn("run", F.col("at") - F.row_number().over(places))
    long = runs.groupBy("doc", "id", "run").agg(F.sum("words").alias("words"), F.collect_list("at").alias("ats")).filter(F.col("words") >= MIN_WORDS)
    return long.groupBy("doc", "id").agg(F.flatten(F.collect_list("ats")).alias("gone"))


def _without(df: DataFrame, removed: DataFrame, key: str, text: str, n_removed: str, split: Callable[[DataFrame, str, str], DataFrame]) -> DataFrame:
    """``df`` less the parts ``gone`` of the texts, and their number; ``split`` adds the parts of a text."""
    gone, doc, same, cut_text, parts = (free_name(df, name) for name in ("gone", "doc", "same_id", "cut_text", "parts"))
    removed = removed.select(F.col("doc").alias(f"{doc}_"), F.col("id").alias(same), F.col("gone").alias(gone))
    keyed = df.withColumn(doc, F.xxhash64(key, text))
    whole = keyed.join(removed, (F.col(doc) == F.col(f"{doc}_")) & F.col(f"`{key}`").eqNullSafe(F.col(same)), "left")
    cut = split(whole.withColumn(cut_text, F.when(F.col(gone).isNotNull(), F.col(text))), cut_text, parts)
    left = F.array_join(F.transform(F.array_sort(F.array_except(_places(parts), gone)), lambda i: F.get(parts, i)), "\n")
    columns = {
        text: F.when(F.col(gone).isNull(), F.col(text)).otherwise(left),
        n_removed: F.coalesce(F.size(gone), F.lit(0)).cast("bigint"),
    }
    return cut.select(*[columns.pop(c, F.col(f"`{c}`")).alias(c) for c in df.columns], *[v.alias(c) for c, v in columns.items()])
