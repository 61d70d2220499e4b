"""Quality rules: counts per text, and divergence from what texts of a language look like.

Two histograms of a text are compared with those of each reference language by Jensen-Shannon
distance (0 to 1): character classes, and the language's most common words. A text is kept if it is
close enough to at least one reference. References are sums over all rows of the language; texts that
are too short for a histogram are not judged by it. DataFrame operations only.

Null and empty texts have no words, so they fail the base rule. Without a reference (no row of a known
language) only the base rule decides. Rows may repeat, and are judged alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import compute_once
from ..storage import cut_lineage

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Shortest texts that the histograms judge.
MIN_CHARS, MIN_COMMON = 200, 100
#: Largest distances to the nearest reference. Few words scatter more: theirs may be larger by
#: WORD_NOISE / sqrt(number of words).
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE, WORD_NOISE = 0.29, 0.14, 1.7
# Frequent function words, most frequent first (fixed values).
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "en": "the of and to in a is that it for as was with be by on not are this from",
    "es": "de la que el en y a los se del las un por con no una su para es al",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas sur",
}
#: In order of rank, so that places are found early.
WORDS = list(dict.fromkeys(w for rank in zip(*(words.split() for words in COMMON_WORDS.values())) for w in rank))
FIRST_MARK = 0x2460  # one character for each word: its place in WORDS


def _marks() -> list[str]:
    return [chr(FIRST_MARK + i) for i in range(len(WORDS))]


def base_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the whole text.

    The text is replaced by its histograms ``chars`` and ``common``. Words that occur in repeated
    windows are found by sorting (hash of the window, place); windows whose hashes meet are compared
    word by word, so the count is exact.
    """
    spaces, plain = F.lit(SPACES), F.coalesce(text, F.lit(""))
    df = compute_once(df, "lines_", F.filter(F.split(plain, "\n"), lambda line: F.btrim(line, spaces) != ""))
    letters = F.split(F.lower(plain), r"[^\p{L}]+")
    place = F.transform(
        F.filter(letters, lambda w: w.isin(WORDS)),
        lambda w: F.substr(F.lit("".join(_marks())), F.array_position(F.array(*map(F.lit, WORDS)), w).cast("int"), F.lit(1)),
    )
    df = compute_once(df, "places_", F.array_join(place, ""))
    df = compute_once(df, "rest_", F.regexp_replace(plain, r"\p{L}+", ""))
    trimmed = F.btrim(plain, spaces)
    df = compute_once(df, "words_", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")))

    letter_words = F.size(F.filter(letters, lambda w: w != ""))
    n_chars, word_chars = F.length(plain), F.length(F.array_join("words_", ""))
    upper, other = F.regexp_count(plain, F.lit(r"\p{Lu}")), F.length("rest_")
    digits, points, symbols = (F.regexp_count("rest_", F.lit(kind)) for kind in (r"\p{N}", r"[.,;:!?'\"()\-]", SYMBOLS))
    blank = n_chars - word_chars
    counted = df.withColumns(
        {
            "n_words": F.size("words_").cast("bigint"),
            "word_chars": word_chars.cast("bigint"),
            "n_symbols": symbols.cast("bigint"),
            "n_dup_lines": (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("bigint"),
            "found_": F.array(n_chars, upper, other, digits, points, blank),
            "letter_words_": letter_words,
        }
    ).drop(text, "lines_", "rest_")

    word = lambda i: F.col("words_")[i]
    windows = F.when(F.size("words_") > 2, F.sequence(F.lit(0), F.size("words_") - 3)).otherwise(F.array().cast("array<int>"))
    packed = F.transform(windows, lambda i: F.shiftleft(F.hash(word(i), word(i + 1), word(i + 2)).cast("bigint"), 31).bitwiseOR(i.cast("bigint")))
    sorted_ = compute_once(counted, "packed_", F.sort_array(packed))
    ends = F.filter(F.sequence(F.lit(0), F.greatest(F.size("packed_") - 2, F.lit(0))), lambda k: F.shiftrightunsigned(F.get("packed_", k).bitwiseXOR(F.get("packed_", k + 1)), 31) == 0)
    meets = F.array_distinct(F.flatten(F.transform(ends, lambda k: F.array(F.get("packed_", k), F.get("packed_", k + 1)))))
    at = F.transform(meets, lambda x: x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))
    same = F.array_sort(F.transform(at, lambda i: F.struct(F.array(word(i), word(i + 1), word(i + 2)).alias("window"), i.alias("at"))))
    compared = compute_once(sorted_, "same_", same).drop("packed_")
    last, window = F.size("same_") - 1, lambda k: F.get("same_", k)["window"]
    again = F.filter("same_", lambda x, k: ((k > 0) & (window(k - 1) == x["window"])) | ((k < last) & (window(k + 1) == x["window"])))
    repeated = F.sort_array(F.transform(again, lambda x: x["at"]))
    places = compute_once(compared, "repeated_", repeated).drop("same_", "words_")
    covered = F.transform("repeated_", lambda at, k: F.when(k == F.size("repeated_") - 1, 3).otherwise(F.least(F.lit(3), F.get("repeated_", k + 1) - at)))
    n_repeat = F.aggregate(covered, F.lit(0), lambda total, x: total + x)

    f = F.col("found_")
    letters_low = f[0] - f[2] - f[1]
    return (
        places.withColumn("n_repeat_words", n_repeat.cast("bigint"))
        .withColumn("chars", F.array(letters_low, f[1], f[3], f[4], f[5], F.col("n_symbols").cast("int"), f[2] - f[3] - f[4] - f[5] - F.col("n_symbols").cast("int")))
        .withColumn("common", F.transform(F.array(*map(F.lit, _marks())), lambda m: F.length("places_") - F.length(F.replace("places_", m, F.lit("")))))
        .withColumn("common", F.concat("common", F.array(F.col("letter_words_") - F.length("places_"))))
        .drop("found_", "places_", "repeated_", "letter_words_")
    )


def references(counted: DataFrame, lang: str = "lang") -> DataFrame:
    """One row per known language: summed histograms. At most as many rows as COMMON_WORDS has keys."""
    sums = [
        F.array(*[F.sum(F.col(c)[i]).cast("double") for i in range(n)]).alias(c)
        for c, n in (("chars", 7), ("common", len(WORDS) + 1))
    ]
    return counted.filter(F.col(lang).isin(list(COMMON_WORDS))).groupBy(lang).agg(*sums)


def _with_shares(df: DataFrame, column: str, enough: str, least: int) -> DataFrame:
    """Replace counts by shares, and add their sum if it is at least ``least``."""
    total = F.aggregate(column, F.lit(0.0), lambda a, x: a + x)
    df = compute_once(df, "total_", total)  # else it is summed again for every element
    shares = F.transform(column, lambda x: x / F.greatest("total_", F.lit(1.0)))
    return compute_once(df.withColumn(enough, F.when(F.col("total_") >= least, F.col("total_"))), column, shares).drop("total_")


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two share arrays, to base 2."""
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    parts = F.zip_with(p, q, lambda a, b: (term(a, (a + b) / 2) + term(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda total, x: total + x), F.lit(0.0)))


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, the counts, base_failed, char_distance, word_distance (null: not judged) and kept."""
    counted = cut_lineage(base_counts(df.select(key, lang, text), text))
    doubles = {c: F.transform(c, lambda x: x.cast("double")) for c in ("chars", "common")}
    shared = lambda df: _with_shares(_with_shares(df, "chars", "enough_chars", MIN_CHARS), "common", "enough_words", MIN_COMMON)
    known = shared(references(counted, lang)).select(F.struct("chars", "common").alias("r"))
    one = known.agg(F.collect_list("r").alias("references"))  # a row of at most len(COMMON_WORDS) histograms
    numbers = counted.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *[v.alias(c) for c, v in doubles.items()])
    sized = shared(numbers).withColumn("references", one.scalar())
    nearest = lambda c: F.array_min(F.transform("references", lambda r: distance(F.col(c), r[c])))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    measured = sized.withColumns(
        {
            "base_failed": failed,
            "char_distance": F.when(F.col("enough_chars").isNotNull(), nearest("chars")),
            "word_distance": F.when(F.col("enough_words").isNotNull(), nearest("common")),
        }
    )
    limits = [("char_distance", F.lit(MAX_CHAR_DISTANCE)), ("word_distance", MAX_WORD_DISTANCE + WORD_NOISE / F.sqrt("enough_words"))]
    fits = reduce(lambda a, b: a & b, [F.coalesce(F.col(c) <= limit, F.lit(True)) for c, limit in limits])
    return measured.withColumn("kept", ~F.col("base_failed") & fits).select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance"
    )
