"""String expressions shared by all operators. Everything here is a built-in JVM expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() and str.split() treat as white space.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
WHITESPACE_CLASS = (
    r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

# Default tokeniser: special markers, runs of letters and digits, single other characters.
TOKEN_PATTERN = r"<\|[a-z_]+\|>|[\p{L}\p{N}]+|[^\p{L}\p{N}\x09-\x0d\x20]"
SPECIAL_TOKEN = r"^<\|[a-z_]+\|>$"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def right_strip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def drop_bad_bytes(text: Column) -> Column:
    """Leave out bytes that are no UTF-8, as a decoder that ignores errors does.

    Text files are scanned without a check, so such bytes sit in the strings. A replacement
    character that was in the file itself goes only if its line has bad bytes, too.
    """
    cleaned = F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit(""))
    return F.when(F.is_valid_utf8(text), text).otherwise(cleaned)


def collapse(text: Column) -> Column:
    """Every run of white space becomes one space and the ends are stripped."""
    return F.array_join(words(text), " ")


@dataclass(frozen=True)
class Tokenizer:
    """Tokens are the matches of a pattern; nothing else of a text belongs to one.

    ``additive``: in a rendered conversation no token spans the border of two segments, so counts
    of segments may be added up. Without it, whole texts are read and tokens are placed by offset.
    """

    pattern: str
    additive: bool = False

    def tokens(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(f"({self.pattern})"), F.lit(1))

    def count(self, text: Column) -> Column:
        return F.size(self.tokens(text)).cast("long")

    def gaps(self, text: Column) -> Column:
        """What stands before, between and after the tokens: one more than there are tokens."""
        return F.split(text, self.pattern, -1)


DEFAULT_TOKENIZER = Tokenizer(TOKEN_PATTERN, additive=True)
WORD_TOKENIZER = Tokenizer(f"[^{WHITESPACE_CLASS}]+")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def count_tokens(text: Column) -> Column:
    return F.size(tokens(text)).cast("long")


def words(text: Column) -> Column:
    """White-space tokens. Mapping all white space to spaces first is faster than one wide pattern."""
    spaced = F.translate(text, WHITESPACE, " " * len(WHITESPACE))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def fill(template: str, placeholder: str, value: Column) -> Column:
    """Put a column into a template by plain concatenation, so no character of it is special."""
    parts = template.split("{" + placeholder + "}")
    pieces: list[Column] = [F.lit(parts[0])]
    for part in parts[1:]:
        pieces += [value, F.lit(part)]
    return F.concat(*pieces)
