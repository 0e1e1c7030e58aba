"""Tokenisation expressions shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.split() treats as whitespace, written as a
# regex class that Java and RE2 read the same way.
PY_WHITESPACE_CLASS = (
    r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# The same characters as a plain string: every one is mapped to a space with
# ``translate`` (a character table, no regex), then the text splits on the literal space.
PY_WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def whitespace_tokens(col) -> Column:
    """Split on whitespace runs and drop empties (vocabulary tokenizer, like ``str.split()``)."""
    spaced = F.translate(_c(col), PY_WHITESPACE_CHARS, " " * len(PY_WHITESPACE_CHARS))
    return F.filter(F.split(spaced, " ", -1), lambda t: t != F.lit(""))


def single_space_tokens(col) -> Column:
    """Split on one space, keeping empty tokens (encoder tokenizer)."""
    return F.split(_c(col), " ", -1)


def token_count_single_space(col) -> Column:
    """Number of single-space tokens: spaces + 1 (an empty text counts one token)."""
    c = _c(col)
    return (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + F.lit(1)).cast("bigint")
