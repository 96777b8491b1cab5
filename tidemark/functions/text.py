"""Native string expressions shared by the operators.

Python's ``str.split()`` and ``\\w`` are Unicode-aware while Java's ``\\s`` and
``\\w`` are ASCII by default, so the patterns below spell the classes out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns whose meaning must equal the reference's behaviour.
FOUR_DIGITS = "[0-9]{4}"  # any four ASCII digits, non-overlapping, left to right
TERM_PATTERN = r"[\p{L}\p{N}_]{2,}"  # default bag-of-words token: 2+ word characters
UNICODE_SPACE = r"[\s\p{Z}\x{1C}-\x{1F}\x{85}]+"  # what Python's str.split() splits on
ASCII_PUNCT_CLASS = r"[!-/:-@\[-`{-~]"  # string.punctuation
NOT_ALNUM_SPACE = r"[^\p{L}\p{N}\s\x{0B}\p{Z}\x{1C}-\x{1F}\x{85}]"  # characters removed by the alnum-only cleaner


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def four_digit_runs(text: Column | str) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(FOUR_DIGITS), 0)


def max_int(strings: Column) -> Column:
    """Largest integer value of an array of digit strings (null when empty)."""
    return F.array_max(F.transform(strings, lambda s: s.cast("int")))


def tokens(text: Column | str) -> Column:
    """Whitespace tokens with empty pieces dropped (Python ``str.split()``)."""
    return F.filter(F.split(_c(text), UNICODE_SPACE), lambda t: t != "")


def terms(text: Column | str) -> Column:
    """Lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(TERM_PATTERN), 0)


def has_ascii_punct(tok: Column) -> Column:
    return tok.rlike(ASCII_PUNCT_CLASS)


def alnum_clean(text: Column | str) -> Column:
    """Keep letters, digits and whitespace only."""
    return F.regexp_replace(_c(text), NOT_ALNUM_SPACE, "")
