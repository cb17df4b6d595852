"""Column helpers shared by all operators. JVM expressions only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..config import WHITESPACE


def text(col: Column | str) -> Column:
    """A column from a name or a column."""
    return F.col(col) if isinstance(col, str) else col


def folded(col: Column | str) -> Column:
    """Trimmed of all white space and lower-cased, for label comparison."""
    return F.lower(F.btrim(text(col), F.lit(WHITESPACE)))


def filled(col: Column | str) -> Column:
    """Null where the text is blank: an empty text counts as absent."""
    c = text(col)
    return F.when(c != "", c)


def is_true(cond: Column) -> Column:
    """Null counts as false."""
    return F.coalesce(cond, F.lit(False))


def has_any(col: Column, words) -> Column:
    """True if any of the words occurs in the text."""
    hit = F.lit(False)
    for word in words:
        hit = hit | col.contains(word)
    return is_true(hit)


def half_up(col: Column, digits: int) -> Column:
    """Round by ``floor(x * 10^d + 0.5) / 10^d``: plain double arithmetic that
    gives the same bits in every engine."""
    scale = F.lit(float(10 ** digits))
    return F.floor(col * scale + F.lit(0.5)) / scale


def short_digest(col: Column) -> Column:
    """First eight hex digits of the SHA-1, upper case."""
    return F.upper(F.substring(F.sha1(col), 1, 8))
