"""Column functions for delivered text: trimming, terms, null-safe values. All of them run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t"


def trimmed(c: Column) -> Column:
    """Without leading and trailing blanks (spaces, tabs); null stays null."""
    return F.trim(c, F.lit(BLANKS))


def folded(c: Column) -> Column:
    """Trimmed and lower-cased."""
    return F.lower(trimmed(c))


def value_or_blank(c: Column) -> Column:
    """Trimmed; null and blank agree as the empty string."""
    return F.coalesce(trimmed(c), F.lit(""))


def terms(tokens: Column) -> Column:
    """The terms of a token array in order: folded, without null and blank ones; a null array has none."""
    return F.coalesce(F.filter(F.transform(tokens, folded), lambda t: t.isNotNull() & (t != "")), F.array().cast("array<string>"))


def term_set(tokens: Column) -> Column:
    """The distinct terms of a token array."""
    return F.array_distinct(terms(tokens))
