"""Column functions that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, not at every use inside f."""
    return F.transform(F.array(value), f)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), "")


def token_estimate(text: Column) -> Column:
    """max(1, int(words * 1.3))."""
    return F.greatest(F.lit(1), F.floor(F.size(words(text)) * 1.3)).cast("int")


def sentences(text: Column) -> Column:
    """Paragraphs at blank lines, then ends of sentences before a capital, dash, digit, quote or bracket; empty ones go."""
    cut = F.transform(F.split(F.coalesce(text, F.lit("")), r"\n{2,}"), lambda p: F.split(p, r'(?<=[.!?])\s+(?=[A-Z\-0-9"(])'))
    return F.filter(F.transform(F.flatten(cut), lambda s: F.trim(s)), lambda s: s != "")


def clean_null(text: Column) -> Column:
    """'' for texts that stand for nothing."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.lower(t).isin("nan", "none", "null", ""), "").otherwise(t)


def safe_float(text: Column) -> Column:
    """The number in a text without comparison signs, else null."""
    t = F.trim(F.translate(text, "≤≥<>", ""))
    return F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t).try_cast("double")


def any_of(text: Column, parts: list[str]) -> Column:
    """Whether a text holds one of some strings."""
    found = F.lit(False)
    for p in parts:
        found = found | text.contains(p)
    return F.coalesce(found, F.lit(False))


def key16(*parts: Column) -> Column:
    """The first 16 hex digits of the MD5 of the parts joined by ||."""
    return F.substring(F.md5(F.concat_ws("||", *parts)), 1, 16)


def months_between_dates(first: Column, last: Column) -> Column:
    """max(0.2, days / 30.4375), null under 14 days."""
    days = F.datediff(last, first)
    return F.when(days >= 14, F.greatest(F.lit(0.2), days / 30.4375))
