"""Semantics that must be the same everywhere: rounding, percentiles, null-tolerant ranges, word boundaries."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def round2(x: Column) -> Column:
    """Two decimals, halves up, on the double product (not on the decimal text)."""
    return F.floor(x * 100 + 0.5) / 100


def covers(low: Column, high: Column, x: Column | int) -> Column:
    """Whether a range holds x; a null bound is open."""
    return (low.isNull() | (low <= x)) & (high.isNull() | (high >= x))


def overlap_length(a_from: Column, a_to: Column, b_from: Column, b_to: Column, *, least: int = 0, most: int = 9999) -> Column:
    """Whole units that two closed ranges share; null bounds are `least` and `most`."""
    low = F.greatest(F.coalesce(a_from, F.lit(least)), F.coalesce(b_from, F.lit(least)))
    high = F.least(F.coalesce(a_to, F.lit(most)), F.coalesce(b_to, F.lit(most)))
    return F.greatest(F.lit(0), high - low + 1)


def within(low: Column, high: Column, x: Column | int, tolerance: int = 1) -> Column:
    """`covers` with some tolerance at either end."""
    return covers(low - tolerance, high + tolerance, x)


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def int_prefix(x: Column) -> Column:
    """The integer at the start of a string, else null."""
    return F.nullif(F.regexp_extract(x, r"^\s*([+-]?\d+)", 1), F.lit("")).cast("bigint")


def whole_word(words: str) -> str:
    """A pattern for an alternation of words between ASCII word boundaries (letters beyond ASCII end a word)."""
    return rf"(?<![A-Za-z0-9_])(?:{words})(?![A-Za-z0-9_])"


def percentile_at(x: Column, p: float) -> Column:
    """The element at floor(n * p) of the sorted values: an aggregate."""
    values = F.sort_array(F.collect_list(x))
    return F.element_at(values, F.least(F.size(values), F.floor(F.size(values) * p).cast("int") + 1))


def all_of(conditions: list[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def bucket(x: Column, size: int) -> Column:
    """The lower end of the bucket of `size` that holds x."""
    return (F.floor(x / size) * size).cast("bigint")


def ladder(steps: list[tuple[Column, object]], default: object = None) -> Column:
    """The value of the first condition that holds."""
    out = F.lit(default)
    for condition, value in reversed(steps):
        out = F.when(condition, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def centrality(low: Column, high: Column, x: Column) -> Column:
    """1 in the middle of a closed range, falling to 0 half a range away; 1 for a range without length."""
    half = (high - low + 1) / 2
    return F.lit(1.0) - F.when(half > 0, F.least(F.lit(1.0), F.abs(x - (low + high) / 2) / half)).otherwise(F.lit(0.0))
