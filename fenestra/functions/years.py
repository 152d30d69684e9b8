"""Years and year ranges in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fenestra.functions.semantics import ladder

_START = r"(?:^|\s|\()"
_DASH = r"\s*[-–]\s*"
_STOP = r"[;\)\s]"
#: The character for a model year at place 10 of a vehicle number: letters without I, O, Q, U and Z from 2010, digits from 2001 (fixed values).
YEAR_LETTERS = "ABCDEFGHJKLMNPRSTVWXY"


def full_year(two: Column, pivot: int = 50) -> Column:
    """A two-digit year in full: below the pivot it is 20xx."""
    n = two.cast("int")
    return F.when(n < pivot, n + 2000).otherwise(n + 1900)


def year_range(x: Column) -> Column:
    """struct(year_from, year_to): the first of five forms that a text has.

    2015-2019, 90-03, 03-, 2009- and a single year, each at the start or after a
    space or parenthesis, closed ranges before a semicolon, parenthesis or space.
    """
    forms = [
        (rf"{_START}(\d{{4}}){_DASH}(\d{{4}})\s*{_STOP}", False, True),
        (rf"{_START}(\d{{2}}){_DASH}(\d{{2}})\s*{_STOP}", True, True),
        (rf"{_START}(\d{{2}}){_DASH}(?:{_STOP}|$)", True, False),
        (rf"{_START}(\d{{4}}){_DASH}(?:{_STOP}|$)", False, False),
        (rf"{_START}(19\d{{2}}|20\d{{2}})(?:\s*{_STOP}|$)", False, False),
    ]
    out = F.struct(F.lit(None).cast("int").alias("year_from"), F.lit(None).cast("int").alias("year_to"))
    for pattern, short, closed in reversed(forms):
        year = lambda g, p=pattern, s=short: full_year(F.regexp_extract(x, p, g)) if s else F.regexp_extract(x, p, g).cast("int")
        to = year(2) if closed else F.lit(None).cast("int")
        out = F.when(x.rlike(pattern), F.struct(year(1).alias("year_from"), to.alias("year_to"))).otherwise(out)
    return out


def last_year(x: Column) -> Column:
    """The last four-digit year of a text."""
    found = F.regexp_extract_all(x, F.lit(r"(?<!\d)((?:19|20)\d{2})(?!\d)"), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1).cast("int"))


def year_month(x: Column) -> Column:
    """struct(from_year, from_month, to_year, to_month) of YY/MM-YY/MM; the end may be open."""
    p = r"^\s*(\d{2})/(\d{2})\s*-\s*(?:(\d{2})/(\d{2}))?\s*$"
    part = lambda g: F.nullif(F.regexp_extract(x, p, g), F.lit(""))
    return F.struct(full_year(part(1)).alias("from_year"), part(2).cast("int").alias("from_month"), F.when(part(3).isNotNull(), full_year(part(3))).alias("to_year"), part(4).cast("int").alias("to_month"))


def zero_date_year(x: Column) -> Column:
    """The year of a date text; dates of zeros are none."""
    return F.nullif(F.regexp_extract(x, r"^(\d{4})-\d{2}", 1).try_cast("int"), F.lit(0))


def model_year(vin: Column) -> Column:
    """The model year that a vehicle number has at place 10, else null."""
    c = F.upper(F.substring(vin, 10, 1))
    letter = F.instr(F.lit(YEAR_LETTERS), c)
    return F.when(F.length(vin) < 10, F.lit(None).cast("int")).when(c.rlike("^[1-9]$"), c.cast("int") + 2000).when((letter > 0) & (c != ""), letter + 2009)


def make_of(vin: Column, prefixes: list[tuple[str, str]]) -> Column:
    """The make of the first prefix that a vehicle number has."""
    return ladder([(F.startswith(F.upper(vin), F.lit(p)), make) for p, make in prefixes])


def dimensions(x: Column) -> Column:
    """struct(width, height) of WxH in a text."""
    p = r"(\d{2,5})\s*[xX]\s*(\d{2,5})"
    side = lambda g: F.nullif(F.regexp_extract(x, p, g), F.lit("")).cast("int")
    return F.struct(side(1).alias("width"), side(2).alias("height"))


def generation_of(text: Column) -> Column:
    """T4 to T6 from a text that says T5, T-5, T 5 or MK5; null where it says none."""
    return F.concat(F.lit("T"), F.nullif(F.regexp_extract(F.upper(text), r"\b(T|MK)[- ]?([456])\b", 2), F.lit("")))
