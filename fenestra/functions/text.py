"""Columns that clean, split, classify and label text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fenestra.functions.semantics import ladder, whole_word

# Identifiers as the data has them.
REGISTRATION = r"^[A-Z]{2}\d{4,5}$"
VIN = r"^[A-HJ-NPR-Z0-9]{17}$"
PART_CODE = r"^(\d{3,4}[A-Z]{1,2}\d{1,4}[A-Z]?|[A-Z]{2}\d{4,6})$"
OEM = r"^[A-Z0-9]{5,20}$"
SKU = r"^[A-Z0-9\-]{4,30}$"


def compact_upper(x: Column, separators: str = r"[\s.-]+") -> Column:
    return F.regexp_replace(F.upper(F.trim(x)), separators, "")


def input_type(raw: Column) -> Column:
    """struct(type, normalized, confidence): registration, vin, part code, oem, sku or text.

    With separators inside, only registrations and vins are recognised once they
    are gone, then skus with hyphens; anything with white space is text.
    """
    text = F.trim(raw)
    upper, compact = F.upper(text), compact_upper(raw)
    apart, spaced = text.rlike(r"[\s.-]"), text.rlike(r"\s")
    kind = ladder(
        [
            (F.length(text) == 0, "text"),
            (compact.rlike(REGISTRATION), "regnr"),
            (compact.rlike(VIN), "vin"),
            (spaced, "text"),
            (apart & upper.rlike(SKU), "sku"),
            (apart, "text"),
            (upper.rlike(PART_CODE), "eurocode"),
            (upper.rlike(OEM), "oem"),
            (upper.rlike(SKU), "sku"),
        ],
        "text",
    )
    normal = F.when(kind.isin("regnr", "vin"), compact).when(kind == "text", text).otherwise(upper)
    sure = F.when(kind.isin("regnr", "vin", "eurocode"), 1.0).when(kind == "text", 0.5).otherwise(0.8)
    return F.struct(kind.alias("type"), normal.alias("normalized"), sure.alias("confidence"))


def prefix4(code: Column) -> Column:
    """The first four characters in upper case; null if there are fewer."""
    head = F.upper(F.substring(F.trim(code), 1, 4))
    return F.when(F.length(head) == 4, head)


def plain_upper(x: Column) -> Column:
    """Upper case, punctuation to spaces, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(x), r"[^A-Z0-9 ]", " "), r"\s+", " "))


def tokens(x: Column, least: int = 2) -> Column:
    """Distinct lower-case words of at least `least` characters, and single digits."""
    return F.array_distinct(F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda t: (F.length(t) >= least) | t.rlike(r"^\d$")))


def tokens_without(x: Column, stop: list[str], least: int = 2) -> Column:
    return F.array_except(tokens(x, least), F.array(*map(F.lit, stop)).cast("array<string>"))


def without_numbers(x: Column) -> Column:
    """Words with a number of two digits or more, and perhaps a letter, at the end lose them."""
    return F.regexp_replace(x, r"^(\D+)\d{2,}[A-Z]?$", "$1")


def family_key(x: Column, drop: list[str]) -> Column:
    """Lower case without parentheses, engine-like tokens (1.6, 16v, 2tdi) and the words in `drop`."""
    bare = F.regexp_replace(F.lower(x), r"\([^)]*\)", " ")
    kept = F.filter(F.split(F.trim(F.regexp_replace(bare, r"[^a-z0-9.]+", " ")), " +"), lambda t: ~t.rlike(r"^\d+\.\d+$|^\d+v$|^\d*[a-z]{0,2}(tdi|tsi|hdi|cdi)$") & ~t.isin(*drop) & (t != ""))
    return F.array_join(kept, " ")


def entity_decoded(x: Column) -> Column:
    """Named and numeric HTML entities that product texts hold, also without their semicolon."""
    for name, char in (("nbsp", " "), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("#0?39", "'"), ("amp", "&")):
        x = F.regexp_replace(x, f"&{name};?", char)
    return x


def adjacent_once(words: Column) -> Column:
    """An array without elements that equal the one before."""
    before = F.concat(F.array(F.lit(None).cast("string")), words)
    pairs = F.arrays_zip(words.alias("word"), before.alias("before"))
    return F.transform(F.filter(pairs, lambda p: p["word"].isNotNull() & ~p["word"].eqNullSafe(p["before"])), lambda p: p["word"])


def spellings(raw: Column) -> Column:
    """Spelling variants of a hint: as is, compact, with spaces, with hyphens, letters and digits apart."""
    low = F.lower(F.trim(raw))
    return F.array_distinct(F.array(low, F.regexp_replace(low, r"[\s-]+", ""), F.regexp_replace(low, "-", " "), F.regexp_replace(low, r"\s+", "-"), F.regexp_replace(low, r"([a-z])(\d)", "$1 $2")))


def first_code(x: Column, codes: dict[str, str]) -> Column:
    """The label of the longest code that a string holds, of equal lengths the first in order."""
    order = sorted(codes, key=lambda c: -len(c))
    return ladder([(F.contains(F.upper(x), F.lit(c)), codes[c]) for c in order])


def all_codes(x: Column, groups: list[dict[str, str]]) -> Column:
    """Labels of all codes in a string: by group, longest first, each at its first free place.

    Places that a code has taken are blanked, so later codes can't overlap them.
    """
    state = F.struct(F.upper(x).alias("rest"), F.array().cast("array<string>").alias("found"))
    for codes in groups:
        order = sorted(codes, key=lambda c: -len(c))
        pairs = F.array(*(F.struct(F.lit(c).alias("code"), F.lit(codes[c]).alias("label")) for c in order))
        state = F.aggregate(
            pairs, state,
            lambda s, c: F.when(
                F.contains(s["rest"], c["code"]),
                F.struct(
                    F.overlay(s["rest"], F.repeat(F.lit("\x01"), F.length(c["code"])), F.instr(s["rest"], c["code"])).alias("rest"),
                    F.concat(s["found"], F.array(c["label"])).alias("found"),
                ),
            ).otherwise(s),
        )
    return state["found"]


def composite_key(*parts: Column, missing: str = "*") -> Column:
    return F.concat_ws("|", *(F.coalesce(F.nullif(F.trim(p.cast("string")), F.lit("")), F.lit(missing)) for p in parts))


def hashed(x: Column) -> Column:
    """SHA-256 of an identifier, trimmed and in upper case."""
    return F.sha2(F.upper(F.trim(x)), 256)


def first_keyword(x: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first rule (pattern of whole words, label) that a text meets."""
    return ladder([(F.upper(x).rlike(whole_word(p)), label) for p, label in rules], default)


def best_rule(x: Column, rules: list[tuple[str, float, str]], default: str) -> Column:
    """The label of the matching rule (pattern, confidence, label) with most confidence, first of equals."""
    hits = [F.when(x.rlike(p), F.struct(F.lit(c).alias("confidence"), F.lit(-i).alias("order"), F.lit(label).alias("label"))) for i, (p, c, label) in enumerate(rules)]
    return F.coalesce(F.array_max(F.array_compact(F.array(*hits)))["label"], F.lit(default))


def chassis_codes(x: Column) -> Column:
    """Codes of three shapes (A12, 1AB, AB1), upper case, distinct, in order of shape."""
    up = F.upper(x)
    return F.array_distinct(F.concat(*(F.regexp_extract_all(up, F.lit(rf"(?<![A-Z0-9])({p})(?![A-Z0-9])"), F.lit(1)) for p in (r"[A-Z]\d{2,3}", r"\d[A-Z]{1,2}", r"[A-Z]{2}\d"))))


def day_label(day: Column, today: Column) -> Column:
    """How long ago a day was."""
    n = F.datediff(today, day)
    return F.when(n <= 0, F.lit("today")).when(n == 1, F.lit("yesterday")).when(n < 7, F.concat(n.cast("string"), F.lit(" days ago"))).when(n < 31, F.concat(F.floor(n / 7).cast("string"), F.lit(" weeks ago"))).otherwise(F.concat(F.floor(n / 30).cast("string"), F.lit(" months ago")))


def vehicle_text(x: Column, brands: dict[str, str]) -> Column:
    """struct(brand, model, year) of free text: a leading known brand (longest first), a trailing year, the rest."""
    raw = F.trim(F.regexp_replace(x, r"\s+", " "))
    order = sorted(brands, key=lambda b: (-len(b), b))
    hit = F.regexp_extract(F.upper(raw), "^(" + "|".join(order) + r")(?= |$)", 1)
    named = ladder([(hit == b, brands[b]) for b in order], None)
    first = F.upper(F.split(raw, " ")[0])
    rest = F.trim(F.when(hit != "", raw.substr(F.length(hit) + 1, F.length(raw))).otherwise(raw.substr(F.length(first) + 1, F.length(raw))))
    year = F.nullif(F.regexp_extract(rest, r"(?:^| )((?:19|20)\d{2})$", 1), F.lit("")).cast("int")
    model = F.trim(F.regexp_replace(rest, r"(?:^| )(?:19|20)\d{2}$", ""))
    return F.struct(F.coalesce(named, first).alias("brand"), model.alias("model"), year.alias("year"))
