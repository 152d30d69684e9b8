"""Similarities of token sets and strings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from fenestra.functions.semantics import ladder
from fenestra.functions.text import tokens

# What tells the models of a make apart.
#: Makes, names of one family, and the pattern of its generation.
GENERATION_OF = [(["volkswagen", "vw"], ["transporter", "multivan", "caravelle", "california"], r"\b(t[456])\b")]
#: Makes and a pattern of a series; what its groups hold must be the same.
SERIES = [
    (["volvo"], r"^(xc|s|v|c)\s?(\d+)$"),
    (["jaguar"], r"^([a-z])\s*-?\s*pace$"),
    (["mazda"], r"^(cx|mx)\s*-?\s*(\d+)$"),
    (["bmw"], r"^(x|m|z)\s*(\d+)$"),
    (["bmw"], r"^(\d+)\s*-?\s*serie$"),
    (["audi"], r"^(a|q|tt)\s*(\d+)$"),
    (["mercedes"], r"^([a-e])\s*-?\s*klasse$"),
]
#: Makes that a longer name of theirs stands for, too (Mercedes-AMG); of all others the name must be the same.
LONGER_NAMES = ["volkswagen", "mercedes"]
#: Classes of Mercedes and their chassis codes; the first class that a name holds counts.
CLASS_CODES = {
    "a-klasse": ["w168", "w169", "w176", "w177"], "a-class": ["w168", "w169", "w176", "w177"], "b-klasse": ["w245", "w246", "w247"], "b-class": ["w245", "w246", "w247"],
    "c-klasse": ["w203", "w204", "w205", "w206"], "c-class": ["w203", "w204", "w205", "w206"], "e-klasse": ["w210", "w211", "w212", "w213", "w214"], "e-class": ["w210", "w211", "w212", "w213", "w214"],
    "s-klasse": ["w220", "w221", "w222", "w223"], "s-class": ["w220", "w221", "w222", "w223"], "m-klasse": ["w163", "w164", "w166"], "m-class": ["w163", "w164", "w166"],
    "gle-klasse": ["w166", "w167"], "gle-class": ["w166", "w167"], "gle": ["w166", "w167"], "glc": ["x253", "c253", "x254", "c254"], "glb": ["x247"], "gla": ["x156", "h247"], "cla": ["c117", "c118"],
    "slk": ["r170", "r171", "r172", "w170"], "sl": ["r129", "r230", "r231", "w230"], "clk": ["c208", "c209", "w208", "w209"], "cls": ["c218", "c219", "c257", "w219"], "g-klasse": ["w463", "w464"], "g-class": ["w463", "w464"],
}
#: Words of body styles, series and panes, which many models share.
GENERAL_WORDS = [
    "serie", "series", "klasse", "class", "pace", "cross", "sport", "sports", "sportback", "coupe", "cabriolet", "convertible", "roadster", "sedan", "saloon", "hatchback", "wagon", "estate", "touring", "mpv", "suv", "van", "pickup",
    "backlite", "frontrute", "bakrute", "dorrute", "siderute", "dørrute",
]


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def overlap_of_larger(a: Column, b: Column) -> Column:
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most > 0, F.size(F.array_intersect(a, b)) / most).otherwise(F.lit(0.0))


def token_score(a: Column, b: Column) -> Column:
    """Share of `a` found in `b` if `a` has up to two tokens, else the overlap with the larger."""
    small = F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1))
    return F.when(F.size(a) <= 2, small).otherwise(overlap_of_larger(a, b))


def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro similarity with a prefix bonus of 0.1 a character, up to four, whatever the similarity."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, left = [False] * len(b), []
    for i, x in enumerate(a):
        at = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if not taken[j] and b[j] == x), None)
        if at is not None:
            taken[at] = True
            left.append(x)
    if not left:
        return 0.0
    right = [y for y, t in zip(b, taken, strict=True) if t]
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    m = len(left)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    same = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + same * 0.1 * (1 - jaro)


def jaro_winkler(a: Column, b: Column) -> Column:
    """Null if either is null. A pandas UDF, made when a session is there."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) or pd.isna(y) else jaro_winkler_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(a, b)


def fuzzy_score(a: Column, b: Column) -> Column:
    """1 if either holds the other, else 0.6 of the token overlap and 0.4 of Jaro-Winkler."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return F.when(F.contains(x, y) | F.contains(y, x), F.lit(1.0)).otherwise(overlap_of_larger(tokens(x), tokens(y)) * 0.6 + jaro_winkler(x, y) * 0.4)


def _first_in(m: Column, names: list[str]) -> Column:
    """The first of `names` that a string holds."""
    return ladder([(F.contains(m, F.lit(x)), x) for x in names], None)


def _codes(m: Column) -> Column:
    """Chassis codes of a model name, without a letter behind."""
    return F.regexp_extract_all(m, F.lit(r"\b([wxcr]\d{3})[a-z]?\b"), F.lit(1))


def _held_safely(a: Column, b: Column) -> Column:
    """Whether one of two names holds the other, and not as a number that goes on: A3 is not in A30."""
    small, large = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    behind = F.substr(large, F.instr(large, small) + F.length(small), F.lit(1))
    return F.contains(large, small) & ~(small.rlike(r"\d$") & behind.rlike(r"^\d"))


def _of_make(who: Column, makes: list[str]) -> Column:
    named = who.isin(makes)
    for make in makes:
        if make in LONGER_NAMES:
            named = named | F.contains(who, F.lit(make))
    return named


def model_equivalent(vehicle: Column, record: Column, make: Column) -> Column:
    """Whether two model names mean the same model of a make; false where either is null or empty.

    The make in front goes. Rules are tried in order, and the first that can tell
    decides: one name holds the other; the names share a family and differ in
    generation (`GENERATION_OF`); both are of one series of the make (`SERIES`), by what tells
    its members apart; class and chassis code (`CLASS_CODES`). The rest is decided by
    what is left without separators, and then by common words, of which general
    ones (`GENERAL_WORDS`) don't tell.
    """
    who = F.lower(F.trim(make))
    bare = lambda m: F.when(F.startswith(m, F.concat(who, F.lit(" "))), F.trim(F.substr(m, F.length(who) + 1))).otherwise(m)
    a, b = bare(F.lower(F.trim(vehicle))), bare(F.lower(F.trim(record)))
    rules: list[tuple[Column, Column]] = [(F.coalesce(F.length(a) * F.length(b), F.lit(0)) == 0, F.lit(False)), (_held_safely(a, b), F.lit(True))]
    for makes, names, generation in GENERATION_OF:
        known = _of_make(who, makes) & a.rlike("|".join(names)) & b.rlike("|".join(names))
        x, y = (F.regexp_extract(m, generation, 1) for m in (a, b))
        rules.append((known, (x == "") | (y == "") | (x == y)))
    for makes, pattern in SERIES:
        key = lambda m, p=pattern: F.concat_ws(" ", *(F.regexp_extract(m, p, i + 1) for i in range(p.count("(") - p.count("(?"))))
        rules.append((_of_make(who, makes) & a.rlike(pattern) & b.rlike(pattern), key(a) == key(b)))
    # 740_760-80 stands for 740, 760 and 780
    rules.append(((who == "volvo") & a.rlike(r"^\d{3}$") & F.contains(b, F.substring(a, 2, 2)) & F.contains(b, F.substring(a, 1, 1)), F.lit(True)))
    classes = list(CLASS_CODES)
    x, y = _first_in(a, classes), _first_in(b, classes)
    allowed = F.create_map(*(F.lit(v) if isinstance(v, str) else F.array(*map(F.lit, v)) for kv in CLASS_CODES.items() for v in kv))
    fits = lambda c, codes: F.coalesce(F.arrays_overlap(F.try_element_at(allowed, c), codes), F.lit(False))
    off_road = lambda m: m.rlike("g-klasse|gelandewagen")
    rules.append((F.contains(who, F.lit("mercedes")) & (F.coalesce(x == y, F.lit(False)) | (off_road(a) & off_road(b)) | fits(x, _codes(b)) | fits(y, _codes(a))), F.lit(True)))
    plain_a, plain_b = F.regexp_replace(a, "[^a-z0-9]", ""), F.regexp_replace(b, "[^a-z0-9]", "")
    short, long = F.least(F.length(plain_a), F.length(plain_b)), F.greatest(F.length(plain_a), F.length(plain_b))
    held = (short >= 3) & (F.contains(plain_a, plain_b) | F.contains(plain_b, plain_a)) & ((short >= 4) | (short >= long * 0.8))
    rules.append((held, F.lit(True)))
    words = lambda m: F.filter(F.split(m, "[^a-z0-9]+"), lambda t: F.length(t) >= 2)
    common = F.filter(words(b), lambda t: F.array_contains(words(a), t))
    only = F.coalesce(F.get(common, 0), F.lit(""))
    # without its last occurrence
    alone = lambda m: F.regexp_replace(F.regexp_replace(m, F.concat(F.lit("^(.*)"), only), F.lit("$1")), "[^a-z0-9]", "") == ""
    telling = (F.length(only) >= 4) & (~only.isin(GENERAL_WORDS) | alone(a) | alone(b)) | (F.length(only) == 3) & (F.size(words(b)) == 1)
    rules.append((F.size(common) >= 2, F.lit(True)))
    rules.append((F.size(common) == 1, telling))
    return ladder(rules, False)


def level(score: Column, steps: list[tuple[float, str]], default: str) -> Column:
    """The name of the first step whose least score is reached."""
    return ladder([(score >= least, name) for least, name in steps], default)


def completeness(fields: list[tuple[Column, int]]) -> Column:
    """The weight of the fields that are there, as a share of all weights."""
    found = sum((F.when(c.isNotNull(), w).otherwise(0) for c, w in fields), F.lit(0))
    return found / sum(w for _, w in fields)
