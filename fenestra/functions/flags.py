"""Flags in free text, with negation, and questions about them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that negate what follows within WINDOW tokens, or what they follow at once (fixed values).
NEGATIONS = ["IKKE", "NOT", "NO", "NB", "WITHOUT", "UTEN", "INGEN", "NEI"]
WINDOW = 3
SEPARATORS = r"[\s;,.\[\]()+-]+"


def flag_tokens(text: Column) -> Column:
    return F.filter(F.split(F.upper(text), SEPARATORS), lambda t: t != "")


def up_to(text: Column, word: str) -> Column:
    """The text up to the first token `word`, in either case, with the token after it; empty if there is none. Tokens are runs of ASCII letters and digits."""
    first, *rest = (f"[{c.lower()}{c.upper()}]" for c in word)
    return F.regexp_extract(text, rf"(?s)^.*?{first}(?<![A-Za-z0-9].){''.join(rest)}(?![A-Za-z0-9])[^A-Za-z0-9]*[A-Za-z0-9]*", 0)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once, however often it is named; plain columns would be computed at every place."""
    return F.transform(F.array(value), use)[0]


def mentioned(tokens: Column, words: list[str], *, negations: list[str] = NEGATIONS, window: int = WINDOW) -> Column:
    """Null if none of the words occurs, else whether one occurs, at its first place, without negation.

    Negation is a negating word among the `window` tokens before, or the next one.
    """
    no = F.array(*map(F.lit, negations))

    def near(t: Column, at: Column) -> Column:
        before = F.slice(t, F.greatest(F.lit(1), at - window).cast("int"), F.greatest(F.lit(0), F.least(F.lit(window), at - 1)).cast("int"))
        after = F.slice(t, (F.greatest(at, F.lit(0)) + 1).cast("int"), F.lit(1))
        return F.when(at == 0, F.lit(None)).otherwise(~F.arrays_overlap(before, no) & ~F.arrays_overlap(after, no))

    def found(t: Column) -> Column:
        return F.array_compact(F.array(*(once(F.array_position(t, word), lambda at: near(t, at)) for word in words)))

    verdict = lambda f: F.when(F.size(f) == 0, F.lit(None).cast("boolean")).otherwise(F.array_contains(f, True))
    return once(tokens, lambda t: once(found(t), verdict))


def text_first(from_text: Column, from_column: Column) -> Column:
    """What the text says, else what the column says."""
    return F.coalesce(from_text, from_column)


def violations(flags: dict[str, Column], answers: dict[str, Column]) -> Column:
    """How many answers contradict; a null answer asks for nothing, a null flag counts as false."""
    return sum((F.when(a.isNotNull() & (a != F.coalesce(flags[k], F.lit(False))), 1).otherwise(0) for k, a in answers.items()), F.lit(0))


def agreement(flags: dict[str, Column], wanted: dict[str, Column]) -> Column:
    """perfect, good, check or mismatch, by the flags that differ."""
    wrong = violations(flags, wanted)
    return F.when(wrong == 0, F.lit("perfect")).when(wrong == 1, F.lit("good")).when(wrong == 2, F.lit("check")).otherwise(F.lit("mismatch"))


def differences(flags: dict[str, Column], wanted: dict[str, Column]) -> Column:
    """Names of the flags that differ."""
    return F.array_compact(F.array(*(F.when(w.isNotNull() & (w != F.coalesce(flags[k], F.lit(False))), F.lit(k)) for k, w in wanted.items())))


def any_match(values: Column, pattern: str) -> Column:
    return F.exists(values, lambda x: x.rlike(pattern))


def next_question(distinct: dict[str, Column]) -> Column:
    """The first question, in the order given, whose field still has two values or more."""
    return F.element_at(F.array_compact(F.array(*(F.when(n > 1, F.lit(k)) for k, n in distinct.items()), F.lit("none"))), 1)


def mentioned_within(text: Column, keywords: list[str], negations: str, width: int) -> Column:
    """Whether any keyword occurs and none, at its first place, has a negation in the `width` characters before; null where none occurs."""
    at = [F.instr(text, F.lit(k)) for k in keywords]
    before = [F.substr(text, F.greatest(F.lit(1), a - width), F.least(F.lit(width), F.greatest(a - 1, F.lit(0)))) for a in at]
    denied = reduce(or_, ((a > 0) & b.rlike(negations) for a, b in zip(at, before, strict=True)))
    return F.when(reduce(or_, (a > 0 for a in at)), ~denied)
