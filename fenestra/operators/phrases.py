"""Rules for phrases: a table of thousands of phrases applied to texts in one pass, longest first.

The table becomes a trie of words: (node, word) -> (next node). Places in texts go
down the trie a word at a time, each step an equality join, so that a place leaves as
soon as no phrase goes on. Nothing is compared with every phrase.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A trie of no more edges is sent to every task; a larger one is joined by shuffling.
BROADCAST_EDGES = 200_000

RULE = ["rule", "make", "replacement", "priority"]
MATCHES = "array<struct<at:int,n:int,rule:bigint,replacement:string>>"


def words(text: Column) -> Column:
    """Upper-case words: letters, digits and what joins them inside a name (' . / & + -); all else parts words."""
    return F.filter(F.split(F.translate(text, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), r"[\x00-\x25\x28-\x2A\x2C\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != "")


def trie(rules: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(edges, ends, depth) of rules (rule, phrase, make, replacement, priority).

    A node is the phrase so far, its words joined by spaces. `ends` has for each
    node and make (null: any) the one rule with the highest priority, then the smallest id.
    Phrases without words are left out.
    """
    own = rules.select(*RULE, words(F.col("phrase")).alias("w")).where(F.size("w") > 0)
    steps = own.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.struct(F.array_join(F.slice("w", 1, i - 1), " ").alias("node"), F.element_at("w", i).alias("word"), F.array_join(F.slice("w", 1, i), " ").alias("next")))).alias("s"))
    edges = steps.select("s.*").distinct()
    best = F.min(F.struct((-F.col("priority")).alias("less"), "rule", "replacement"))
    ends = own.groupBy(F.array_join("w", " ").alias("node"), "make").agg(best.alias("b")).select("node", "make", "b.rule", "b.replacement")
    depth = own.agg(F.max(F.size("w"))).first()[0] or 0
    return edges, ends, depth


def found(texts: DataFrame, rules: DataFrame, *, key: str, text: str, make: str | None = None) -> DataFrame:
    """(key, at, n, rule, replacement): all places where a phrase stands, the longest at each place.

    `at` counts words from 0, `n` is the number of words. A rule with a make holds only
    in rows of that make, where it goes before a rule for any make with the same phrase. `key` tells
    rows apart; rows of a null text have no places.
    """
    edges, ends, depth = trie(rules)
    small = edges.count() <= BROADCAST_EDGES
    near = F.broadcast if small else (lambda d: d)
    mine = F.col(make) if make else F.lit(None).cast("string")
    listed = texts.select(F.col(key).alias("key"), mine.alias("own_make"), words(F.col(text)).alias("w"))
    # at each place as many words as the longest phrase has
    ahead = F.transform("w", lambda word, i: F.slice("w", i + 1, max(depth, 1)))
    open_ = listed.select("key", "own_make", F.posexplode(ahead).alias("at", "w")).withColumn("first", F.element_at("w", 1))
    open_ = open_.join(near(edges.where("node = ''").select(F.col("word").alias("first"), F.col("next").alias("node"))), "first").drop("first").withColumn("n", F.lit(1))
    reached = open_
    for n in range(2, depth + 1):
        step = edges.select(F.col("node").alias("e_node"), F.col("word").alias("e_word"), F.col("next").alias("e_next"))
        open_ = open_.where(F.size("w") >= n).join(near(step), (F.col("node") == F.col("e_node")) & (F.element_at("w", n) == F.col("e_word"))).select("key", "own_make", "at", "w", F.col("e_next").alias("node"), F.lit(n).alias("n"))
        reached = reached.unionByName(open_)
    met = reached.drop("w").join(near(ends), "node").where(F.col("make").isNull() | (F.col("make") == F.col("own_make")))
    best = F.max_by(F.struct("n", "rule", "replacement"), F.struct("n", F.col("make").isNotNull(), -F.col("rule")))
    return met.groupBy("key", "at").agg(best.alias("m")).select(F.col("key").alias(key), "at", "m.*")


def chosen(places: DataFrame, *, key: str) -> DataFrame:
    """key, matches: array of (at, n, rule, replacement), from the left, none overlapping the one before."""
    listed = places.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "n", "rule", "replacement"))).cast(MATCHES).alias("matches"))

    def leftmost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for places in batch.column(1).to_pylist():
                end, own = 0, []
                for m in places:
                    if m["at"] >= end:
                        own.append(m)
                        end = m["at"] + m["n"]
                kept.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, batch.schema.field(1).type)], schema=batch.schema)

    return listed.mapInArrow(leftmost, listed.schema)


def rewritten(text: Column, matches: Column) -> Column:
    """The words of a text with every match replaced, in upper case, single spaces; an empty replacement drops the words."""
    w = words(text)
    end = lambda i: F.when(i == 0, 0).otherwise(F.try_element_at(matches, i)["at"] + F.try_element_at(matches, i)["n"])  # noqa: E731  of the match before the i-th, from 0
    done = F.flatten(F.transform(matches, lambda m, i: F.concat(F.slice(w, end(i) + 1, m["at"] - end(i)), F.filter(F.array(m["replacement"]), lambda r: r != ""))))
    return F.array_join(F.concat(done, F.slice(w, end(F.size(matches)) + 1, F.size(w))), " ")


def normalised(rows: DataFrame, rules: DataFrame, *, text: str, make: str | None, into: str) -> DataFrame:
    """Rows with a column `into`: the text rewritten by the rules. Each distinct (make, text) is rewritten once.

    A row without words keeps an empty string, a null text stays null.
    """
    by = [c for c in (make, text) if c]
    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-")) for c in by]
    distinct = rows.select(*by).distinct().withColumn("__key", F.sha2(F.concat(*parts), 256))
    spots = chosen(found(distinct, rules, key="__key", text=text, make=make), key="__key")
    done = distinct.join(spots, "__key", "left").select(*(F.col(c).alias(f"__{c}") for c in by), rewritten(F.col(text), F.coalesce("matches", F.array().cast(MATCHES))).alias(into))
    met = F.lit(True)
    for c in by:
        met = met & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.join(done, met, "left").drop(*(f"__{c}" for c in by))
