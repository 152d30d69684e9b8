"""Votes, merges, registries and signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mode_vote(rows: DataFrame, keys: list[str], value: str, *, least_support: int = 1) -> DataFrame:
    """Per key: the most frequent value (smallest of equals), its votes, all votes and the ratio of both."""
    votes = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("votes"))
    best = votes.groupBy(*keys).agg(F.min(F.struct((-F.col("votes")).alias("less"), F.col(value).alias("value"))).alias("best"), F.sum("votes").alias("total"))
    return best.select(*keys, F.col("best.value").alias(value), (-F.col("best.less")).alias("votes"), "total").where(F.col("total") >= least_support).withColumn("ratio", F.col("votes") / F.col("total"))


def top_values(rows: DataFrame, keys: list[str], value: str, n: int) -> DataFrame:
    """The n most frequent values of each key, with counts and rank."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), value))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n)


def survivorship(rows: DataFrame, key: str, priority: str, *, first: list[str] = (), flags: list[str] = (), sets: list[str] = (), longest: list[str] = ()) -> DataFrame:
    """One row a key of several sources.

    `first`: the value that isn't null of the smallest priority; `flags`: true
    anywhere; `sets`: all values, sorted; `longest`: the longest text, of equals the first by priority.
    """
    pick = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(priority).alias("p"), F.col(c).alias("v"))))["v"].alias(c)
    long = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct((-F.length(c)).alias("l"), F.col(priority).alias("p"), F.col(c).alias("v"))))["v"].alias(c)
    return rows.groupBy(key).agg(*map(pick, first), *(F.max(c).alias(c) for c in flags), *(F.sort_array(F.collect_set(c)).alias(c) for c in sets), *map(long, longest))


def signatures(rows: DataFrame, grains: list[list[str]], flags: list[str], support: list[int]) -> DataFrame:
    """Shares of flags at several grains in one pass; `grain` is the number of the grain, and each grain has its least support."""
    columns = list(dict.fromkeys(c for g in grains for c in g))
    ids = [sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in g) for g in grains]
    sets = rows.groupingSets([[F.col(c) for c in g] for g in grains], *map(F.col, columns)).agg(
        F.grouping_id().alias("__id"), F.count("*").alias("n"), *(F.avg(F.col(f).cast("double")).alias(f) for f in flags)
    )
    grain = F.lit(None).cast("int")
    enough = F.lit(False)
    for i, g in enumerate(ids):
        grain = F.when(F.col("__id") == g, F.lit(i)).otherwise(grain)
        enough = enough | ((F.col("__id") == g) & (F.col("n") >= support[i]))
    return sets.where(enough).withColumn("grain", grain).drop("__id")


def collision_registry(rows: DataFrame, group: str, member: str, tags: list[tuple[int, str]], default: str) -> DataFrame:
    """Distinct (group, member) with the size of the group, the rank in it and a tag by size (first bound that holds it)."""
    pairs = rows.select(group, member).distinct()
    whole, order = Window.partitionBy(group), Window.partitionBy(group).orderBy(member)
    sized = pairs.withColumn("group_size", F.count("*").over(whole)).withColumn("rank_in_group", F.row_number().over(order))
    tag: Column = F.lit(default)
    for most, name in reversed(tags):
        tag = F.when(F.col("group_size") <= most, F.lit(name)).otherwise(tag)
    return sized.withColumn("tag", tag)


def co_occurrence(rows: DataFrame, basket: str, item: str) -> DataFrame:
    """Ordered pairs of different items of a basket with the number of baskets, and of the first item's."""
    sets = rows.select(basket, item).distinct()
    pairs = sets.join(sets.select(basket, F.col(item).alias("other")), basket).where(F.col(item) != F.col("other"))
    both = pairs.groupBy(item, "other").agg(F.count("*").alias("n_both"))
    return both.join(sets.groupBy(item).agg(F.count("*").alias("n_item")), item)


def drift(before: DataFrame, after: DataFrame, keys: list[str], value: str, least: float) -> DataFrame:
    """Keys whose value differs by at least `least` between two tables; a missing one counts as 0."""
    a, b = before.select(*keys, F.col(value).alias("before")), after.select(*keys, F.col(value).alias("after"))
    both = a.join(b, keys, "full").select(*keys, F.coalesce("before", F.lit(0.0)).alias("before"), F.coalesce("after", F.lit(0.0)).alias("after"))
    return both.withColumn("change", F.col("after") - F.col("before")).where(F.abs("change") >= least)


def classify_changes(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """new, missing, changed or unchanged, by key."""
    a, b = old.select(key, F.col(value).alias("old")), new.select(key, F.col(value).alias("new"))
    kind = F.when(F.col("old").isNull(), F.lit("new")).when(F.col("new").isNull(), F.lit("missing")).when(F.col("old") != F.col("new"), F.lit("changed")).otherwise(F.lit("unchanged"))
    return a.join(b, key, "full").withColumn("change", kind)


def fallback_modes(rows: DataFrame, probes: DataFrame, grains: list[list[str]], value: str) -> DataFrame:
    """Each probe's most frequent value at the first grain that knows its keys, with the number of that grain."""
    out = probes
    for i, grain in enumerate(grains):
        votes = mode_vote(rows, grain, value).select(*grain, F.col(value).alias(f"__v{i}")) if grain else mode_vote(rows.withColumn("__all", F.lit(1)), ["__all"], value).select("__all", F.col(value).alias(f"__v{i}"))
        out = out.join(votes, grain, "left") if grain else out.withColumn("__all", F.lit(1)).join(votes, "__all", "left").drop("__all")
    names = [f"__v{i}" for i in range(len(grains))]
    level: Column = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(names))):
        level = F.when(F.col(name).isNotNull(), F.lit(i)).otherwise(level)
    return out.withColumn(value, F.coalesce(*names)).withColumn("grain", level).drop(*names)
