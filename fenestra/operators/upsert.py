"""Merging new rows into tables: results are new tables, written by whoever calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def add_counts(state: DataFrame, events: DataFrame, keys: list[str], at: str) -> DataFrame:
    """State (keys, hits, first_seen, last_seen) with events (keys, at) added."""
    fresh = events.groupBy(*keys).agg(F.count("*").alias("hits"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))
    return state.unionByName(fresh).groupBy(*keys).agg(F.sum("hits").alias("hits"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def keep_max(state: DataFrame, rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return state.unionByName(rows).groupBy(*keys).agg(F.max(value).alias(value))


def insert_absent(state: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are new are added, one of each key; others change nothing."""
    return state.unionByName(rows.join(state, keys, "left_anti").dropDuplicates(keys))


def replace_all(state: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows take the place of rows of the same keys."""
    return state.join(rows, keys, "left_anti").unionByName(rows)


def merge_evidence(state: DataFrame, rows: DataFrame, keys: list[str], *, fill: list[str], most: list[str]) -> DataFrame:
    """`fill`: the new value unless null; `most`: the larger; `evidence` grows by one for a key met again."""
    names = [*fill, *most, "evidence"]
    old, new = state.select(*keys, *(F.col(c).alias(f"o_{c}") for c in names)), rows.select(*keys, *(F.col(c).alias(f"n_{c}") for c in (*fill, *most))).withColumn("met", F.lit(True))
    both = old.join(new, keys, "full")
    return both.select(
        *keys, *(F.coalesce(f"n_{c}", f"o_{c}").alias(c) for c in fill), *(F.greatest(f"n_{c}", f"o_{c}").alias(c) for c in most),
        (F.coalesce("o_evidence", F.lit(0)) + F.when(F.col("met"), 1).otherwise(0)).cast("bigint").alias("evidence"),
    )


def decayed(state: DataFrame, today, *, steps: list[tuple[int, int]]) -> tuple[DataFrame, DataFrame]:
    """(kept, archived): a key with up to `hits` hits is archived after `days` days without one."""
    old = F.lit(False)
    for hits, days in steps:
        old = old | ((F.col("hits") <= hits) & (F.datediff(F.lit(today), F.col("last_seen")) > days))
    return state.where(~old), state.where(old)
