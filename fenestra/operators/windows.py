"""Order-dependent operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in `order`."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)))
    return rows.withColumn("__n", last).where("__n = 1").drop("__n")


def keep_last(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The last n rows of each key: a ring buffer."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)))
    return rows.withColumn("__n", last).where(F.col("__n") <= n).drop("__n")


def failure_streak(rows: DataFrame, keys: list[str], order: list[str], ok: Column) -> DataFrame:
    """`streak`: failures in a row up to each row; `last_ok` and `last_failure`: the first column of `order` then."""
    line = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("__ok", ok).withColumn("__island", F.sum(F.col("__ok").cast("int")).over(line))
    inside = Window.partitionBy(*keys, "__island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    at = order[0]
    out = marked.withColumn("streak", F.sum((~F.col("__ok")).cast("int")).over(inside))
    out = out.withColumn("last_ok", F.max(F.when(F.col("__ok"), F.col(at))).over(line)).withColumn("last_failure", F.max(F.when(~F.col("__ok"), F.col(at))).over(line))
    return out.drop("__ok", "__island")


def carry_forward(rows: DataFrame, keys: list[str], order: list[str], value: str, into: str) -> DataFrame:
    """The last value up to each row that isn't null."""
    line = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(into, F.last(value, ignorenulls=True).over(line))


def sample_per_group(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def deviation(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """`previous`, `change` and `ratio` to the row before."""
    line = Window.partitionBy(*keys).orderBy(order) if keys else Window.orderBy(order)
    before = rows.withColumn("previous", F.lag(value).over(line))
    return before.withColumn("change", F.col(value) - F.col("previous")).withColumn("ratio", F.col("change") / F.col("previous"))
