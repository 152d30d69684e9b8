"""How many offers lie near a number, and the least of them by key: by sorted values and tables of stretches, not by pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a chunk; a task holds a chunk of either side at a time.
CHUNK = 1 << 16


def _stretches(ranks: np.ndarray, keep: int) -> list[np.ndarray]:
    """Of every stretch of 1, 2, 4 and so on of them, by where it begins, the least ranks in order; what is missing is the number of all."""
    n = len(ranks)
    levels = [np.full((n, keep), n, np.int32)]
    levels[0][:, 0] = ranks
    while 2 << len(levels) - 1 <= n:
        half = 1 << len(levels) - 1
        levels.append(np.sort(np.concatenate([levels[-1][:-half], levels[-1][half:]], axis=1), axis=1)[:, :keep])
    return levels


def _near(at: np.ndarray, values: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) of the sorted values for which abs(at - value) < reach holds as the machine computes it."""
    own = np.unique(values)
    first, end = np.searchsorted(own, at - reach), np.searchsorted(own, at + reach)
    held = lambda i: np.abs(at - own[np.clip(i, 0, len(own) - 1)]) < reach
    # the sums may be rounded otherwise than the difference: both ends are moved until they agree with it
    for step, wrong in ((1, lambda: (first < len(own)) & (own[np.minimum(first, len(own) - 1)] < at) & ~held(first)), (-1, lambda: (first > 0) & held(first - 1))):
        while (moved := wrong()).any():
            first = first + step * moved
    for step, wrong in ((-1, lambda: (end > first) & ~held(end - 1)), (1, lambda: (end < len(own)) & held(end))):
        while (moved := wrong()).any():
            end = end + step * moved
    return tuple(np.searchsorted(values, own[np.minimum(i, len(own) - 1)]) + np.where(i == len(own), len(values) - np.searchsorted(values, own[-1]), 0) for i in (first, np.maximum(first, end)))


def _least_of_chunk(on: list[str], reach: float, keep: int):
    def run(asked: pa.Table, offered: pa.Table) -> pa.Table:
        names, of_none = [*on, "at", "n", "items"], pa.array([], pa.list_(offered.schema.field("item").type))
        if not asked.num_rows or not offered.num_rows:
            return pa.table([*(asked[c].slice(0, 0) for c in [*on, "at"]), pa.array([], pa.int64()), of_none], names=names)
        offered = offered.sort_by("item")
        values, at = offered["value"].to_numpy(), asked["at"].to_numpy()
        by_value = np.argsort(values, kind="stable")
        first, end = _near(at, values[by_value], reach)
        met = np.flatnonzero(end > first)
        first, n = first[met], (end - first)[met]
        least, none = np.full((len(met), keep), len(values), np.int32), len(values)
        level = np.frexp(n)[1] - 1  # two stretches, which may lie over each other, cover all
        for k, stretches in enumerate(_stretches(by_value, keep)):
            here = np.flatnonzero(level == k)
            both = np.sort(np.concatenate([stretches[first[here]], stretches[first[here] + n[here] - (1 << k)]], axis=1), axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = none
            least[here] = np.sort(both, axis=1)[:, :keep]
        known = least < none
        items = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(known.sum(axis=1))]), pa.int32()), offered["item"].combine_chunks().take(pa.array(least[known])))
        return pa.table([*(asked[c].take(pa.array(met)) for c in [*on, "at"]), pa.array(n.astype(np.int64)), items], names=names)

    return run


def least_within(asked: DataFrame, offered: DataFrame, on: list[str], *, reach: float, keep: int, chunk: int = CHUNK) -> DataFrame:
    """(on, at, n, items) of the distinct rows (on, at) of `asked` near which anything is offered: how many of the offers (on, value, item) have abs(at - value) < reach, and the `keep` least items of these, in order.

    Both sides of a key are dealt into chunks, which meet in tasks of their own, by sorted values and by the least items of stretches
    of 1, 2, 4 and so on values; a task sends one row for each row asked, so that no pairs are made. `at` and `value` are doubles; null and what is no finite number is near nothing.
    """
    finite = lambda c: F.abs(c) < float("inf")

    def dealt(rows: DataFrame, order: list[str], own: str, last: str) -> tuple[DataFrame, DataFrame]:
        of_key = Window.partitionBy(*on)
        chunk_of = lambda n: F.floor((n - 1) / chunk).cast("int")
        return rows.withColumn(own, chunk_of(F.row_number().over(of_key.orderBy(*order)))), rows.groupBy(*on).agg(chunk_of(F.count("*")).alias(last))

    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c)))
    a, a_chunks = dealt(asked.select(*on, "at").where(finite("at")).distinct(), ["at"], "a_chunk", "a_last")
    o, o_chunks = dealt(offered.select(*on, "value", "item").where(finite("value") & F.col("item").isNotNull()), ["item", "value"], "o_chunk", "o_last")
    a = a.join(o_chunks, on).select(*on, "at", "a_chunk", every("o_last").alias("o_chunk"))
    o = o.join(a_chunks, on).select(*(F.col(c).alias(f"o_{c}") for c in on), "value", "item", F.col("o_chunk").alias("to_o"), every("a_last").alias("to_a"))
    parts = max(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)  # chunks aren't put together by size
    together = lambda d, *keys: d.repartition(parts, *keys).groupBy(*keys)
    kinds = dict(a.dtypes) | dict(o.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in [*on, "at"]), "n bigint", f"items array<{kinds['item']}>"])
    found = together(a, *on, "a_chunk", "o_chunk").cogroup(together(o, *(f"o_{c}" for c in on), "to_a", "to_o")).applyInArrow(_least_of_chunk(on, reach, keep), schema)
    return found.groupBy(*on, "at").agg(F.sum("n").alias("n"), least_of("items", keep).alias("items"))


def least_of(lists: str, keep: int) -> Column:
    """The least items of short lists, put together."""
    return F.slice(F.sort_array(F.flatten(F.collect_list(lists))), 1, keep)
