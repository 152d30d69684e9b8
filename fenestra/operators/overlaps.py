"""Of each range the later one that it overlaps most: by dominance among sorted ends, not by pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a chunk; a task holds two chunks of a block at a time.
CHUNK = 1 << 16
NONE = np.iinfo(np.int64).min


def _before(group: np.ndarray, at: np.ndarray, worth: np.ndarray, asks: np.ndarray) -> np.ndarray:
    """Of each asking row the greatest worth offered in its group at its place or before, -1 if none. All are integers from 0."""
    order = np.argsort((group * (int(at.max(initial=0)) + 1) + at) * 2 + asks)
    base = group[order] * (int(worth.max(initial=0)) + 2)
    top = np.maximum.accumulate(base + np.where(asks, -1, worth)[order] + 1) - base - 1
    found = np.empty_like(top)
    found[order] = top
    return found


def _dominated(group: np.ndarray, x: np.ndarray, y: np.ndarray, worth: np.ndarray, asks: np.ndarray) -> np.ndarray:
    """The same among the offers of a group that lie at or before the asking row in both x and y.

    Rows are sorted by x; of every pair of neighbouring stretches of 1, 2, 4 and so on, the left one's offers reach the right one's askers.
    """
    order = np.argsort((group * (int(x.max(initial=0)) + 1) + x) * 2 + asks)
    group, y, worth, asks = group[order], y[order], worth[order], asks[order]
    place = np.arange(len(group))
    first = np.flatnonzero(np.diff(group, prepend=-1))
    place = place - np.repeat(first, np.diff(first, append=len(group)))
    best, level = np.full(len(group), -1), 0
    while place.max(initial=0) >> level:
        part = np.flatnonzero((place >> level & 1) == asks)
        stretch = group[part] * (int(place.max()) // 2 + 1) + (place[part] >> level + 1)
        best[part] = np.maximum(best[part], _before(stretch, y[part], worth[part], asks[part]))
        level += 1
    found = np.empty_like(best)
    found[order] = best
    return found


def _best(lo: np.ndarray, hi: np.ndarray, asks: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(overlap, place of the partner; -1 without one) for each asking row, among the offers of its group; of equal ones the first.

    A partner that holds the row overlaps in the row's length, one within it in its own; one that
    begins before ends as late as possible, one that ends after begins as early as possible. A range that ends before it
    begins has a length of 0 or less and meets those that hold both its ends.
    """
    n = len(lo)
    length, even, rank = hi - lo + 1, lo <= hi, n - 1 - np.arange(n)
    _, ends = np.unique(np.concatenate([np.minimum(lo, hi), np.maximum(lo, hi)]), return_inverse=True)
    x, y, x_back, y_back = ends[:n], ends[n:], ends.max() - ends[:n], ends.max() - ends[n:]
    overlap, partner = np.full(n, NONE), np.full(n, -1)

    def search(rows: np.ndarray, worth: np.ndarray, find, value) -> None:
        """Takes what `find` gives for some of the rows; the worth of an offer is made dense, of equal ones the first is worth more."""
        by_worth = np.lexsort((rank[rows], worth[rows]))
        dense = np.empty(len(rows), np.int64)
        dense[by_worth] = np.arange(len(rows))
        found = find(rows, dense)
        held = asks[rows] & (found >= 0)
        a, b = rows[held], rows[by_worth[found[held]]]
        days = value(a, b)
        better = (days > overlap[a]) | (days == overlap[a]) & (b < partner[a])
        overlap[a[better]], partner[a[better]] = days[better], b[better]

    def partly(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        days = np.minimum(hi[a], hi[b]) - np.maximum(lo[a], lo[b]) + 1
        return np.where(days > 0, days, NONE)

    search(np.flatnonzero(even | asks), rank * 0, lambda r, w: _dominated(group[r], x[r], y_back[r], w, asks[r]), lambda a, b: length[a])
    search(np.flatnonzero(even | ~asks), length, lambda r, w: _dominated(group[r], x_back[r], y[r], w, asks[r]), lambda a, b: length[b])
    search(np.flatnonzero(even), hi, lambda r, w: _before(group[r], x[r], w, asks[r]), partly)
    search(np.flatnonzero(even), -lo, lambda r, w: _before(group[r], y_back[r], w, asks[r]), partly)
    return overlap, partner


def _chunks(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """(a, b, days) of the first chunk's ranges against the second chunk's, or the later ones of the same."""
    rows = table.sort_by("id")
    ids, lo, hi = (rows[c].to_numpy().astype(np.int64) for c in ("id", "lo", "hi"))
    asks = rows["asks"].to_numpy(zero_copy_only=False)
    place = np.arange(len(ids))
    if key[-1].as_py() != key[-2].as_py():
        days, partner = _best(lo, hi, asks, place * 0)
    else:  # one chunk: of stretches of 2, 4, 8 and so on the earlier half asks the later one
        days, partner = np.full(len(ids), NONE), np.full(len(ids), -1)
        for level in range((len(ids) - 1).bit_length()):
            new, other = _best(lo, hi, (place >> level & 1) == 0, place >> level + 1)
            better = (other >= 0) & ((new > days) | (new == days) & (other < partner))
            days, partner = np.where(better, new, days), np.where(better, other, partner)
    met = partner >= 0
    return pa.table({"a": ids[met], "b": ids[partner[met]], "days": days[met]})


def overlapped_most(ranges: DataFrame, block: list[str], *, chunk: int = CHUNK) -> DataFrame:
    """(a, b, days): of each range (block, id, lo, hi) the one of its block with a greater id that it overlaps most, of equal ones the least id.

    Ranges are closed, their ends integers, and ids differ inside a block. A block is dealt into chunks of so many ids in a row, and each chunk
    meets itself and the later ones in tasks of their own: a task holds two chunks, sorts them a few times and sends one
    partner a range, so that no pairs are made. Rows that are dealt grow with the number of chunks of a block.
    """
    own = Window.partitionBy(*block)
    known = ranges.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*block, "id", "lo", "hi"]))
    placed = known.withColumn("own", F.floor((F.row_number().over(own.orderBy("id")) - 1) / chunk).cast("int")).withColumn("last", F.floor((F.count("*").over(own) - 1) / chunk).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("last")))
    met = placed.withColumn("other", other).select(*block, F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), (F.col("own") <= F.col("other")).alias("asks"), F.col("id").cast("bigint").alias("id"), F.col("lo").cast("bigint").alias("lo"), F.col("hi").cast("bigint").alias("hi"))
    parts = max(int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)  # few rows mean much work: they aren't put together by size
    found = met.repartition(parts, *block, "first", "second").groupBy(*block, "first", "second").applyInArrow(_chunks, "a bigint, b bigint, days bigint")
    best = found.groupBy("a").agg(F.max(F.struct("days", (-F.col("b")).alias("b"))).alias("m"))
    return best.select("a", (-F.col("m.b")).alias("b"), "m.days")
