"""Which of many intervals of a key holds a point, and weighs most: by dyadic pieces, not by pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECES = "array<struct<level:int,piece:bigint>>"


def pieces_of(lo: Column, hi: Column, levels: int) -> Column:
    """The fewest dyadic pieces (level, number) that make up a closed interval of integers from 0 below 2^levels: two a level at most."""

    def step(s: Column, level: Column) -> Column:
        first, last = s["lo"] % 2 == 1, s["hi"] % 2 == 0
        open_ = s["lo"] <= s["hi"]
        piece = lambda at: F.array(F.struct(level.cast("int").alias("level"), at.alias("piece")))
        none = F.array().cast(PIECES)
        out = F.when(~open_, none).otherwise(F.concat(F.when(first, piece(s["lo"])).otherwise(none), F.when(last & ~(first & (s["lo"] == s["hi"])), piece(s["hi"])).otherwise(none)))
        lo, hi = s["lo"] + F.when(first, 1).otherwise(0), s["hi"] - F.when(last, 1).otherwise(0)
        shift = lambda x: F.floor(x / 2).cast("bigint")
        return F.struct(F.when(open_, shift(lo)).otherwise(1).cast("bigint").alias("lo"), F.when(open_, shift(hi)).otherwise(0).cast("bigint").alias("hi"), F.concat(s["out"], out).alias("out"))

    start = F.struct(lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"), F.array().cast(PIECES).alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), start, step)["out"]


def heaviest_holding(intervals: DataFrame, probes: DataFrame, on: list[str], *, lo: str, hi: str, weight: str, item: str, at: str, least: int, most: int) -> DataFrame:
    """`probes` with `weight` and `item` of the heaviest interval of the same key that holds `at`, then of the smallest item; null without one.

    Ends and points are integers from `least` to `most`; a null end is open, and ends and
    points outside are cut off or hold nothing. Every interval is cut into dyadic pieces,
    of which each keeps its heaviest item, and a point lies in one piece a level: so a
    probe is an equality join, and the number of rows made grows with intervals plus
    probes times the logarithm of the range, however many of them overlap.
    """
    levels = max(most - least, 1).bit_length()
    low, high = F.greatest(F.coalesce(lo, F.lit(least)), F.lit(least)) - least, F.least(F.coalesce(hi, F.lit(most)), F.lit(most)) - least
    cut = intervals.select(*on, F.col(weight).alias("__w"), F.col(item).alias("__i"), low.alias("__lo"), high.alias("__hi")).where("__lo <= __hi")
    laid = cut.select(*on, "__w", "__i", F.explode(pieces_of(F.col("__lo"), F.col("__hi"), levels)).alias("p")).select(*on, "p.level", "p.piece", F.struct((-F.col("__w")).alias("less"), F.col("__i").alias("item")).alias("own"))
    best = laid.groupBy(*on, "level", "piece").agg(F.min("own").alias("own"))
    inside = F.col(at).between(least, most)
    asked = probes.select(*on, at).where(inside).distinct()  # each point of a key once
    spots = asked.select(*on, at, F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")).withColumn("piece", F.expr(f"shiftright(cast(`{at}` - {least} AS bigint), level)"))
    found = spots.join(best, [*on, "level", "piece"]).groupBy(*on, at).agg(F.min("own").alias("own")).select(*on, at, (-F.col("own.less")).alias(weight), F.col("own.item").alias(item))
    return probes.join(found, [*on, at], "left")
