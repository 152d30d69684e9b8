"""Joins that resolve records to a catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_with_gap(pairs: DataFrame, keys: list[str], score: str, ties: list[str]) -> DataFrame:
    """Of each key the best pair, with the score of the second best and the gap to it (null if there is none)."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), *ties)
    ranked = pairs.withColumn("__rank", F.row_number().over(order)).withColumn("second_score", F.lead(score).over(order))
    return ranked.where("__rank = 1").drop("__rank").withColumn("score_gap", F.col(score) - F.col("second_score"))


def blocked_join(left: DataFrame, right: DataFrame, block: list[str], score: Column, *, least: float | None = None, residual: Column | None = None, how: str = "inner") -> DataFrame:
    """All pairs of equal blocks, scored; token arrays and the like are made before, once a row.

    Columns of the two sides must have different names, blocks apart.
    """
    pairs = left.join(right, block, how)
    if residual is not None:
        pairs = pairs.where(residual)
    pairs = pairs.withColumn("score", score)
    return pairs if least is None else pairs.where(F.col("score") >= least)


def shared_tokens(left: DataFrame, right: DataFrame, block: list[str], left_keys: list[str], right_keys: list[str], *, tokens: tuple[str, str]) -> DataFrame:
    """Pairs of a block that share a token, once, with the number of tokens that they `shared`.

    An inverted index: both sides become a row a token, joined on block and token, so
    that pairs without a common token are never made. Token arrays have distinct elements.
    """
    a = left.select(*block, *left_keys, F.explode(tokens[0]).alias("__token"))
    b = right.select(*block, *right_keys, F.explode(tokens[1]).alias("__token"))
    return a.join(b, [*block, "__token"]).groupBy(*block, *left_keys, *right_keys).agg(F.count("*").alias("shared"))


def numbered(rows: DataFrame, block: str, order: list[str], name: str) -> DataFrame:
    """1 to n along `block`, then `order`: each block is numbered by itself, from an offset that only the blocks' sizes, a row a block, are ordered for."""
    sizes = rows.groupBy(block).agg(F.count("*").alias("__size"))
    before = F.sum("__size").over(Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(F.col(block).alias("__block"), F.coalesce(before, F.lit(0)).alias("__before"))
    placed = rows.withColumn("__place", F.row_number().over(Window.partitionBy(block).orderBy(*order)))
    return placed.join(offsets, F.col(block).eqNullSafe(F.col("__block"))).withColumn(name, (F.col("__before") + F.col("__place")).cast("bigint")).drop("__block", "__before", "__place")


def ordered_layers(layers: list[DataFrame], key: list[str], order: list[str]) -> DataFrame:
    """The union of layers with the same columns; of each key the row of the first layer that has it, then by `order`."""
    union = reduce(DataFrame.unionByName, (d.withColumn("layer", F.lit(i)) for i, d in enumerate(layers)))
    first = F.row_number().over(Window.partitionBy(*key).orderBy("layer", *order))
    return union.withColumn("__first", first).where("__first = 1").drop("__first")


def residual_cascade(asked: DataFrame, layers: list[tuple[str, DataFrame]], keys: list[str], home: str) -> tuple[DataFrame, DataFrame]:
    """(keys, layer, name, answer) of every distinct key of `asked`, and (layer, name, asked, found, left) of every layer.

    A layer is a name and rows (its own keys, answer), of which the least answer of a key counts. It is
    asked only for the keys that all earlier layers left: these are written to a folder of
    their own below `home`, so that later layers neither see nor compute anything of what is answered. It
    ends when nothing is left. Keys that no layer knows have null answers. Null is a key
    like any other in `asked`; a layer's own keys, which may be some of `keys`, must not be null.
    """
    spark, left = asked.sparkSession, asked.select(*keys).distinct()
    found, log = [], []
    for i, (name, layer) in enumerate(layers):
        on = [c for c in layer.columns if c != "answer"]
        least = layer.groupBy(*on).agg(F.min("answer").alias("answer"))
        probed = left.join(least, on, "left").select(*keys, "answer", F.col("answer").isNotNull().alias("known"))
        probed.write.mode("overwrite").partitionBy("known").parquet(f"{home}/{i}")
        met = spark.read.schema(probed.schema).parquet(f"{home}/{i}")
        n = {r.known: r["count"] for r in met.groupBy("known").count().collect()}
        log.append((i, name, sum(n.values()), n.get(True, 0), n.get(False, 0)))
        found.append(met.where("known").select(*keys, F.lit(i).alias("layer"), F.lit(name).alias("name"), "answer"))
        left = met.where("NOT known").select(*keys)
        if not n.get(False, 0):
            break
    nothing = left.select(*keys, F.lit(None).cast("int").alias("layer"), F.lit(None).cast("string").alias("name"), F.lit(None).cast(dict(layers[0][1].dtypes)["answer"]).alias("answer"))
    return reduce(DataFrame.unionByName, found + [nothing]), spark.createDataFrame(log, "layer int, name string, asked bigint, found bigint, left bigint")


def first_layer_rows(layers: list[DataFrame], key: list[str]) -> DataFrame:
    """All rows of each key's first layer."""
    union = reduce(DataFrame.unionByName, (d.withColumn("layer", F.lit(i)) for i, d in enumerate(layers)))
    return union.withColumn("__first", F.min("layer").over(Window.partitionBy(*key))).where("layer = __first").drop("__first")


def any_key_join(left: DataFrame, right: DataFrame, left_key: str, right_keys: list[str], left_id: list[str], order: list[str]) -> DataFrame:
    """A left join on left_key = any of right_keys, one row of the right side a left row.

    The right keys become rows, so that the join is on equality; of several
    matches, the one by the earliest key, then by `order`, is taken.
    """
    long = reduce(DataFrame.unionByName, (right.where(F.col(k).isNotNull()).withColumn("__key", F.col(k)).withColumn("matched_by", F.lit(i)) for i, k in enumerate(right_keys)))
    first = F.row_number().over(Window.partitionBy("__key").orderBy("matched_by", *order))
    single = long.withColumn("__n", first).where("__n = 1").drop("__n")
    return left.join(single, left[left_key] == single["__key"], "left").drop("__key")


def nearest_join(left: DataFrame, right: DataFrame, on: list[str], left_at: str, right_at: str, left_id: str, right_id: str) -> DataFrame:
    """Of each left row the right row of the same key nearest in `at`, before or after; ties go to the earlier, then to the smaller id.

    One sort of both sides together, so that nothing is multiplied: the neighbours
    of a left row are the last right row before and the first one after.
    """
    sides = left.select(*on, F.col(left_at).alias("__at"), F.col(left_id).alias("__left"), F.lit(None).cast(dict(right.dtypes)[right_id]).alias("__right")).unionByName(
        right.groupBy(*on, F.col(right_at).alias("__at")).agg(F.min(right_id).alias("__right")).withColumn("__left", F.lit(None).cast(dict(left.dtypes)[left_id]))
    )
    by_place = Window.partitionBy(*on).orderBy("__at", F.col("__right").isNull())
    place = F.when(F.col("__right").isNotNull(), F.struct(F.col("__at").alias("at"), F.col("__right").alias("id")))
    met = sides.withColumn("before", F.last(place, ignorenulls=True).over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    met = met.withColumn("after", F.first(place, ignorenulls=True).over(by_place.rowsBetween(0, Window.unboundedFollowing))).where("__left IS NOT NULL")
    gap = lambda side: F.abs(F.col("__at") - F.col(f"{side}.at"))
    nearer = F.when(F.col("before").isNull() | (gap("after") < gap("before")), F.col("after")).otherwise(F.col("before"))
    return met.select(*on, F.col("__left").alias(left_id), F.col("__at").alias(left_at), nearer["id"].alias(right_id), nearer["at"].alias(right_at))


def overlap_join(left: DataFrame, right: DataFrame, block: list[str], a: tuple[str, str], b: tuple[str, str], *, bin_size: int) -> DataFrame:
    """Pairs of a block whose closed integer ranges overlap, each once.

    Ranges are dealt into bins, so that long blocks become many keys; a pair counts
    in the bin where the overlap begins.
    """
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / bin_size).cast("bigint"), F.floor(F.col(hi) / bin_size).cast("bigint")))
    x, y = left.withColumn("__bin", bins(*a)), right.withColumn("__bin", bins(*b))
    begins = F.floor(F.greatest(F.col(a[0]), F.col(b[0])) / bin_size).cast("bigint")
    return x.join(y, [*block, "__bin"]).where((F.col(a[0]) <= F.col(b[1])) & (F.col(b[0]) <= F.col(a[1])) & (F.col("__bin") == begins)).drop("__bin")
