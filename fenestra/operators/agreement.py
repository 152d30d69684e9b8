"""How well offers agree with what is asked for: features, weighted by a table, clamped by make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stands in a weight for any value that no other row names.
ANY = "*"
#: A table of weights of no more rows is sent to every task.
BROADCAST_ROWS = 100_000


def _profiles(rows: DataFrame, id_: str, extra: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """(id, extra, key) of every id, and the features of each distinct profile: (key, extra, feature, value)."""
    sets = rows.groupBy(id_, *extra).agg(F.sort_array(F.collect_set(F.when(F.col("feature").isNotNull() & F.col("value").isNotNull(), F.struct("feature", "value")))).alias("set"))
    keyed = sets.withColumn(name, F.sha2(F.to_json(F.struct("set", *extra)), 256))
    return keyed.select(id_, *extra, name), keyed.select(name, *extra, "set").dropDuplicates([name]).select(name, *extra, F.explode("set").alias("x")).select(name, *extra, "x.*")


def agreement(asked: DataFrame, offered: DataFrame, weights: DataFrame, clamps: DataFrame, *, default: tuple[float, float, float] = (float("-inf"), float("inf"), 0.0)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(asked_key, offered_key, score) of profiles with a feature in common, (asked_id, make, asked_key), (offered_id, offered_key).

    asked (asked_id, make, feature, value) and offered (offered_id, feature, value) have
    a row for each known feature; a null feature or value is unknown. weights (feature,
    asked, offered, points): `*` is any value that no other row names, (*, =) any equal
    values, a null on one side says
    what it counts that this side doesn't know the feature; what no row says counts
    nothing. clamps (make, low, high, perfect): the range of the sum, and what is added
    before if every known feature asked for is offered with the same value; other makes take `default`.

    Each distinct profile is scored once, over the features that both know: what
    one side alone knows is a sum over its own profile, from which the common ones are taken off.
    """
    who_asks, a = _profiles(asked, "asked_id", ["make"], "asked_key")
    who_offers, o = _profiles(offered, "offered_id", [], "offered_key")
    near = F.broadcast if weights.count() <= BROADCAST_ROWS else (lambda d: d)
    both = near(weights.where("asked IS NOT NULL AND offered IS NOT NULL AND asked <> '*' AND offered <> '*'").select("feature", F.col("asked").alias("value"), F.col("offered").alias("o_value"), F.col("points").alias("exact")))
    same = near(weights.where("asked = '*' AND offered = '='").select("feature", F.col("points").alias("equal")))
    other = near(weights.where("asked = '*' AND offered = '*'").select("feature", F.col("points").alias("any")))

    def alone(side: DataFrame, missing: str, known: str) -> DataFrame:
        """What each feature of a profile counts where the other side doesn't know it."""
        rows = weights.where(F.col(missing).isNull() & F.col(known).isNotNull())
        named, rest = rows.where(F.col(known) != ANY).select("feature", F.col(known).alias("value"), F.col("points").alias("p1")), rows.where(F.col(known) == ANY).select("feature", F.col("points").alias("p2"))
        return side.join(near(named), ["feature", "value"], "left").join(near(rest), "feature", "left").withColumn("alone", F.coalesce("p1", "p2", F.lit(0.0))).drop("p1", "p2")

    a, o = alone(a, "offered", "asked"), alone(o, "asked", "offered")
    a_all = a.groupBy("asked_key", "make").agg(F.sum("alone").alias("a_alone"), F.count("*").alias("a_known"))
    o_all = o.groupBy("offered_key").agg(F.sum("alone").alias("o_alone"))
    met = a.join(o.select("offered_key", "feature", F.col("value").alias("o_value"), F.col("alone").alias("o_one")), "feature")
    met = met.join(both, ["feature", "value", "o_value"], "left").join(same, "feature", "left").join(other, "feature", "left")
    equal = F.col("value") == F.col("o_value")
    points = F.coalesce("exact", F.when(equal, F.coalesce("equal", "any")).otherwise(F.col("any")), F.lit(0.0))
    sums = met.groupBy("asked_key", "offered_key").agg(F.sum(points - F.col("alone") - F.col("o_one")).alias("common"), F.count_if(equal).alias("n_equal"))
    limits = near(clamps.select("make", "low", "high", "perfect"))
    scored = sums.join(a_all, "asked_key").join(o_all, "offered_key").join(limits, "make", "left")
    low, high, perfect = (F.coalesce(c, F.lit(d)) for c, d in zip(("low", "high", "perfect"), default, strict=True))
    total = F.col("common") + F.col("a_alone") + F.col("o_alone") + F.when(F.col("n_equal") == F.col("a_known"), perfect).otherwise(0.0)
    scored = scored.select("asked_key", "offered_key", F.round(F.greatest(low, F.least(high, total)), 9).alias("score"))
    return scored, who_asks, who_offers


def best_offers(asked: DataFrame, offered: DataFrame, weights: DataFrame, clamps: DataFrame, **options) -> DataFrame:
    """asked_id, offered_id, score: of each id the offer with the highest score, then the smallest id; none without a common feature."""
    scored, who_asks, who_offers = agreement(asked, offered, weights, clamps, **options)
    firsts = who_offers.groupBy("offered_key").agg(F.min("offered_id").alias("offered_id"))
    best = scored.join(firsts, "offered_key").groupBy("asked_key").agg(F.min(F.struct((-F.col("score")).alias("less"), "offered_id")).alias("b"))
    return who_asks.join(best, "asked_key").select("asked_id", F.col("b.offered_id").alias("offered_id"), (-F.col("b.less")).alias("score"))
