"""A learning cycle: rules mined from one period are tried on the next, and promoted or not."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenestra.sources.files import Folder


class LearningCycle:
    """Versions of rules in a folder, one for each period, and what became of each.

    Rules are shares of flags for keys of several grains, the finest first; each grain has its least
    support. A request takes the rule of the first grain that knows its keys, and a
    flag is expected where its share is at least `sure`. The rules of one period are tried on
    the counters of the next, beside those in force, which they replace
    if they are right at least as often. Every version stays in the folder.

    A period may be given again, as after a restart: it writes the same rows to the
    same places, provided later periods have not been given yet.
    """

    def __init__(self, spark: SparkSession, home: str, grains: list[list[str]], flags: list[str], support: list[int], *, sure: float = 0.5, drift: float = 0.2):
        self.spark, self.home, self.grains, self.flags, self.support, self.sure, self.drift = spark, home.rstrip("/"), grains, flags, support, sure, drift
        self.folder = Folder(spark, home)

    def counters(self, rows: DataFrame) -> DataFrame:
        """Rows, and rows with each flag, by the finest grain; a missing key is UNKNOWN."""
        keys = [F.coalesce(F.col(k).cast("string"), F.lit("UNKNOWN")).alias(k) for k in self.grains[0]]
        return rows.groupBy(*keys).agg(F.count("*").alias("n"), *(F.count_if(f).alias(f) for f in self.flags))

    def rules(self, counters: DataFrame) -> DataFrame:
        """grain, keys (null where the grain has none), n, shares in hundredths."""
        out = None
        for i, (grain, least) in enumerate(zip(self.grains, self.support, strict=True)):
            some = counters.groupBy(*grain).agg(F.sum("n").alias("n"), *(F.sum(f).alias(f) for f in self.flags)).where(F.col("n") >= least)
            keys = [F.col(k) if k in grain else F.lit(None).cast("string").alias(k) for k in self.grains[0]]
            one = some.select(F.lit(i).alias("grain"), *keys, "n", *((F.floor(F.col(f) / F.col("n") * 100 + 0.5) / 100).alias(f) for f in self.flags))
            out = one if out is None else out.unionByName(one)
        return out

    def tried(self, rules: DataFrame, counters: DataFrame) -> DataFrame:
        """One row: how many flags of how many requests the rules get right, and for how many requests there is one."""
        met = counters
        for i, grain in enumerate(self.grains):
            met = met.join(rules.where(F.col("grain") == i).select(*grain, F.struct(*self.flags).alias(f"rule_{i}")), grain, "left")
        rule = F.coalesce(*(f"rule_{i}" for i in range(len(self.grains))))
        right = sum(F.when(rule[f] >= self.sure, F.col(f)).otherwise(F.col("n") - F.col(f)) for f in self.flags)
        return met.agg(F.sum(right).alias("correct"), (F.sum("n") * len(self.flags)).alias("total"), F.coalesce(F.sum(F.when(rule.isNotNull(), F.col("n"))), F.lit(0)).alias("covered"))

    def _stored(self, rows: DataFrame, place: str) -> DataFrame:
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.home}/{place}") if place.startswith("decisions") else rows.write.mode("overwrite").parquet(f"{self.home}/{place}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.home}/{place}")

    def _rules_of(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.home}/rules/version={version}")

    def versions(self) -> list[int]:
        return sorted(int(n.partition("=")[2]) for n in self.folder.names("rules") if "=" in n)

    def decisions(self) -> DataFrame:
        """version, tried_on, rules, discoveries, drifted, correct, total, covered, in_force (before), in_force_correct, promoted."""
        return self.spark.read.parquet(f"{self.home}/decisions")

    def in_force(self, before: int) -> int | None:
        """The last version before `before` that was promoted."""
        if not self.folder.names("decisions"):
            return None
        return self.decisions().where((F.col("version") < before) & F.col("promoted")).agg(F.max("version")).first()[0]

    def step(self, rows: DataFrame, period: int) -> None:
        """Tries the version before on this period's rows, decides on it, and mines the next."""
        counters = self._stored(self.counters(rows), f"counters/period={period}")
        if earlier := [v for v in self.versions() if v < period]:
            self._decide(earlier[-1], period, counters)
        self._stored(self.rules(counters), f"rules/version={period}")

    def _decide(self, version: int, period: int, counters: DataFrame) -> None:
        rules, active = self._rules_of(version), self.in_force(version)
        one = self.tried(rules, counters).withColumn("rules", F.lit(rules.count()))
        if active is None:
            one = one.select("*", F.lit(None).cast("bigint").alias("in_force_correct"), F.col("rules").cast("bigint").alias("discoveries"), F.lit(0).cast("bigint").alias("drifted"))
        else:
            forced = self._rules_of(active)
            met = F.col("a.grain") == F.col("b.grain")
            for k in self.grains[0]:
                met = met & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
            moved = sum((F.abs(F.col(f"a.{f}") - F.col(f"b.{f}")) >= self.drift - 1e-9).cast("int") for f in self.flags)
            compared = rules.alias("a").join(forced.alias("b"), met, "left").agg(F.count_if(F.col("b.grain").isNull()).alias("discoveries"), F.coalesce(F.sum(F.when(F.col("b.grain").isNotNull(), moved)), F.lit(0)).alias("drifted"))
            one = one.crossJoin(self.tried(forced, counters).select(F.col("correct").alias("in_force_correct"))).crossJoin(compared)  # three tables of one row
        promoted = F.coalesce(F.col("correct") >= F.col("in_force_correct"), F.lit(True))
        row = one.select(
            F.lit(version).cast("bigint").alias("version"), F.lit(period).cast("bigint").alias("tried_on"), F.col("rules").cast("bigint").alias("rules"), "discoveries", "drifted", "correct", "total", "covered",
            F.lit(active).cast("bigint").alias("in_force"), "in_force_correct", promoted.alias("promoted"),
        )
        self._stored(row, f"decisions/tried={period}")

    def follow(self, batch: DataFrame, period: str) -> None:
        """For foreachBatch: steps through the periods of a batch in order; a period must not be spread over batches."""
        for r in batch.select(F.col(period).cast("bigint").alias("p")).distinct().orderBy("p").collect():
            self.step(batch.where(F.col(period) == r.p), r.p)
