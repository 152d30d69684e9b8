"""Stored tables by key: dealt into buckets, merged bucket by bucket, published by a manifest.

Rows lie in the bucket that a hash of their key gives, sorted by key and with Bloom
filters of it. A merge writes a new version of the buckets in which something changes;
gates then judge the whole candidate, and a manifest, which names the version of
each bucket, makes it visible by one rename. Without that, readers go on with what was
published before, and the next merge starts from there.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fenestra.operators import quality
from fenestra.sources.files import Folder

STATUS = "__status"


@dataclass
class Merge:
    """What a merge did: keys by status, buckets written, gates that failed, the version that is visible now."""

    new: int = 0
    changed: int = 0
    unchanged: int = 0
    buckets: list[int] = field(default_factory=list)
    failed: list[str] = field(default_factory=list)
    version: int = 0
    published: bool = False


class KeyedTable:
    """A table with one row for each key, in `buckets` buckets. `policy` says for each other column what a merge keeps.

    new: the delivered value, also if null; fill: the delivered value unless it is
    null; max: the larger one; sum: both together. Of several delivered rows with a key, max
    and sum take all; new and fill take the row that is largest as a whole.
    """

    def __init__(self, spark: SparkSession, home: str, keys: list[str], policy: dict[str, str], *, buckets: int = 64):
        if wrong := set(policy.values()) - {"new", "fill", "max", "sum"}:
            raise ValueError(f"unknown policies: {sorted(wrong)}")
        self.spark, self.home, self.keys, self.policy, self.buckets = spark, home.rstrip("/"), keys, policy, buckets
        self.folder = Folder(spark, home)

    # ------------------------------------------------------------ reading

    def manifest(self) -> dict:
        """The newest published one: version, and the version that holds each bucket."""
        names = [n for n in self.folder.names("manifest") if n.endswith(".json")]
        return json.loads(self.folder.read(f"manifest/{names[-1]}")) if names else {"version": 0, "buckets": {}}

    def _paths(self, manifest: dict, buckets: list[int] | None = None) -> list[str]:
        return [f"{self.home}/data/v={v}/bucket={b}" for b, v in manifest["buckets"].items() if buckets is None or int(b) in buckets]

    def _read(self, paths: list[str], schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def rows(self) -> DataFrame:
        """What is published; an error if nothing is yet."""
        paths = self._paths(self.manifest())
        if not paths:
            raise FileNotFoundError(f"{self.home}: nothing is published")
        return self.spark.read.parquet(*paths).drop(STATUS)

    def lookup(self, wanted: list[tuple]) -> DataFrame:
        """The rows of a few keys; files of other buckets are not opened."""
        manifest = self.manifest()
        paths = self._paths(manifest)
        schema = self.spark.read.parquet(paths[0]).schema
        asked = self.spark.createDataFrame(wanted, ", ".join(f"{k} {schema[k].dataType.simpleString()}" for k in self.keys))
        buckets = [r[0] for r in asked.select(self.bucket()).distinct().collect()]
        same = F.lit(False)
        for row in wanted:
            here = F.lit(True)
            for k, v in zip(self.keys, row, strict=True):
                here = here & F.col(k).eqNullSafe(F.lit(v).cast(schema[k].dataType))
            same = same | here
        return self._read(self._paths(manifest, buckets), schema).where(same).drop(STATUS)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    # ------------------------------------------------------------ merging

    def merge(self, delivered: DataFrame, gates: dict[str, tuple[Column, float, bool]] | None = None) -> Merge:
        """Merges rows (keys and columns of the policy) and publishes the result, if all `gates` of `quality.gates` pass.

        The same delivery once more changes nothing, unless a policy is sum. A merge
        that was broken off leaves files that no manifest names; the next one takes their place.
        """
        before = self.manifest()
        version = before["version"] + 1
        one = self._one_each(delivered)
        touched = [r[0] for r in one.select(self.bucket().alias("b")).distinct().collect()]  # at most `buckets`
        old = self._read(self._paths(before, touched), one.schema)
        merged = self._joined(old, one)
        home = f"{self.home}/data/v={version}"
        options = {f"parquet.bloom.filter.enabled#{k}": "true" for k in self.keys}
        laid = merged.withColumn("bucket", self.bucket()).repartition("bucket").sortWithinPartitions("bucket", *self.keys)
        laid.write.mode("overwrite").partitionBy("bucket").options(**options).parquet(home)
        counts = self.spark.read.parquet(home).groupBy("bucket", STATUS).agg(F.count("*").alias("n")).collect() if touched else []
        total = lambda status: sum(r.n for r in counts if r[STATUS] == status)
        out = Merge(total("new"), total("changed"), total("unchanged"), sorted({r.bucket for r in counts if r[STATUS] in ("new", "changed")}), version=before["version"])
        for b in set(touched) - set(out.buckets):
            self.folder.delete(f"data/v={version}/bucket={b}")
        if not out.buckets:
            self.folder.delete(f"data/v={version}")
            return out
        after = {"version": version, "buckets": before["buckets"] | {str(b): version for b in out.buckets}}
        if gates:
            checked = quality.gates(self._read(self._paths(after), one.schema), gates)
            out.failed = sorted(r.gate for r in checked.where("NOT passed").collect())
        if out.failed:
            self.folder.delete(f"data/v={version}")
            return out
        self.publish(after)
        out.version, out.published = version, True
        return out

    def publish(self, manifest: dict) -> None:
        self.folder.write_once(f"manifest/{manifest['version']:012d}.json", json.dumps(manifest))

    def _one_each(self, delivered: DataFrame) -> DataFrame:
        whole = F.max(F.struct(*self.policy))
        pick = {"max": F.max, "sum": F.sum}
        kinds = {f.name: f.dataType for f in delivered.schema.fields}
        grouped = delivered.groupBy(*self.keys).agg(whole.alias("__row"), *(pick[p](c).alias(f"__{c}") for c, p in self.policy.items() if p in pick))
        return grouped.select(*self.keys, *((F.col(f"__{c}") if p in pick else F.col(f"__row.{c}")).cast(kinds[c]).alias(c) for c, p in self.policy.items()))

    def _joined(self, old: DataFrame, new: DataFrame) -> DataFrame:
        a = old.select(*(F.col(k).alias(f"a_{k}") for k in self.keys), *(F.col(c).alias(f"a_{c}") for c in self.policy), F.lit(True).alias("a_here"))
        b = new.withColumn("b_here", F.lit(True))
        met = F.lit(True)
        for k in self.keys:
            met = met & F.col(f"a_{k}").eqNullSafe(F.col(k))
        both = a.join(b, met, "full")
        here, had = F.col("b_here").isNotNull(), F.col("a_here").isNotNull()
        value = {
            "new": lambda c: F.when(here, F.col(c)).otherwise(F.col(f"a_{c}")),
            "fill": lambda c: F.coalesce(c, f"a_{c}"),
            "max": lambda c: F.greatest(c, f"a_{c}"),
            "sum": lambda c: F.when(F.col(c).isNull(), F.col(f"a_{c}")).otherwise(F.col(c) + F.coalesce(f"a_{c}", F.lit(0))),
        }
        kinds = {f.name: f.dataType for f in new.schema.fields}
        values = {c: value[p](c).cast(kinds[c]) for c, p in self.policy.items()}
        same = F.lit(True)
        for c, v in values.items():
            same = same & v.eqNullSafe(F.col(f"a_{c}"))
        status = F.when(~here, F.lit("kept")).when(~had, F.lit("new")).when(same, F.lit("unchanged")).otherwise(F.lit("changed"))
        return both.select(*(F.when(here, F.col(k)).otherwise(F.col(f"a_{k}")).alias(k) for k in self.keys), *(v.alias(c) for c, v in values.items()), status.alias(STATUS))
