"""What the operators of this subpackage share: scratch tables, row keys, bounded filters."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts, as a regex class and as bytes.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_BYTES = b" \t\n\x0b\x0c\r"
#: Characters that are not white space: a word for sizes and shingles.
WORD_REGEX = r"[^\x20\x09-\x0D]+"
#: Words of letters, digits and everything beyond ASCII, for texts not yet lower-cased.
ALNUM_REGEX = r"[0-9A-Za-z\x80-\x{10FFFF}]+"
ALNUM_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: bytes.translate table: separators of ALNUM words become spaces, A-Z become a-z.
ALNUM_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, one of our own, on one machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
    return base


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Settings of the session for a while."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Settings of the writes. What a finished write has shuffled is of no more use (lost files of it would be made
#: again), and texts go to Python in batches of a few MB, however long they are.
TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut: checkpointed in the shared folder."""
    spark = df.sparkSession
    base = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read again."""
    return Scratch(df.sparkSession, tag).put(df)


class Scratch:
    """Parquet tables in the shared folder that go together once nothing reads them any more."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.home, self.n = spark, scratch(spark, tag), 0

    def put(self, df: DataFrame) -> DataFrame:
        """The same rows, written and read again; the shuffle files of the write go at once."""
        self.n += 1
        path = f"{self.home}/{self.n}"
        with settings(self.spark, TIDY):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(self.home)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def row_key(*, doc_id: str = "doc_id", text: str = "text") -> Column:
    """With doc_id, tells rows of different text apart also where a doc_id repeats or is null."""
    return F.xxhash64(F.col(doc_id), F.col(text))


# ---------------------------------------------------------------- rows by a list of few


#: Bits of the map of ids: 2^25 bits are at most 2^19 rows of 16 bytes, whatever the number of ids.
MAP_BITS = 25


def held(docs: DataFrame) -> DataFrame:
    """doc_id, row, it: the whole rows as one column, so that no name of theirs can clash with ours."""
    names = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key().alias("row"), F.struct(*names).alias("it"))


def sifted(rows: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The `rows` (doc_id, ...) whose doc_id may be in `listed` (doc_id), and those whose doc_id surely isn't.

    Which may be is read from a broadcast bit map of fixed size (MAP_BITS), so that
    only the former, about as many as are listed, have to meet `listed` in a join.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << MAP_BITS))
    bit = F.expr("shiftleft(1L, cast(place & 63 AS int))")
    words = listed.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    # a row whose bit is set finds its word; all others are left over
    bits = F.coalesce(F.expr("bit_get(bits, cast(place & 63 AS int)) = 1"), F.lit(False))
    met = rows.withColumn("place", place).join(F.broadcast(words), F.shiftright("place", 6) == F.col("word"), "left").withColumn("met", bits)
    return met.where("met").select(*rows.columns), met.where("NOT met").select(*rows.columns)


def without(docs: DataFrame, doomed: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, but those that `doomed` (doc_id, row, stay) lists.

    `row` is `row_key()`. Where stay is 1, one of the rows with that id and text stays, first
    by its other columns; where it is 0, none. Texts of rows that aren't listed are not shuffled.
    """
    ids = doomed.select("doc_id", "row", "stay").withColumnsRenamed({"doc_id": "d_id", "row": "d_row"})
    maybe, clear = sifted(held(docs), doomed)
    met = maybe.join(ids, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("row") == F.col("d_row")), "left")
    stays = clear.select("it.*").union(met.where("stay IS NULL").select("it.*"))
    if doomed.where("stay = 1").limit(1).count():
        order = F.to_json(F.struct(*(F.col("it")[c] for c in docs.columns if c != "text")))
        stays = stays.union(met.where("stay = 1").groupBy("doc_id", "row").agg(F.min_by("it", order).alias("it")).select("it.*"))
    return stays


# ---------------------------------------------------------------- bounded filter


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads the bits of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


class KeyFilter:
    """A Bloom filter over 64-bit keys in a fixed number of bits.

    Its size (2 MB by default) does not depend on the number of keys, so it may be
    broadcast. It never loses a key; with very many keys it lets more others
    through, and whoever uses it joins exactly afterwards.
    """

    LOG_BITS = 24
    PROBES = 3

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def positions(cls, keys: np.ndarray) -> list[np.ndarray]:
        h = mix64(keys)
        mask = np.uint64((1 << cls.LOG_BITS) - 1)
        return [(h >> np.uint64(i * 20)) & mask for i in range(cls.PROBES)]

    def __contains__(self, key: int) -> bool:
        return bool(self.test(np.array([key], dtype=np.int64))[0])

    def test(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), dtype=bool)
        for p in self.positions(keys):
            out &= (self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return out

    @classmethod
    def build(cls, keys: DataFrame) -> KeyFilter:
        """Of the single bigint column of `keys`; at most 2^LOG_BITS / 64 words reach the driver."""
        name, n_words, positions = keys.columns[0], 1 << (cls.LOG_BITS - 6), cls.positions

        def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.zeros(n_words, dtype=np.uint64)
            for batch in batches:
                k = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
                for p in positions(k):
                    np.bitwise_or.at(bits, (p >> np.uint64(6)).astype(np.int64), np.uint64(1) << (p & np.uint64(63)))
            at = np.flatnonzero(bits)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(bits[at].view(np.int64))], names=["at", "word"])

        rows = keys.select(F.col(name).cast("bigint")).mapInArrow(words_of, "at int, word bigint").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
        words = np.zeros(n_words, dtype=np.uint64)
        words[rows.column("at").to_numpy()] = rows.column("word").to_numpy().view(np.uint64)
        return cls(words)


# ---------------------------------------------------------------- components


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of `links` (a, b bigint): component is its smallest reachable node.

    Labels are lowered over the links and then through the labels' own labels until
    nothing changes; each round is a checkpoint. Only counts reach the driver.
    """
    pairs = links.select("a", "b").where("a <> b")
    edges = cut(pairs.union(pairs.select("b", "a")).distinct())
    labels = cut(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        heard = edges.join(labels.select(F.col("node").alias("b"), F.col("component").alias("other")), "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("heard"))
        lower = labels.join(heard, "node", "left").select("node", "component", F.least("component", F.coalesce("heard", "component")).alias("lower"))
        jump = labels.select(F.col("node").alias("lower"), F.col("component").alias("root"))
        after = cut(lower.join(jump, "lower", "left").select("node", F.col("component").alias("was"), F.least("lower", F.coalesce("root", "lower")).alias("component")))
        changed = after.where("was <> component").limit(1).count()
        labels = after.select("node", "component")
        if not changed:
            return labels
