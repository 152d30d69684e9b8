"""Exact deduplication with streaming state (operator 7).

One pass over the documents writes a narrow table of digests, with the place
(file and row) of each text. A Structured Streaming query reads what is new in it
and aggregates by digest in RocksDB state, on disk and without a watermark or
expiry: per digest it retains the row that stays (its identifier and content
locator) and the size of the group. The query's checkpoint stands in the ledger's
folder, so that a later delivery finds the copies of all earlier ones.

That texts of an equal digest are equal is checked on their full bytes wherever a
digest was hit more than once; earlier texts are read by their locators. Texts that
fail are told apart by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenestra.llm.common import SPACE_BYTES, TIDY, KeyFilter, Scratch, row_key, scratch, settings, stored, without

#: Digest files that one micro-batch reads at most.
FILES_PER_BATCH = 512
#: Texts that a task remembers at once while it checks bytes.
CHECK_BYTES = 48 << 20

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "192",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # a partition's store is closed with its task, so memory follows the running tasks, not the partitions
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
ROWS = "doc_id bigint, row bigint, chars bigint, file string, at bigint, digest binary, sha binary"
BEST = "struct<less:bigint,without:boolean,doc_id:bigint,row:bigint,file:string,at:bigint>"


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, SPACE_BYTES)


def located(docs: DataFrame) -> DataFrame:
    """doc_id, row (key of the row's text), chars, file, at, text: the place is null where `docs` is no plain scan of files."""
    columns = [F.col("doc_id").cast("bigint").alias("doc_id"), row_key().alias("row"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("chars")]
    try:
        place = docs.metadataColumn("_metadata")
        return docs.select(*columns, place["file_path"].alias("file"), place["row_index"].alias("at"), "text")
    except AnalysisException:
        return docs.select(*columns, F.lit(None).cast("string").alias("file"), F.lit(None).cast("bigint").alias("at"), "text")


def digests(docs: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """What `located` has, but the text; digest, and sha, of which the digest is the beginning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashlib.sha256(normalised(t.as_py())).digest() for t in batch.column(5)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array([d[:digest_bytes] for d in found], pa.binary()), pa.array(found, pa.binary())], names=["doc_id", "row", "chars", "file", "at", "digest", "sha"])

    return located(docs).mapInArrow(run, ROWS)


def _best():
    """Orders rows by what stays: most code points, then smallest doc_id, nulls last."""
    return F.min(F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("without"), "doc_id", "row", "file", "at"))


class Ledger:
    """All texts delivered so far, in a folder that all executors share.

    digests/delivery=N: the rows of each delivery; state/part=N: what batch N of the
    stream changed; checkpoint: the stream's offsets and RocksDB state. A batch that an
    executor or the driver lost is run again from state and overwrites its own part.
    """

    def __init__(self, spark: SparkSession, home: str, *, digest_bytes: int = 32, files_per_batch: int = FILES_PER_BATCH):
        self.spark, self.home, self.digest_bytes, self.files_per_batch = spark, home, digest_bytes, files_per_batch
        spark.createDataFrame([], f"digest binary, best {BEST}, n bigint").write.mode("ignore").parquet(f"{home}/state/part=-1")

    def rows(self) -> DataFrame:
        """Every row delivered, with its delivery."""
        return self.spark.read.schema(f"{ROWS}, delivery int").parquet(f"{self.home}/digests")

    def state(self) -> DataFrame:
        """digest, best, n: the last of each digest."""
        parts = self.spark.read.schema(f"digest binary, best {BEST}, n bigint, part int").parquet(f"{self.home}/state")
        if parts.agg(F.max("part")).first()[0] in (None, 0):  # there was one batch: each digest is there once
            return parts.drop("part")
        return parts.groupBy("digest").agg(F.max_by(F.struct("best", "n"), "part").alias("last")).select("digest", "last.best", "last.n")

    def stream(self) -> None:
        """Runs what is new in the digest table through the state."""

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{self.home}/state/part={number}")

        with settings(self.spark, STATE):
            new = self.spark.readStream.schema(f"{ROWS}, delivery int").option("maxFilesPerTrigger", self.files_per_batch).parquet(f"{self.home}/digests")
            grouped = new.groupBy("digest").agg(_best().alias("best"), F.count("*").alias("n"))
            grouped.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{self.home}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    def deliver(self, docs: DataFrame, number: int = 0) -> DataFrame:
        """Adds `docs` as delivery `number` and gives the groups of its rows, as `exact_groups` has them, among all delivered.

        A number that was delivered before is an error.
        """
        with settings(self.spark, TIDY):
            digests(docs, self.digest_bytes).write.parquet(f"{self.home}/digests/delivery={number}")
        self.stream()
        rows, state = self.rows(), self.state()
        wrong = stored(colliding(self.texts(docs, number, state), state, self.digest_bytes), "op7-unlike")
        own = rows.where(F.col("delivery") == number)
        if not wrong.limit(1).count():
            return _grouped(own.join(state, "digest"), own)
        # unlike texts share a digest: the bytes of all its texts decide
        texts = self.texts(docs, number, wrong.withColumn("n", F.lit(2)))
        split = _with_bytes(texts, self.digest_bytes).join(wrong, "digest")
        told = split.join(split.groupBy("bytes").agg(_best().alias("best"), F.count("*").alias("n")), "bytes").where("own").drop("bytes", "own")
        return _grouped(own.join(wrong, "digest", "left_anti").join(state, "digest").select(*told.columns).union(told), own)

    def texts(self, docs: DataFrame, number: int, hit: DataFrame) -> DataFrame:
        """The rows of `docs` with their texts, and earlier rows of the digests in `hit` (digest, n) that have more than one, read by their locators."""
        now = located(docs).withColumn("own", F.lit(True))
        before = self.rows().where(F.col("delivery") != number)
        if not before.limit(1).count():
            return now
        asked = before.join(hit.where("n > 1"), "digest", "left_semi")
        files = [r["file"] for r in asked.select("file").distinct().collect()]  # names of files, not of rows
        if None in files:
            raise ValueError("earlier deliveries have no locators: deliver plain scans of files")
        if not files:
            return now
        there = self.spark.read.parquet(*files)
        found = there.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"), "text")
        return now.union(asked.join(found, ["file", "at"]).select(*now.columns[:-1], F.lit(False).alias("own")))


def _with_bytes(texts: DataFrame, digest_bytes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [normalised(t.as_py()) for t in batch.column(5)]
            sha = [hashlib.sha256(x).digest() for x in raw]
            columns = [*(batch.column(i) for i in range(5)), batch.column(6), pa.array([x[:digest_bytes] for x in sha], pa.binary()), pa.array(sha, pa.binary()), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "chars", "file", "at", "own", "digest", "sha", "bytes"])

    return texts.mapInArrow(run, "doc_id bigint, row bigint, chars bigint, file string, at bigint, own boolean, digest binary, sha binary, bytes binary")


def colliding(texts: DataFrame, state: DataFrame, digest_bytes: int) -> DataFrame:
    """Digests with unlike texts. All bytes of all rows of a digest met more than once are compared.

    Inside a task, each text is compared with the first of its digest; between
    tasks, one text per task and digest is. So a large group moves little.
    """
    many = KeyFilter.build(state.where("n > 1").select(F.xxhash64("digest").alias("key")))
    shared = texts.sparkSession.sparkContext.broadcast(many.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        many, met, held = KeyFilter(shared.value), {}, 0

        def out(digests: list[bytes], texts: list[bytes | None]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(texts, pa.binary())], names=["digest", "bytes"])

        for batch in batches:
            texts = [normalised(t.as_py()) for t in batch.column(0)]
            marks = [hashlib.sha256(t).digest()[:digest_bytes] for t in texts]
            keys = [xxhash.xxh64_intdigest(d, seed=42) for d in marks]  # as Spark's xxhash64 of a binary column
            wrong = set()
            if texts:
                import numpy as np

                for i in np.flatnonzero(many.test(np.array(keys, dtype=np.uint64))):
                    first = met.setdefault(marks[i], texts[i])
                    if first is texts[i]:
                        held += len(first) + 100
                    elif first != texts[i]:
                        wrong.add(marks[i])
            if wrong:
                yield out(sorted(wrong), [None] * len(wrong))
            if held > CHECK_BYTES:
                yield out(list(met), list(met.values()))
                met, held = {}, 0
        if met:
            yield out(list(met), list(met.values()))

    checked = texts.select("text").mapInArrow(run, "digest binary, bytes binary")
    compared = checked.groupBy("digest").agg(F.max(F.col("bytes").isNull()).alias("wrong"), F.min("bytes").alias("a"), F.max("bytes").alias("b"))
    return compared.where("wrong OR a <> b").select("digest")


def _grouped(joined: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, row, keep_row, of `rows` joined with the state of their group."""
    same = (F.col("doc_id").eqNullSafe(F.col("best.doc_id"))) & (F.col("row") == F.col("best.row"))
    if rows.groupBy("doc_id", "row").count().where("count > 1").limit(1).count():
        # rows with the same id and text are counted, so that no task has to hold them, and dealt out again: the first is kept
        counted = joined.groupBy("digest", "sha", "doc_id", "row", "best", "n").count()
        joined = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("count"))))
        same = same & (F.col("copy") == 1)
    return joined.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), same.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "row", F.col("best.row").alias("keep_row"))


def exact_groups(docs: DataFrame, *, digest_bytes: int = 32, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """One row per row of `docs` (doc_id, text), dropped ones too: a ledger with one delivery.

    doc_id, keep_id, group_size, kept, text_sha256, row, keep_row. Texts are equal
    when identical without white space; a null text counts as empty. Of equal texts
    the one with the most code points, then the smallest doc_id stays, a null doc_id
    last. Rows that repeat a doc_id with the same text count as copies, of which
    one is kept; which of wholly equal rows does not matter. An empty table gives an
    empty result; other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    return Ledger(spark, scratch(spark, "op7"), digest_bytes=digest_bytes, files_per_batch=files_per_batch).deliver(docs)


def drop_copies(docs: DataFrame, *, digest_bytes: int = 32) -> DataFrame:
    """The rows of `docs`, with all their columns, that stay; what `exact_groups` drops goes, and no text is shuffled for that but of rows with such ids."""
    space = Scratch(docs.sparkSession, "op7")
    groups = Ledger(docs.sparkSession, space.home, digest_bytes=digest_bytes).deliver(docs)
    # rows may repeat both id and text: of those, one row stays if any does
    fate = groups.groupBy("doc_id", "row").agg(F.count_if("kept").alias("stay"), F.count("*").alias("all")).where("stay < all")
    dropped = stored(fate.select("doc_id", "row", "stay"), "op7-dropped")
    space.drop()
    return without(docs, dropped)
