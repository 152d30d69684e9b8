"""Line deduplication with a sharded minimal perfect hash (operator 3).

Pass 1 counts, for every distinct line key, the documents that have it, by a
128-bit hash. The hashes are dealt into shards; each shard is a minimal perfect
hash over its keys with two arrays beside it: a fingerprint and the count of each
key. Pass 2 sends the documents' hashes, not their lines, to the shards, where
they probe the arrays; only hits come back, to the texts that have any, and pass 3
drops the lines.

A key in very many documents would send all of them to one shard. Keys met in
more than 1 / HOT_PARTS of all places are at most HOT_PARTS; they are broadcast
and answered where the documents are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fenestra.llm.common import SPACE_BYTES, cut, mix64, row_key, sifted, stored

#: Keys of one shard, about; a shard is built and probed in one task.
SHARD_KEYS = 400_000
#: Distinct hashes that a task counts before it passes them on.
FLUSH_KEYS = 500_000
HOT_PARTS = 20_000
SEED = 7


# ---------------------------------------------------------------- minimal perfect hash


class PerfectHash:
    """Over distinct 64-bit keys: levels of bit arrays, in which keys that meet no other get a bit.

    A key's number is the number of bits set before its own, so the numbers of n keys are
    0 to n - 1. Keys that are left after MAX_LEVELS levels are kept sorted at the end.
    """

    GAMMA = 1.6
    MAX_LEVELS = 32

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.before, total = [], 0
        for bits in levels:
            ones = np.bitwise_count(bits).astype(np.int64)
            self.before.append(total + np.concatenate(([0], np.cumsum(ones)[:-1])))
            total += int(ones.sum())
        self.placed = total

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, levels = keys.astype(np.uint64), []
        while len(left) and len(levels) < cls.MAX_LEVELS:
            size = max(64, int(len(left) * cls.GAMMA + 63) // 64 * 64)
            at = cls._at(left, len(levels), size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[at.astype(np.int64)]]
        return cls(levels, np.sort(left))

    def __len__(self) -> int:
        return self.placed + len(self.rest)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of keys; of a key that was not built in, some number or -1."""
        keys = keys.astype(np.uint64)
        out, open_ = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            if not len(open_):
                break
            at = self._at(keys[open_], level, len(bits) * 64)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (bits[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(bits[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[open_[hit]] = (self.before[level][word] + below)[hit]
            open_ = open_[~hit]
        if len(open_) and len(self.rest):
            at = np.searchsorted(self.rest, keys[open_])
            same = (at < len(self.rest)) & (self.rest[np.minimum(at, len(self.rest) - 1)] == keys[open_])
            out[open_[same]] = self.placed + at[same]
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), len(self.rest), *map(len, self.levels)], dtype=np.int64)
        return b"".join([sizes.tobytes(), *(b.tobytes() for b in self.levels), self.rest.tobytes()])

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        n, n_rest = np.frombuffer(raw, np.int64, 2)
        sizes, at, levels = np.frombuffer(raw, np.int64, n, 16), 16 + 8 * int(n), []
        for size in sizes:
            levels.append(np.frombuffer(raw, np.uint64, size, at))
            at += 8 * int(size)
        return cls(levels, np.frombuffer(raw, np.uint64, n_rest, at))


# ---------------------------------------------------------------- lines and hashes


def line_keys(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text and their keys: stripped, A-Z lower-cased, in UTF-8."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    return lines, [x.strip(SPACE_BYTES).lower() for x in lines]


def key_hashes(keys: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the 128-bit hashes of the distinct keys with at least `least` code points."""
    if least <= 1:
        chosen = {k for k in keys if len(k) >= least}
    else:
        chosen = {k for k in keys if len(k) >= least and len(k.decode("utf-8", "surrogatepass")) >= least}
    raw = np.frombuffer(b"".join(xxhash.xxh3_128_digest(k, seed=SEED) for k in chosen), dtype=">u8").astype(np.uint64).reshape(-1, 2)
    return raw[:, 0], raw[:, 1]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def count_keys(docs: DataFrame, least: int) -> DataFrame:
    """a, b, n: documents by line hash, added up inside tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            pairs = np.concatenate(held)
            order = np.lexsort((pairs[:, 1], pairs[:, 0]))
            pairs = pairs[order]
            first = np.concatenate(([True], (pairs[1:] != pairs[:-1]).any(axis=1)))
            at = np.flatnonzero(first)
            n = np.diff(np.concatenate((at, [len(pairs)])))
            return pa.RecordBatch.from_arrays([_signed(pairs[at, 0]), _signed(pairs[at, 1]), pa.array(n.astype(np.int64))], names=["a", "b", "n"])

        for batch in batches:
            for text in batch.column(0):
                a, b = key_hashes(line_keys(text.as_py())[1], least)
                if len(a):
                    held.append(np.stack((a, b), axis=1))
                    size += len(a)
            if size > FLUSH_KEYS:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return docs.select("text").mapInArrow(run, "a bigint, b bigint, n bigint")


# ---------------------------------------------------------------- shards


def build_index(counts: DataFrame, shards: int) -> DataFrame:
    """shard, hash, marks, counts: of every shard its perfect hash, fingerprints and counts, as bytes.

    Counts of one key from several tasks are added here, so that the hashes move once.
    """

    def run(table: pa.Table) -> pa.Table:
        a, b = (table.column(c).to_numpy().view(np.uint64) for c in ("a", "b"))
        order = np.lexsort((b, a))
        a, b, n = a[order], b[order], table.column("n").to_numpy()[order]
        at = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        a, b, n = a[at], b[at], np.add.reduceat(n, at)
        keys = join_key(a, b)
        index = PerfectHash.build(keys)
        place = index.find(keys)
        marks, total = np.empty(len(keys), np.uint32), np.empty(len(keys), np.int64)
        marks[place], total[place] = fingerprint(a, b), n
        total = total.astype(np.uint32) if total.max() < 1 << 32 else total
        shard = int(table.column("shard")[0].as_py())
        return pa.table({"shard": pa.array([shard], pa.int32()), "hash": pa.array([index.to_bytes()], pa.binary()), "marks": pa.array([marks.tobytes()], pa.binary()), "counts": pa.array([total.tobytes()], pa.binary())})

    shard = F.pmod("a", F.lit(shards)).cast("int")
    return counts.select(shard.alias("shard"), "a", "b", "n").groupBy("shard").applyInArrow(run, "shard int, hash binary, marks binary, counts binary")


def join_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(a) ^ b


def fingerprint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (mix64(b ^ (a >> np.uint64(17))) >> np.uint64(32)).astype(np.uint32)


class Shard:
    def __init__(self, row: dict):
        self.hash = PerfectHash.from_bytes(row["hash"])
        self.marks = np.frombuffer(row["marks"], np.uint32)
        self.counts = np.frombuffer(row["counts"], np.uint32 if len(row["counts"]) == len(row["marks"]) else np.int64)

    def probe(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Counts of hashes; 0 where the fingerprint says that the key is another."""
        at = self.hash.find(join_key(a, b))
        known = at >= 0
        out = np.zeros(len(a), np.int64)
        known[known] = self.marks[at[known]] == fingerprint(a, b)[known]
        out[known] = self.counts[at[known]]
        return out


def hot_keys(counts: DataFrame, least_docs: int) -> np.ndarray:
    """Hashes (a, b) in at least `least_docs` documents and in more than 1 / HOT_PARTS of all places: at most HOT_PARTS."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = counts.groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= max(least_docs, total // HOT_PARTS + 1))
    rows = often.toArrow()
    return np.stack([rows.column(c).to_numpy().view(np.uint64) for c in ("a", "b")], axis=1) if rows.num_rows else np.empty((0, 2), np.uint64)


def _member(table: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which hashes are in a table sorted by its first column."""
    if not len(table):
        return np.zeros(len(a), bool)
    at = np.minimum(np.searchsorted(table[:, 0], a), len(table) - 1)
    return (table[at, 0] == a) & (table[at, 1] == b)


def frequent_hits(docs: DataFrame, index: DataFrame, hot: np.ndarray, shards: int, least: int, least_docs: int) -> DataFrame:
    """doc_id, row, gone (list of first hash halves, as bytes): keys of a document, hot ones apart, in `least_docs` documents or more."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        for batch in batches:
            found = [key_hashes(line_keys(t.as_py())[1], least) for t in batch.column(2)]
            kept = [~_member(hot, a, b) for a, b in found]
            n = [int(k.sum()) for k in kept]
            if not sum(n):
                continue
            of = np.repeat(np.arange(len(n)), n)
            a, b = (np.concatenate([x[i][k] for x, k in zip(found, kept, strict=True)]) for i in (0, 1))
            shard = pa.array((a.view(np.int64) % shards).astype(np.int32))
            yield pa.RecordBatch.from_arrays([shard, batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of)), _signed(a), _signed(b)], names=["shard", "doc_id", "row", "a", "b"])

    none = F.lit(None).cast("binary")
    asked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key().alias("row"), "text").mapInArrow(hashes, "shard int, doc_id bigint, row bigint, a bigint, b bigint")
    asked = asked.select("shard", F.lit(1).alias("kind"), "doc_id", "row", "a", "b", none.alias("hash"), none.alias("marks"), none.alias("counts"))
    empty = F.lit(None).cast("bigint")
    ready = index.select("shard", F.lit(0).alias("kind"), empty.alias("doc_id"), empty.alias("row"), empty.alias("a"), empty.alias("b"), "hash", "marks", "counts")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's arrays come first, then all that ask it, batch by batch."""
        shard = None
        for batch in batches:
            starts = np.flatnonzero(batch.column(1).to_numpy() == 0).tolist()
            for lo, hi in zip([0, *starts], [*starts, batch.num_rows], strict=True):
                if lo in starts:
                    shard = Shard({c: batch.column(c)[lo].as_py() for c in ("hash", "marks", "counts")})
                    lo += 1
                if lo < hi:
                    part = batch.slice(lo, hi - lo)
                    a, b = (part.column(c).to_numpy().view(np.uint64) for c in ("a", "b"))
                    often = pa.array(np.flatnonzero(shard.probe(a, b) >= least_docs))
                    yield pa.RecordBatch.from_arrays([part.column(c).take(often) for c in ("doc_id", "row", "a", "b")], names=["doc_id", "row", "a", "b"])

    met = ready.unionByName(asked).repartition(max(shards, 1), "shard").sortWithinPartitions("shard", "kind")
    hits = met.mapInArrow(probe, "doc_id bigint, row bigint, a bigint, b bigint")
    return hits.distinct().groupBy("doc_id", "row").agg(F.collect_list(F.struct("a", "b")).alias("gone"))


# ---------------------------------------------------------------- the operator


def dedup_lines(docs: DataFrame, *, least_chars: int = 1, least_docs: int = 10, keep: tuple[str, ...] = (), shard_keys: int = SHARD_KEYS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_lines, n_dropped, text (what stays), kept_sha256.

    A text is split at \\n; a null or empty text is one empty line. The key of a line
    is the line without outer white space, A-Z lower-cased. Keys of at least
    `least_chars` code points found in at least `least_docs` rows lose their lines
    everywhere. Rows that repeat count as documents. Columns in `keep` pass through.
    """
    counts = cut(count_keys(docs, least_chars))
    total = counts.count()
    shards = max(1, -(-total // shard_keys))
    hot = hot_keys(counts, least_docs)
    hot = hot[np.argsort(hot[:, 0])]
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    rest = [F.col("`" + c.replace("`", "``") + "`").alias(f"in_{i}") for i, c in enumerate(keep)]
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("doc_id").alias("id"), row_key().alias("row"), "text", *rest)
    none = F.lit(None).cast("array<struct<a:bigint,b:bigint>>")
    if total:
        index = cut(build_index(counts, shards))
        hits = stored(frequent_hits(docs, index, hot, shards, least_chars, least_docs), "op3-hits")
        # only texts that may have hits are shuffled to meet them
        maybe, clear = sifted(plain, hits)
        met = maybe.join(hits.withColumnsRenamed({"doc_id": "h_id", "row": "h_row"}), F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("row") == F.col("h_row")), "left").drop("h_id", "h_row")
        plain = met.unionByName(clear.withColumn("gone", none)).drop("row")
    else:
        plain = plain.drop("row").withColumn("gone", none)

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = {(int(a), int(b)) for a, b in shared.value}
        mask = (1 << 64) - 1
        for batch in batches:
            sizes, dropped, texts, shas = [], [], [], []
            for text, gone in zip(batch.column("text"), batch.column("gone"), strict=True):
                lines, keys = line_keys(text.as_py())
                often = hot if not gone.is_valid else hot | {(x["a"] & mask, x["b"] & mask) for x in gone.as_py()}
                stay = lines
                if often:
                    stay, known = [], {}
                    for line, key in zip(lines, keys, strict=True):
                        out = known.get(key)
                        if out is None:
                            h = xxhash.xxh3_128_intdigest(key, seed=SEED)
                            out = known[key] = (h >> 64, h & mask) in often
                        if not out:
                            stay.append(line)
                raw = b"\n".join(stay)
                sizes.append(len(lines))
                dropped.append(len(lines) - len(stay))
                texts.append(raw.decode("utf-8", "surrogatepass"))
                shas.append(hashlib.sha256(raw).hexdigest())
            rest = [batch.column(f"in_{i}") for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.string()), pa.array(shas, pa.string()), *rest], names=["doc_id", "n_lines", "n_dropped", "text", "kept_sha256", *(f"in_{i}" for i in range(len(keep)))])

    types = dict(docs.dtypes)
    schema = f"doc_id {types['doc_id']}, n_lines bigint, n_dropped bigint, text string, kept_sha256 string" + "".join(f", in_{i} {types[c]}" for i, c in enumerate(keep))
    out = plain.mapInArrow(drop, schema)
    return out.select("doc_id", "n_lines", "n_dropped", "text", "kept_sha256", *(F.col(f"in_{i}").alias(c) for i, c in enumerate(keep)))
