"""Exact n-gram Jaccard join by partitioning the universe (operator 5).

A document is the set of its distinct word shingles, as 64-bit hashes. Two sets of
sizes p and q that link differ in at most H = (p + q)(100 - t) / (100 + t) shingles,
t being the least similarity in percent. Sizes fall into bands so narrow that a set
can only link with sets of its own band and of the next lower one. In each band the
universe of shingles is dealt by hash into m segments. H differences can't reach
all of H + 1 segments: some segment of both sets is equal. So sets of a band are
indexed by the subsets that their segments hold, and larger ones probe them.

Where it is cheaper, a band has half as many segments and indexes, besides each
subset, the subsets with one shingle deleted: then some segment differs by one at
most. `Band.plan` compares both by the rows that they make and the chance meetings
that small subsets bring. Beyond what the pigeonhole needs, segments may be left
out; each set leaves out its smallest.

Sets that share a subset may link; buckets with the same sets are one. The parity of
the shingles, a sketch, bounds the difference of two sets from below. Inside each
bucket, sets whose sketches allow a link are joined to groups, of which only a
spanning forest leaves the task, so that rows grow with the sets and not with their
pairs. No link leaves its group. The sets of the groups are then verified in the
same way on the sets themselves. Large buckets and groups are dealt into blocks:
first each block alone, then those outside the largest component ask the other
blocks. Nothing that could link is left out, so components are exact.

Equal sets are one class from the start and are indexed once a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fenestra.llm.common import KeyFilter, Scratch, components, cut, mix64, stored, without

#: Bytes of text that are hashed at once, about.
PIECE = 1 << 20
#: Classes that a task remembers at once, to index equal sets once.
MEMORY = 300_000
#: Weight of the chance meetings of small subsets against a row of the index.
CHANCE = 75.0
#: Bits of a sketch for each shingle, about, and its size in words at least and at most.
SKETCH_BITS, SKETCH_LEAST, SKETCH_MOST = 4, 4, 4096
#: Rows of one bucket that a task holds as they come, rows of a block at most, about, and links that a task keeps back.
RUN_ROWS, BLOCK, FLUSH_PAIRS = 2_000_000, 4096, 200_000
#: Bytes of sketches and sets of a block at most, about.
TURN_BYTES = 8 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(20240501)
_VALUE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]  # A-Z as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0xD6E8FEB86659FD93
_MULT = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, base, np.uint64))), dtype=np.uint64)


class Shingler:
    """Distinct shingle hashes of texts, with numpy over many texts at once."""

    def __init__(self, words: int):
        self.words = words
        self.size = PIECE + 8192
        self.power = _powers(_BASE, self.size)
        self.inverse = _powers(pow(_BASE, -1, 1 << 64), self.size)

    def word_hashes(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and place of every word of a buffer, of which no word crosses a piece of `size` bytes unless it is longer."""
        hashes, places, at, n = [], [], 0, len(data)
        while at < n:
            end = min(n, at + PIECE)
            if end < n:
                back = np.flatnonzero(_SPACE[data[max(at, end - 4096) : end]])
                end = max(at, end - 4096) + int(back[-1]) + 1 if len(back) else self._word_end(data, end)
            piece = data[at:end]
            if len(piece) > self.size:
                self.size = len(piece)
                self.power = _powers(_BASE, self.size)
                self.inverse = _powers(pow(_BASE, -1, 1 << 64), self.size)
            space = _SPACE[piece]
            edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
            first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
            with np.errstate(over="ignore"):
                run = np.concatenate(([np.uint64(0)], np.cumsum(_VALUE[piece] * self.power[: len(piece)], dtype=np.uint64)))
                hashes.append(mix64((run[last] - run[first]) * self.inverse[first]))
            places.append(first + at)
            at = end
        if not hashes:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        return np.concatenate(hashes), np.concatenate(places)

    @staticmethod
    def _word_end(data: np.ndarray, at: int) -> int:
        while at < len(data):
            found = np.flatnonzero(_SPACE[data[at : at + PIECE]])
            if len(found):
                return at + int(found[0]) + 1
            at += PIECE
        return len(data)

    def sets(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Of each text the sorted distinct hashes of its shingles."""
        at = 0
        while at < len(texts):
            raw, size, upto = [], 0, at
            while upto < len(texts) and (upto == at or size < PIECE):
                raw.append((texts[upto] or "").encode("utf-8", "surrogatepass"))
                size += len(raw[-1]) + 1
                upto += 1
            data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
            hashes, places = self.word_hashes(data)
            ends = np.cumsum([len(r) + 1 for r in raw])
            cuts = [0, *np.searchsorted(places, ends).tolist()]
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield self._distinct(hashes[a:b])
            at = upto

    def _distinct(self, h: np.ndarray) -> np.ndarray:
        if not len(h):
            return h
        k = min(self.words, len(h))
        with np.errstate(over="ignore"):
            out = np.zeros(len(h) - k + 1, np.uint64)
            for i in range(k):
                out += h[i : i + len(out)] * _MULT[i % 64] + np.uint64(i // 64)
        return np.unique(mix64(out + np.uint64(k)))


# ---------------------------------------------------------------- bands


@dataclass(frozen=True)
class Band:
    """Sizes first to last; m segments of which each set may leave out `spare`; deletions: with one-deletion neighbourhoods."""

    number: int
    first: int
    last: int
    m: int
    spare: int
    deletions: bool

    @staticmethod
    def plan(number: int, first: int, last: int, percent: int) -> Band:
        """Of exact subsets and one-deletion neighbourhoods, what costs less."""
        most = (last + last * 100 // percent) * (100 - percent) // (100 + percent)
        own = 2 * last * (100 - percent) // (100 + percent)
        if most == 0:  # only equal sets link, and they are one class
            return Band(number, first, last, 0, 0, False)
        m, half, size = most + 1, -(-(most + 1) // 2), (first + last) / 2
        plain = m + CHANCE * m * exp(-size / m)
        deleted = half + size + CHANCE * half * exp(-size / half)
        if deleted < plain:
            return Band(number, first, last, half, 0, True)
        # enough to leave out the empty subsets, which chance alone would make many sets share;
        # a probe needs most + 1 + spare segments, two sets of the band own + 1 + 2 * spare
        spare = max((most - own) // 2, round(2 * m * exp(-size / m)))
        return Band(number, first, last, max(m + spare, own + 1 + 2 * spare), spare, False)


class Bands:
    def __init__(self, percent: int):
        self.percent, self.made, self.ends = percent, [], []

    def of(self, size: int) -> int:
        """The number of the band of a size."""
        while not self.ends or self.ends[-1] < size:
            first = self.ends[-1] + 1 if self.ends else 1
            last = max(first, first * 100 // self.percent)
            self.made.append(Band.plan(len(self.made), first, last, self.percent))
            self.ends.append(last)
        return int(np.searchsorted(self.ends, size))

    def rows(self, s: np.ndarray) -> np.ndarray:
        """Keys of a set, as indexed in its band and as it probes the band below: bits 1 up are the bucket, bit 0 says that it probes only."""
        size = len(s)
        number = self.of(size)
        out = [self._keys(s, self.made[number], None)]
        if number:
            below = self.made[number - 1]
            if below.last * 100 >= size * self.percent:
                differ = (size + below.last) * (100 - self.percent) // (100 + self.percent)
                out.append(self._keys(s, below, differ) | np.uint64(1))
        return np.concatenate(out)

    def _keys(self, s: np.ndarray, band: Band, differ: int | None) -> np.ndarray:
        if band.m == 0:
            return np.empty(0, np.uint64)
        with np.errstate(over="ignore"):
            salt = np.uint64(band.number + 1) * _ODD
            segment = (mix64(s + salt) % np.uint64(band.m)).astype(np.int64)
            value = mix64(s ^ salt)
            sums = np.zeros(band.m, np.uint64)
            np.add.at(sums, segment, value)
            place = (np.arange(band.m, dtype=np.uint64) + np.uint64(1)) * _ODD + salt
            if band.deletions:
                keys = np.concatenate((mix64(sums + place), mix64(sums[segment] - value + place[segment])))
            else:
                # an own set leaves out `spare`; a probe must use one more than may differ or be left out
                use = band.m - band.spare if differ is None else min(band.m, differ + 1 + band.spare)
                if use < band.m:
                    largest = np.argsort(-np.bincount(segment, minlength=band.m), kind="stable")[:use]
                    sums, place = sums[largest], place[largest]
                keys = mix64(sums + place)
        return keys & ~np.uint64(1)


def sketch(s: np.ndarray) -> np.ndarray:
    """Bits that say of how many shingles each, even or odd: sets differ in at least as many shingles as sketches in bits.

    Its size is a power of two of words, so that a longer one can be folded to a shorter one.
    """
    words = min(SKETCH_MOST, max(SKETCH_LEAST, 1 << (len(s) * SKETCH_BITS // 64).bit_length()))
    bit = (mix64(s + np.uint64(99)) % np.uint64(64 * words)).astype(np.int64)
    return np.packbits(np.bincount(bit, minlength=64 * words).astype(np.uint8) & 1, bitorder="little").view(np.uint64)


def fold(x: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_xor.reduce(x.reshape(-1, words), axis=0)


def class_of(s: np.ndarray) -> int:
    """The 64-bit number of a class of equal sets, as a signed integer."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes(), seed=11)).view(np.int64))


# ---------------------------------------------------------------- passes over the texts


def _summaries(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, row, n, class: one row per row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            n, who = [], []
            for s in shingler.sets(batch.column(2).to_pylist()):
                n.append(len(s))
                who.append(class_of(s) if len(s) else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(who, pa.int64())], names=["doc_id", "row", "n", "class"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"), "text").mapInArrow(run, "doc_id bigint, row bigint, n bigint, class bigint")


def _index(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """k, class: the rows of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, bands, met = Shingler(words), Bands(percent), set()
        for batch in batches:
            keys, who, size = [], [], 0
            for s in shingler.sets(batch.column(0).to_pylist()):
                if not len(s) or (c := class_of(s)) in met:
                    continue
                met.add(c)
                keys.append(bands.rows(s))
                who.append(np.full(len(keys[-1]), c, np.int64))
                size += len(keys[-1])
                if size > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(who))], names=["k", "class"])
                    keys, who, size = [], [], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(who))], names=["k", "class"])
            if len(met) > MEMORY:
                met.clear()

    return docs.select("text").mapInArrow(run, "k bigint, class bigint")


def _sets_of(docs: DataFrame, words: int, wanted: DataFrame, whole: bool) -> DataFrame:
    """class, n, sketch, shingles: the sets of the classes in `wanted` (class), and perhaps of a few others. Shingles are null unless `whole`."""
    shared = docs.sparkSession.sparkContext.broadcast(KeyFilter.build(wanted).words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, test, met = Shingler(words), KeyFilter(shared.value), set()
        for batch in batches:
            out, size = [], 0
            for s in shingler.sets(batch.column(0).to_pylist()):
                if not len(s) or (c := class_of(s)) in met or c not in test:
                    continue
                met.add(c)
                out.append((c, len(s), sketch(s).tobytes(), s.tobytes() if whole else None))
                size += 8 * len(s)
                if size > 8 << 20:
                    yield _columns(out)
                    out, size = [], 0
            if out:
                yield _columns(out)
            if len(met) > MEMORY:
                met.clear()

    found = docs.select("text").mapInArrow(run, "class bigint, n bigint, sketch binary, shingles binary")
    return found.groupBy("class").agg(*(F.first(c).alias(c) for c in ("n", "sketch", "shingles")))


def _columns(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"class": pa.int64(), "n": pa.int64(), "sketch": pa.binary(), "shingles": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


# ---------------------------------------------------------------- buckets


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(k, class) of rows sorted by k, in pieces that end where a bucket ends; a bucket of more than RUN_ROWS rows comes in pieces of its own, marked True."""
    held, size, large = [], 0, None

    def out() -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        k, c = (np.concatenate([x[i] for x in held]) for i in (0, 1))
        cut = int(np.searchsorted(k >> 1, large, "right")) if large is not None else 0
        if cut:
            yield k[:cut], c[:cut], True
        if cut < len(k):
            yield k[cut:], c[cut:], False

    for batch in batches:
        k, c = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(k):
            continue
        last = k[-1] >> 1
        end = int(np.searchsorted(k >> 1, last))  # where the batch's last bucket starts
        if end:
            held.append((k[:end], c[:end]))
        if held and (end or held[-1][0][-1] >> 1 != last):
            yield from out()
            held, size = [], 0
        if large != last:
            large = None
        held.append((k[end:], c[end:]))
        size += len(k) - end
        if size > RUN_ROWS:
            large = last
            yield from out()
            held, size = [], 0
    if held:
        yield from out()


def _starts(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where buckets start, and their sizes."""
    start = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    return start, np.diff(np.concatenate((start, [len(bucket)])))


def _shared_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of buckets with two classes or more, of which one is indexed; each class once.

    The new key of a bucket is a hash of its rows: buckets with the same rows become
    equal. A bucket too large to be held keeps its key and all its rows.
    """
    for k, c, part in _runs(batches):
        order = np.lexsort((k & 1, c, k >> 1))
        k, c = k[order], c[order]
        bucket = k >> 1
        once = np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (c[1:] != c[:-1])))
        probe, c, bucket = k[once] & 1, c[once], bucket[once]
        if part:
            yield pa.RecordBatch.from_arrays([pa.array(k[once]), pa.array(c)], names=["k", "class"])
            continue
        start, size = _starts(bucket)
        indexed = np.add.reduceat(1 - probe, start)
        with np.errstate(over="ignore"):
            rows_hash = np.add.reduceat(mix64(c.view(np.uint64) * np.uint64(2) + probe.view(np.uint64)) ^ mix64(c.view(np.uint64)), start)
        key = np.repeat(mix64(rows_hash) & ~np.uint64(1), size).view(np.int64) | probe
        keep = np.repeat((size > 1) & (indexed > 0), size)
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(c[keep])], names=["k", "class"])


def _by_bucket(rows: DataFrame) -> DataFrame:
    return rows.repartition(F.shiftright("k", 1)).sortWithinPartitions("k")


def _dealt(rows: DataFrame, buckets: DataFrame, parts: DataFrame | None) -> DataFrame:
    """bucket, block, role, probe, class, component: the `rows` (bucket, probe, class) of `buckets` (bucket, blocks), dealt into blocks.

    Each row lies in one block of its bucket, with role 0 or 1. Without `parts` (node, component)
    that is all. With them, rows outside their bucket's largest component (role 1) come to
    all other blocks too, to ask there (role 2), and buckets of one component are left out.
    """
    own = F.pmod(F.xxhash64("class", F.lit("block")), F.col("blocks")).cast("int")
    met = rows.join(buckets, "bucket").withColumn("own", own)
    if parts is None:
        return met.select("bucket", F.col("own").alias("block"), F.lit(0).alias("role"), "probe", "class", F.col("class").alias("component"))
    met = met.join(parts.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    sizes = met.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    mains = sizes.groupBy("bucket").agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.count("*").alias("parts")).where("parts > 1")
    met = met.join(mains, "bucket").withColumn("asks", F.col("component") != F.col("main"))
    met = met.withColumn("block", F.explode(F.when(F.col("asks"), F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).otherwise(F.array("own"))))
    return met.select("bucket", "block", F.when(~F.col("asks"), 0).when(F.col("block") == F.col("own"), 1).otherwise(2).alias("role"), "probe", "class", "component")


def _links(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _pairs(mode: str, percent: int):
    """(a, b): links that join the components of a block's classes, as few as do so. Rows come sorted by bucket, block and role.

    Classes link if their sizes and sketches allow it and, where rows have them, their
    shingles do. mode own: all rows of a block are compared. mode all: the block (roles 0
    and 1) is held, and the asking rows (role 2) run past it. Classes that links have already
    joined are not compared again; all others are.
    """

    class Block:
        def __init__(self, rows: list[tuple]):
            self.role, self.probe, self.c, self.root, self.n = (np.array([r[i] for r in rows], np.int64) for i in range(5))
            self.shingles = [r[6] for r in rows]
            self.words = np.array([len(r[5]) // 8 for r in rows])
            self.place = np.empty(len(rows), np.int64)  # among the rows with a sketch of that size
            self.bits: dict[tuple[int, int], np.ndarray] = {}
            for words in np.unique(self.words).tolist():
                at = np.flatnonzero(self.words == words)
                self.place[at] = np.arange(len(at))
                self.bits[words, words] = np.stack([np.frombuffer(rows[i][5], np.uint64) for i in at])
            self.joined: dict[int, int] = {}

        def folded(self, words: int, to: int) -> np.ndarray:
            if (words, to) not in self.bits:
                self.bits[words, to] = np.bitwise_xor.reduce(self.bits[words, words].reshape(-1, words // to, to), axis=1)
            return self.bits[words, to]

        def near(self, at: np.ndarray, n: int, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
            """Those of the rows `at` whose sketches allow a link, nearest first if shingles decide."""
            asked, far = np.frombuffer(raw, np.uint64), np.empty(len(at), np.int64)
            for words in np.unique(self.words[at]).tolist():
                these, to = self.words[at] == words, min(words, len(asked))
                far[these] = np.bitwise_count(self.folded(words, to)[self.place[at[these]]] ^ fold(asked, to)).sum(axis=1)
            close = far <= (n + self.n[at]) * (100 - percent) // (100 + percent)
            return at[close], far[close]

        def ask(self, row: tuple, after: int) -> list[tuple[int, int]]:
            """New links of the row with classes of the block from place `after`."""
            _, probe, c, part, n, raw, shingles = row
            while part in self.joined:
                part = self.joined[part]
            low = self.n[after:]
            fits = (self.root[after:] != part) & (self.probe[after:] + probe < 2) & (np.minimum(n, low) * 100 >= np.maximum(n, low) * percent)
            if mode == "all":  # of two rows that both ask, one does
                fits &= (self.role == 0) | (self.c > c)
            at = np.flatnonzero(fits) + after
            if not len(at):
                return []
            at, far = self.near(at, n, raw)
            if shingles is None:
                at = at[np.unique(self.root[at], return_index=True)[1]]
            else:
                at = at[np.argsort(far, kind="stable")]
            out = []
            for j in at.tolist():
                other = int(self.root[j])
                if other != part and (shingles is None or _links(np.frombuffer(shingles, np.uint64), np.frombuffer(self.shingles[j], np.uint64), percent)):
                    out.append((c, int(self.c[j])))
                    self.root[self.root == other] = part
                    self.joined[other] = part
            return out

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int]]]:
        key, rows, block = None, [], None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("bucket", "block", "role", "probe", "class", "component", "n", "sketch", "shingles")]
            for row in zip(*columns, strict=True):
                if row[:2] != key:
                    if mode == "own" and len(rows) > 1:
                        yield from alone(rows)
                    key, rows, block = row[:2], [], None
                if row[2] < 2:
                    rows.append(row[2:])
                elif rows:
                    block = block or Block(rows)
                    yield block.ask(row[2:], 0)
        if mode == "own" and len(rows) > 1:
            yield from alone(rows)

    def alone(rows: list[tuple]) -> Iterator[list[tuple[int, int]]]:
        block = Block(rows)
        for i, row in enumerate(rows[:-1]):
            yield block.ask(row, i + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []

        def out() -> pa.RecordBatch:
            a, b = np.array(found, np.int64).T
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for links in blocks(batches):
            found += links
            if len(found) > FLUSH_PAIRS:
                yield out()
                found = []
        if found:
            yield out()

    return run


def _joined(rows: DataFrame, sets: DataFrame, percent: int, space: Scratch) -> DataFrame | None:
    """node, component: classes of `rows` (bucket, probe, class) that link, inside a bucket, with others; None if none does.

    `sets` (class, n, sketch, shingles) has what is compared: sketches alone, where shingles are null.
    """
    weight = sets.select("class", (F.length("sketch") + F.coalesce(F.length("shingles"), F.lit(0))).alias("bytes"))
    sizes = rows.join(weight, "class").groupBy("bucket").agg(F.count("*").alias("size"), F.sum("bytes").alias("bytes"), F.min("probe").alias("probe"))
    blocks = F.greatest(F.expr(f"(size - 1) div {BLOCK}"), F.least(F.expr(f"(bytes - 1) div {TURN_BYTES}"), F.col("size") - 1)) + 1
    buckets = space.put(sizes.where("size > 1 AND probe = 0").select("bucket", blocks.alias("blocks")))
    parts = None
    for mode in ("own", "all"):
        if mode == "all":  # what lies in one block has been compared
            buckets = buckets.where("blocks > 1")
            if not buckets.limit(1).count():
                break
            if parts is None:
                parts = rows.select(F.col("class").alias("node"), F.col("class").alias("component")).where("false")
        dealt = _dealt(rows, buckets, parts if mode == "all" else None).join(sets, "class")
        links = dealt.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "role").mapInArrow(_pairs(mode, percent), "a bigint, b bigint")
        links = space.put(links.distinct())
        if links.limit(1).count():
            parts = components(links) if mode == "own" else _merged(parts, links)
    return parts


def _merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """The components after more links: only the components that these meet are looked at again."""
    label = lambda x: parts.select(F.col("node").alias(x), F.col("component").alias(f"{x}_part"))
    met = links.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("a_part", "a").alias("a"), F.coalesce("b_part", "b").alias("b"))
    joined = components(cut(met)).select(F.col("node").alias("component"), F.col("component").alias("joined"))
    # a class without links before is a component of its own
    nodes = parts.unionByName(joined.select(F.col("component").alias("node"), "component").join(parts.select("node"), "node", "left_anti"))
    return cut(nodes.join(joined, "component", "left").select("node", F.coalesce("joined", "component").alias("component")))


def _linked(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """node, component: classes that link with others."""
    space = Scratch(docs.sparkSession, "op5")
    shared = space.put(_by_bucket(_index(docs, words, percent)).mapInArrow(_shared_buckets, "k bigint, class bigint").distinct())
    rows = shared.select(F.shiftright("k", 1).alias("bucket"), F.col("k").bitwiseAND(1).cast("int").alias("probe"), "class")
    sketches = space.put(_sets_of(docs, words, shared.select("class").distinct(), False))
    parts = groups = _joined(rows, sketches, percent, space)
    if groups is not None:
        sets = space.put(_sets_of(docs, words, groups.select("node"), True))
        parts = _joined(groups.select(F.col("component").alias("bucket"), F.lit(0).alias("probe"), F.col("node").alias("class")), sets, percent, space)
    space.drop()
    if parts is None:
        return docs.sparkSession.createDataFrame([], "node bigint, component bigint")
    return parts


def near_groups(docs: DataFrame, *, words: int = 5, percent: int = 80, space: Scratch | None = None) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, row,
    kept (it is the first row of its group).

    Words are runs of anything but white space, A-Z lower-cased; shingles are
    `words` consecutive ones; a text with fewer is one shingle. Documents link when
    100 * intersection >= percent * union of their sets, and component_id is the
    smallest doc_id that links reach, itself included. A null text and one without
    words have no shingles and link with nothing; rows with a null doc_id link, but
    give no id unless alone (then null). Rows that repeat are equal sets. Extra
    columns are ignored. The result reads tables in `space`.
    """
    space = space or Scratch(docs.sparkSession, "op5-groups")
    rows = space.put(_summaries(docs, words))
    parts = _linked(docs, words, percent)
    # first by class, so that what meets in one component is a row a class, and then by component
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row"))
    classes = rows.where("n > 0").groupBy("class").agg(first.alias("first")).join(parts.withColumnRenamed("node", "class"), "class", "left")
    classes = space.put(classes.select("class", F.coalesce("component", "class").alias("component"), F.col("component").isNotNull().alias("linked"), "first"))
    least = space.put(classes.where("linked").groupBy("component").agg(F.min("first").alias("least")))
    named = space.put(classes.join(least, "component", "left").select("class", F.coalesce("least", "first").alias("best")))
    # a row without shingles is alone
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "row", F.lit(True).alias("kept"))
    placed = rows.where("n > 0").join(named, "class")
    kept = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("row") == F.col("best.row"))
    return placed.select("doc_id", F.col("n").alias("n_shingles"), F.col("best.doc_id").alias("component_id"), "row", kept.alias("kept")).union(alone)


def drop_near(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, with all their columns, but one of each group of linked documents: that with the smallest doc_id.

    Of equal texts, too, one row stays, also where the doc_id is the same; documents
    without words all stay.
    """
    space = Scratch(docs.sparkSession, "op5-groups")
    groups = near_groups(docs, words=words, percent=percent, space=space)
    fate = groups.groupBy("doc_id", "row").agg(F.when(~F.first("kept"), 0).when(F.first("n_shingles") > 0, 1).otherwise(F.count("*")).alias("stay"), F.count("*").alias("all")).where("stay < all")
    dropped = stored(fate.select("doc_id", "row", "stay"), "op5-dropped")
    space.drop()
    return without(docs, dropped)
