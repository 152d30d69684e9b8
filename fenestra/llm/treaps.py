"""Ranked lexical search over inverted treaps (operator 12).

Documents are indexed in segments of bounded size. In a segment every term has a
treap: in doc order it is a search tree, by impact (what the term adds to a document's
score, but for the term's weight) a heap. A query goes down the treaps of all its
terms at once: a stretch of documents has for each term the root of what the treap
holds there, and the sum of the roots' impacts bounds what any document in it can
reach. Stretches whose bound can't enter the best k are left out with all below them;
others are split at the document with the largest root, which is scored. Short
stretches are scored as a whole.

All open stretches of all queries of a block go down together, a level at a time. What
a task has found in its segments so far is the bar for the next; the best k of
all tasks meet in one ranking.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fenestra.llm.common import ALNUM_TABLE, TIDY, KeyFilter, Scratch, settings

#: Documents and postings of a segment, at most; a single longer document is a segment of its own.
SEGMENT_DOCS, SEGMENT_POSTINGS = 1 << 16, 1_000_000
#: Terms of one block of queries, about; a block is what goes to all tasks at once.
BLOCK_TERMS = 20_000
#: Stands for a null doc_id.
NO_ID = -(1 << 63)
#: Documents of a stretch that is scored as a whole.
SHORT = 64

SEGMENT = "doc_ids binary, terms array<string>, sizes array<bigint>, docs binary, impacts binary, left binary, right binary"


def words_of(text: str | None) -> list[bytes]:
    """Maximal stretches of ASCII letters, digits and characters beyond ASCII; only A-Z are lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(ALNUM_TABLE).split() if text else []


def impact(tf: np.ndarray, n: np.ndarray, docs: int, words: int) -> np.ndarray:
    """What a term adds to a score, but for its weight: (10^9 tf) div (1000 tf + 8 m), m = 10 + (90 n docs) div words."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def treaps(impacts: np.ndarray, docs: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Left and right children (places in the own list, -1 for none) of the treaps of lists that follow each other.

    Lists are in doc order. Equal impacts are ordered by a hash of the document, so
    that they make no long chain.
    """
    keys = (impacts * (1 << 20) + (docs * 0x9E3779B1 >> 7) % (1 << 20)).tolist()
    left, right, at = [-1] * len(keys), [-1] * len(keys), 0
    for size in sizes.tolist():
        spine: list[int] = []
        for i in range(at, at + size):
            key, last = keys[i], -1
            while spine and keys[spine[-1]] < key:
                last = spine.pop()
            if last >= 0:
                left[i] = last - at
            if spine:
                right[spine[-1]] = i - at
            spine.append(i)
        at += size
    return np.array(left, dtype=np.int32), np.array(right, dtype=np.int32)


def word_totals(docs: DataFrame) -> tuple[int, int]:
    """Documents with a word, and words of all of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = words = 0
        for batch in batches:
            for text in batch.column(0):
                k = len(words_of(text.as_py()))
                n, words = n + (k > 0), words + k
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([words], pa.int64())], names=["n", "words"])

    with settings(docs.sparkSession, TIDY):
        r = docs.select(F.col("text").cast("string")).mapInArrow(count, "n bigint, words bigint").agg(F.sum("n"), F.sum("words")).first()
    return r[0] or 0, r[1] or 0


def segments(docs: DataFrame, totals: tuple[int, int], wanted: KeyFilter | None = None) -> DataFrame:
    """The index, a row for each segment: ids of its documents, its terms, and their treaps one after another.

    Arrays are little-endian: doc_ids of 64 bits (null is NO_ID), docs (places in
    doc_ids), impacts and children (places in the term's own list, -1 for none) of 32.
    With `wanted`, terms that it surely does not hold are not indexed.
    """
    n_docs, n_words = totals
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(wanted)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, known = shared.value, {}
        ids: list[int] = []
        codes: dict[bytes, int] = {}
        postings: list[tuple[np.ndarray, np.ndarray, int]] = []
        n_postings = 0

        def flush() -> pa.RecordBatch:
            code, tf = (np.concatenate([p[k] for p in postings]) for k in (0, 1))
            each = [len(p[0]) for p in postings]
            order = np.argsort(code, kind="stable")
            at, n, tf = np.repeat(np.arange(len(ids)), each)[order], np.repeat([p[2] for p in postings], each)[order], tf[order]
            sizes, own = np.bincount(code, minlength=len(codes)), impact(tf, n, n_docs, n_words)
            row = [np.array(ids, dtype=np.int64).tobytes(), [t.decode("utf-8", "surrogatepass") for t in codes], sizes.tolist(), *(v.astype(np.int32).tobytes() for v in (at, own, *treaps(own, at, sizes)))]
            kinds = [pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64()), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in SEGMENT.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                words = words_of(text.as_py())
                if not words:
                    continue
                own = Counter(words)
                if wanted is not None:
                    if fresh := [w for w in own if w not in known]:
                        if len(known) > 500_000:
                            known.clear()
                            fresh = list(own)
                        known.update(zip(fresh, wanted.test(term_keys(fresh)).tolist(), strict=True))
                    own = {w: tf for w, tf in own.items() if known[w]}
                ids.append(NO_ID if (i := doc_id.as_py()) is None else i)
                postings.append((np.array([codes.setdefault(w, len(codes)) for w in own], dtype=np.int64), np.fromiter(own.values(), dtype=np.int64, count=len(own)), len(words)))
                n_postings += len(own)
                if len(ids) >= SEGMENT_DOCS or n_postings >= SEGMENT_POSTINGS:
                    yield flush()
                    ids, codes, postings, n_postings = [], {}, [], 0
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(index, SEGMENT)


def term_keys(terms: list[bytes]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(t) for t in terms], dtype=np.uint64).view(np.int64)


def query_terms(queries: DataFrame) -> DataFrame:
    """(item_id, term), each pair once."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, terms = [], []
            for i, text in enumerate(batch.column(1)):
                own = dict.fromkeys(words_of(text.as_py()))
                rows += [i] * len(own)
                terms += [w.decode("utf-8", "surrogatepass") for w in own]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(terms, pa.string())], names=["item_id", "term"])

    kind = queries.schema["item_id"].dataType.simpleString()
    return queries.select("item_id", F.col("text").cast("string")).mapInArrow(split, f"item_id {kind}, term string").distinct()


def ragged(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begins[0], begins[0] + 1, ... counts[0] of them, then from begins[1], ..."""
    ends = np.cumsum(counts)
    return np.repeat(begins - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


class Best:
    """The k best (score, doc_id) of each query so far; of equal scores the smaller doc_id, null last."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.query, self.score, self.doc = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.bar = np.ones(queries, dtype=np.int64)  # a score below can't enter

    def add(self, query: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        good = score >= self.bar[query]
        if not good.any():
            return
        query, score, doc = np.concatenate([self.query, query[good]]), np.concatenate([self.score, score[good]]), np.concatenate([self.doc, doc[good]])
        order = np.lexsort((doc, doc == NO_ID, -score, query))
        query, score, doc = query[order], score[order], doc[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        keep = rank < self.k
        self.query, self.score, self.doc = query[keep], score[keep], doc[keep]
        last = rank[keep] == self.k - 1
        self.bar[self.query[last]] = self.score[last]


class Segment:
    """One row of the index, opened for a block of queries; only the block's terms are kept."""

    def __init__(self, row: dict, codes: dict[str, int]):
        self.doc_ids = np.frombuffer(row["doc_ids"], dtype=np.int64)
        sizes = np.array(row["sizes"], dtype=np.int64)
        code = np.array([codes.get(t, -1) for t in row["terms"]], dtype=np.int64)
        begins = (np.cumsum(sizes) - sizes)[code >= 0]
        self.sizes, self.code = sizes[code >= 0], code[code >= 0]
        own = ragged(begins, self.sizes)
        self.begins = np.cumsum(self.sizes) - self.sizes
        arrays = {k: np.frombuffer(row[k], dtype=np.int32)[own].astype(np.int64) for k in ("docs", "impacts", "left", "right")}
        shift = np.repeat(self.begins, self.sizes)
        self.docs, self.impacts = arrays["docs"], arrays["impacts"]
        self.left, self.right = (np.where(arrays[k] < 0, -1, arrays[k] + shift) for k in ("left", "right"))
        self.keys = np.repeat(np.arange(len(self.sizes)), self.sizes) * (1 << 32) + self.docs  # sorted: places of a term's documents are found by bisection
        # the root of a treap is the only node that is nobody's child
        child = np.zeros(len(own), dtype=bool)
        for side in (self.left, self.right):
            child[side[side >= 0]] = True
        self.roots = np.flatnonzero(~child)

    def search(self, ask_query: np.ndarray, ask_code: np.ndarray, ask_weight: np.ndarray, best: Best) -> int:
        """Adds to `best`; gives how many documents were scored. Queries come sorted."""
        if not len(self.code):
            return 0
        place = np.full(int(max(self.code.max(), ask_code.max())) + 1, -1)
        place[self.code] = np.arange(len(self.code))
        term = place[ask_code]
        have = term >= 0
        query, term, heavy = ask_query[have], term[have], ask_weight[have]
        if not len(query):
            return 0
        # stretches: query, low, high (end); entries: a term's treap within a stretch
        first = np.flatnonzero(np.diff(query, prepend=-1))
        of, node = np.cumsum(np.diff(query, prepend=-1) != 0) - 1, self.roots[term]
        query = query[first]
        low, high = np.zeros(len(query), dtype=np.int64), np.full(len(query), len(self.doc_ids))
        scored = 0
        while len(query):
            worth = self.impacts[node] * heavy
            bound = np.zeros(len(query), dtype=np.int64)
            np.add.at(bound, of, worth)
            open_ = bound >= best.bar[query]
            short = open_ & (high - low <= SHORT)
            scored += self._whole(short, query, low, high, of, term, heavy, best)
            keep = open_ & ~short
            of, node, term, heavy, worth = (x[keep[of]] for x in (of, node, term, heavy, worth))
            of, query, low, high = (np.cumsum(keep) - 1)[of], query[keep], low[keep], high[keep]
            if not len(query):
                break
            # each stretch is split at the document of its largest root
            top = np.lexsort((worth, of))
            top = top[np.flatnonzero(np.diff(of[top], append=len(query)))]
            at = self.docs[node[top]]
            score, found = np.zeros(len(query), dtype=np.int64), self._top(node, at[of], at[of] + 1)
            np.add.at(score, of[found >= 0], self.impacts[found[found >= 0]] * heavy[found >= 0])
            best.add(query, score, self.doc_ids[at])
            scored += len(query)
            sides = [(self._top(node, a[of], b[of]), a, b) for a, b in ((low, at), (at + 1, high))]
            of, node, term, heavy, query, low, high = self._below(sides, of, term, heavy, query)
        return scored

    def _top(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Going down from each node, the root of what its treap has from document `low` to before `high`; -1 for nothing."""
        node = node.copy()
        live = np.arange(len(node))
        while len(live):
            here = node[live]
            doc = self.docs[here]
            less, more = doc < low[live], doc >= high[live]
            move = less | more
            live, here, less = live[move], here[move], less[move]
            node[live] = np.where(less, self.right[here], self.left[here])
            live = live[node[live] >= 0]
        return node

    @staticmethod
    def _below(sides: list, of: np.ndarray, term: np.ndarray, heavy: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, ...]:
        """The stretches on both sides that still have an entry."""
        parts = []
        shift = 0
        for down, low, high in sides:
            have = down >= 0
            alive = np.zeros(len(query), dtype=bool)
            alive[of[have]] = True
            number = np.cumsum(alive) - 1 + shift
            parts.append((number[of[have]], down[have], term[have], heavy[have], query[alive], low[alive], high[alive]))
            shift += int(alive.sum())
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _whole(self, short: np.ndarray, query: np.ndarray, low: np.ndarray, high: np.ndarray, of: np.ndarray, term: np.ndarray, heavy: np.ndarray, best: Best) -> int:
        """Scores all documents of short stretches."""
        if not short.any():
            return 0
        own = short[of]
        of, term, heavy = (np.cumsum(short) - 1)[of[own]], term[own], heavy[own]
        query, low, high = query[short], low[short], high[short]
        begins = np.searchsorted(self.keys, term * (1 << 32) + low[of])
        counts = np.searchsorted(self.keys, term * (1 << 32) + high[of]) - begins
        at = ragged(begins, counts)
        of, heavy = np.repeat(of, counts), np.repeat(heavy, counts)
        cell, which = np.unique(of * SHORT + self.docs[at] - low[of], return_inverse=True)
        score = np.zeros(len(cell), dtype=np.int64)
        np.add.at(score, which, self.impacts[at] * heavy)
        best.add(query[cell // SHORT], score, self.doc_ids[low[cell // SHORT] + cell % SHORT])
        return len(cell)


def search(kept: Scratch, index: DataFrame, totals: tuple[int, int], terms: DataFrame, *, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of `index` for each item of `terms` (item_id, term).

    Items are dealt into blocks of about BLOCK_TERMS terms by a hash; each block is one
    pass over the index, and all that goes to the driver and to every task.
    """
    spark = index.sparkSession
    counted = index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("own")).groupBy(F.col("own.terms").alias("term")).agg(F.sum("own.sizes").alias("df"))
    known = kept.put(terms.join(counted, "term"))
    blocks = max(1, math.ceil(known.count() / BLOCK_TERMS))
    kind = terms.schema["item_id"].dataType.simpleString()
    found = None
    for block in range(blocks):
        rows = known.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).select("item_id", "term", "df").toArrow()
        items = rows["item_id"].combine_chunks().dictionary_encode(null_encoding="encode")
        ask = sorted(zip(items.indices.to_pylist(), rows["term"].to_pylist(), [weight(totals[0], n) for n in rows["df"].to_pylist()], strict=True))
        codes = {t: i for i, t in enumerate(sorted({a[1] for a in ask}))}
        query, code, heavy = (np.array(x, dtype=np.int64) for x in ([a[0] for a in ask], [codes[a[1]] for a in ask], [a[2] for a in ask]))
        shared = spark.sparkContext.broadcast((items.dictionary, codes, query, code, heavy))

        def visit(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, codes, query, code, heavy = shared.value
            best = Best(len(names), k)
            for batch in batches:
                for row in batch.to_pylist():
                    Segment(row, codes).search(query, code, heavy, best)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(best.query)), pa.array(np.where(best.doc == NO_ID, 0, best.doc), mask=best.doc == NO_ID), pa.array(best.score)], names=["item_id", "doc_id", "score"])

        own = kept.put(index.mapInArrow(visit, f"item_id {kind}, doc_id bigint, score bigint"))
        found = own if found is None else found.union(own)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, queries: DataFrame, *, k: int = 10) -> DataFrame:
    """For each item of `queries` (item_id, text) the k documents of `docs` (doc_id, text) with the highest score above 0.

    Every row of `docs` with a word is a document of its own, also where doc_ids repeat;
    a null text has no words. doc_id is an integer; null comes last among equal scores. Rows of
    `queries` with the same item_id (null is one of them) are one item with the terms of
    all. Items without a term that occurs have no row; empty tables give none. Other
    columns are not read. Only terms of the items are indexed, in whole documents.
    """
    kept = Scratch(docs.sparkSession, "op12")
    totals = word_totals(docs)
    terms = kept.put(query_terms(queries))
    wanted = KeyFilter.build(terms.select(F.col("term")).distinct().mapInArrow(hashed_terms, "key bigint"))
    index = kept.put(segments(docs, totals, wanted))
    return search(kept, index, totals, terms, k=k)


def hashed_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(term_keys([t.encode("utf-8", "surrogatepass") for t in batch.column(0).to_pylist()]))], names=["key"])
