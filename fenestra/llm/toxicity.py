"""Toxicity by multiple-instance learning (operator 2).

A document is a bag of sentences. Each sentence has a score p = sigmoid(w.x + b)
over its words' features; the document's score is the noisy-or 1 - prod(1 - p),
so one offending sentence is enough. Only documents carry labels: the likelihood
of those trains the sentence model, which then also points at the sentences.

Features of a word are the word and its beginnings of 3 to 5 letters, so that
inflected and compounded forms share weight. Only features that separate the
labels in a bounded training sample are kept; a word without any adds nothing.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A sentence ends at a line's end or after . ! ? and white space.
SENTENCE_END = re.compile(r"\n+|(?<=[.!?])\s+")
WORD = re.compile(r"[^\W_]+")
#: Bounds of what training collects: rows, sentences of one document that hold a feature, and features.
MAX_TRAIN_ROWS = 8000
MAX_TRAIN_SENTENCES = 500
MAX_FEATURES = 20_000
#: Standard deviations that a feature's rate of label 1 must be off the mean.
MIN_LEAN = 4.5
#: Of a sentence whose features weigh nothing: some 2,000 such sentences are needed to reach 0.5.
BASE_LOGIT = -8.0


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1


def word_features(word: str) -> list[str]:
    return [word] + [f"{word[:k]}*" for k in (3, 4, 5) if len(word) > k]


def training_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, toxic) of at most about `rows` labelled rows of either label, chosen by a hash of doc_id.

    Rows with the test remainder, a null label, id or text take no part. Of labels that differ for an id, 1 counts.
    """
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = marked.groupBy("toxic").count().toPandas()
    wanted = F.lit(None)
    for toxic, n in zip(counts["toxic"], counts["count"], strict=True):
        wanted = F.when(F.col("toxic") == int(toxic), F.lit(min(1.0, rows / 2 / n))).otherwise(wanted)
    chosen = marked.where(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 30)) < wanted * (1 << 30)).limit(2 * rows)
    with_text = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    return with_text.join(F.broadcast(chosen), "doc_id").select("text", (F.col("toxic") == 1).alias("toxic"))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document: the distinct features of each sentence."""
    for batch in batches:
        out = [[sorted({f for w in WORD.findall(s) for f in word_features(w)}) for s in SENTENCE_END.split(t.lower())] for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.list_(pa.string()))), batch.column(1)], names=["sentences", "toxic"])


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = MAX_TRAIN_ROWS, steps: int = 150) -> dict[str, float]:
    """Weights by feature. Without both labels in the sample: none, and all scores are near 0.

    The sample is the only thing that is collected; its bounds are MAX_TRAIN_ROWS
    rows, each with at most MAX_TRAIN_SENTENCES of its sentences that hold a feature
    (however long the text; chosen by a hash), reduced to at most MAX_FEATURES features
    by how far each is from the mean rate of label 1 (chi-square).
    """
    bags = training_sample(docs, labels, rows).mapInArrow(_bags, "sentences array<array<string>>, toxic boolean").withColumn("row", F.xxhash64("sentences")).cache()
    ones = bags.groupBy().agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("toxic").cast("bigint")), F.lit(0)).alias("n1")).first()
    n, n1 = ones["n"], ones["n1"]
    if not 0 < n1 < n:
        bags.unpersist()
        return {}
    rate = n1 / n
    seen = bags.select("toxic", F.explode(F.array_distinct(F.flatten("sentences"))).alias("feature")).groupBy("feature").agg(F.count("*").alias("df"), F.sum(F.col("toxic").cast("bigint")).alias("df1"))
    lean = (F.col("df1") - F.col("df") * rate) / F.sqrt(F.col("df") * rate * (1 - rate))
    vocabulary = [r["feature"] for r in seen.where("df >= 3").withColumn("lean", lean).where(F.abs("lean") >= MIN_LEAN).orderBy(F.desc(F.abs("lean")), "feature").limit(MAX_FEATURES).select("feature").collect()]
    index = {f: i for i, f in enumerate(sorted(vocabulary))}
    known = bags.sparkSession.sparkContext.broadcast(index)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = known.value
        for batch in batches:
            out = [[[of[f] for f in s if f in of] for s in bag] for bag in batch.column(0).to_pylist()]
            out = [sorted((s for s in bag if s), key=lambda s: (zlib.crc32(repr(s).encode()), s))[:MAX_TRAIN_SENTENCES] for bag in out]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.list_(pa.int32()))), batch.column(1), batch.column(2)], names=["x", "toxic", "row"])

    sample = bags.mapInArrow(encode, "x array<array<int>>, toxic boolean, row bigint").toArrow().sort_by("row").to_pydict()
    bags.unpersist()
    weights = _train(sample["x"], np.array(sample["toxic"], dtype=float), len(index), steps)
    return {f: float(round(weights[i], 6)) for f, i in index.items() if abs(weights[i]) > 1e-4}


def _train(bags: list, y: np.ndarray, n_features: int, steps: int) -> np.ndarray:
    """Adam on the bags' log-likelihood with a small pull to zero."""
    sentence_of, feature, bag_of = [], [], []
    for d, bag in enumerate(bags):
        for s in bag:
            sentence_of += [len(bag_of)] * len(s)
            feature += s
            bag_of.append(d)
    sentence_of, feature, bag_of = (np.array(v, dtype=np.int64) for v in (sentence_of, feature, bag_of))
    w, m, v = np.zeros(n_features), np.zeros(n_features), np.zeros(n_features)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    for t in range(1, steps + 1):
        z = BASE_LOGIT + np.bincount(sentence_of, w[feature], minlength=len(bag_of))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        keep = np.bincount(bag_of, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(y))  # log of "no sentence offends"
        none = np.exp(keep)
        # d loglik / d z of a sentence: y * p * none / (1 - none) - (1 - y) * p
        to_bag = np.where(y == 1, none / np.maximum(1 - none, 1e-6), -1.0) * weight
        g = np.bincount(feature, (to_bag[bag_of] * p)[sentence_of], minlength=n_features) / len(y) - 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w += 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


class Scorer:
    """Scores whole texts with learned weights."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        #: Words already met that have no weight; emptied before it grows large.
        self.without: set[str] = set()

    def telling(self, text: str) -> bool:
        """Whether any word of the text has a weight."""
        new = set(WORD.findall(text)) - self.without
        found = {w for w in new if any(f in self.weights for f in word_features(w))}
        if len(self.without) > 400_000:
            self.without.clear()
        self.without |= new - found
        return bool(found)

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, p) of the sentences with any evidence, in code points of the text."""
        out, at = [], 0
        for end in [*SENTENCE_END.finditer(text), None]:
            stop = end.start() if end else len(text)
            features = {f for w in WORD.findall(text[at:stop].lower()) if w not in self.without for f in word_features(w) if f in self.weights}
            if features:
                z = BASE_LOGIT + sum(map(self.weights.__getitem__, sorted(features)))
                out.append((at, stop, 1 / (1 + np.exp(-min(max(z, -30.0), 30.0)))))
            at = end.end() if end else stop
        return out

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        found = self.sentences(text) if text and self.telling(text.lower()) else []
        return float(-np.expm1(sum(np.log1p(-min(p, 1 - 1e-12)) for _, _, p in found))) if found else 0.0, found


def score_documents(docs: DataFrame, weights: dict[str, float], *, threshold: float = 0.7, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, score, predicted, and the offending sentences.

    `sentences` holds (start, end, score) of sentences with a score of 0.5 or more.
    A null or empty text, and one without any known feature, has score 0; long texts
    are scored whole. Rows that repeat give equal rows, an empty table none, and a score
    just at the threshold is predicted 1. Columns named in `keep` are passed through, all
    others ignored. Labels are no input.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            scores, spans = [], []
            for text in batch.column("text"):
                score, found = scorer.score(text.as_py())
                scores.append(score)
                spans.append([{"start": a, "end": b, "score": float(p)} for a, b, p in found if p >= 0.5])
            columns = [*(batch.column(c) for c in ("doc_id", *keep)), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(spans, span)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *keep, "score", "predicted", "sentences"])

    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    chosen = docs.select("doc_id", "text", *(c for c in keep if c != "text"))
    types = dict(chosen.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in ("doc_id", *keep)) + ", score double, predicted int, sentences array<struct<start:int,end:int,score:double>>"
    return chosen.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7) -> DataFrame:
    """Trains on the labelled rows that aren't held out and scores every row.

    doc_id, held_out, score, predicted, sentences. An id that is null is not held out and never trained on.
    """
    scored = score_documents(docs, fit(docs, labels), threshold=threshold)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted", "sentences")


def drop_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7) -> DataFrame:
    """The rows of `docs`, with all their columns, that are not predicted toxic."""
    rest = tuple(c for c in docs.columns if c != "doc_id")
    renamed = {c: f"in_{i}" for i, c in enumerate(rest) if c != "text"}
    plain = docs.withColumnsRenamed(renamed)
    kept = score_documents(plain, fit(docs, labels), threshold=threshold, keep=("text", *renamed.values())).where("predicted = 0")
    return kept.select(*(F.col(renamed.get(c, c)).alias(c) for c in docs.columns))
