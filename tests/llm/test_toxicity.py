import math
import random
import re

from pyspark.sql import functions as F

from fenestra.llm.toxicity import drop_toxic, fit, held_out, score_documents, toxicity

BAD = ["grobian", "lumpenpack", "vermaledeit"]


def fixture(spark, n=900):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 6))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        sentences = [" ".join(rng.choices(words, k=8)) + "." for _ in range(rng.randint(1, 12))]
        bad = i % 5 == 0
        if bad:
            at = rng.randrange(len(sentences))
            sentences[at] = sentences[at][:-1] + " " + rng.choice(BAD) + rng.choice(["", "en", "heit"]) + " x."
        docs.append((i, " ".join(sentences), "s", "clash"))
        labels.append((i, int(bad)))
    docs += [(n, None, None, None), (n + 1, "", "s", None), (n + 2, "Ein Grobian! " + "ruhig " * 60_000, "s", None), (None, "ohne id", "s", None), (0, docs[0][1], "s", "twice")]
    labels += [(n, 1), (n + 1, None), (None, 1)]
    return spark.createDataFrame(docs, "doc_id bigint, text string, source string, score string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_held_out_accuracy_and_spans(spark):
    docs, labels = fixture(spark)
    got = toxicity(docs, labels).collect()
    assert len(got) == docs.count()
    by_id = {r.doc_id: r for r in got}
    test = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert len(test) > 200
    assert sum(r.predicted == int(r.doc_id % 5 == 0) for r in test) >= 0.99 * len(test)
    assert by_id[900].score == 0.0 and by_id[901].score == 0.0 and by_id[902].predicted == 1
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in test:
        if r.predicted:
            assert any(b in text[r.doc_id][s.start : s.end].lower() for s in r.sentences for b in BAD)


def test_noisy_or_against_brute_force(spark):
    """Scores and offending sentences, computed afresh from the weights."""
    docs, labels = fixture(spark, 300)
    weights = fit(docs, labels)
    assert weights
    got = score_documents(docs.where("text IS NOT NULL"), weights, keep=("text",)).collect()
    assert len(got) > 290
    for r in got:
        text = r.text
        none, offending = 1.0, []
        for s in re.split(r"\n+|(?<=[.!?])\s+", text):
            features = {f for w in re.findall(r"[^\W_]+", s.lower()) for f in [w, *(w[:k] + "*" for k in (3, 4, 5) if len(w) > k)]} & set(weights)
            p = 1 / (1 + math.exp(8.0 - sum(weights[f] for f in features))) if features else 0.0
            none *= 1 - p
            offending += [s] if p >= 0.5 else []
        assert abs(r.score - (1 - none)) < 1e-9 and [text[x.start : x.end] for x in r.sentences] == offending


def test_long_labelled_texts_train(spark):
    """Here every text that tells is long."""
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 6))) for _ in range(200)]
    long = lambda bad: ". ".join(" ".join(rng.choices(words, k=9)) for _ in range(500)) + (". du grobian. " if bad else ". ") + "ende. " * 10
    docs = [(i, long(i % 2)) for i in range(90)] + [(i, "du grobian") for i in range(100, 103)] + [(i, "ruhig ende") for i in range(103, 106)]
    docs = spark.createDataFrame(docs + docs[-6:], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(90)] * 2, "doc_id bigint, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity(docs, labels).collect()}
    assert [got[i] for i in range(100, 106)] == [1, 1, 1, 0, 0, 0]


def test_scores_use_no_labels(spark):
    docs, labels = fixture(spark, 300)
    weights = fit(docs, labels)
    a = score_documents(docs, weights).select("doc_id", "score")
    b = score_documents(docs.withColumn("source", F.lit("other")), weights).select("doc_id", "score")
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert docs.where(held_out()).count() > 0


def test_pipeline_form_keeps_columns(spark):
    docs, labels = fixture(spark)
    kept = drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    ids = {r.doc_id for r in kept.collect()}
    assert 901 in ids and 900 in ids and 902 not in ids and 5 not in ids and 6 in ids


def test_without_labels_or_rows(spark):
    docs, labels = fixture(spark, 60)
    assert toxicity(docs, labels.where("false")).where("score <> 0").count() == 0
    assert toxicity(docs.where("false"), labels).count() == 0
