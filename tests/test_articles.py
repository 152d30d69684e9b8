import random
import re

from fenestra import registry
from fenestra.operators import articles as module
from fenestra.operators.articles import article_scores, best_articles

STOP = ["the", "og"]


def tokens(text):
    return [t for t in re.split(r"\s+", re.sub(r"[^a-z0-9_\sæøåéäöü]", " ", (text or "").lower())) if len(t) > 1 and t not in STOP]


def by_hand(question, text, keywords):
    q, words = tokens(question), tokens(f"{text or ''} {' '.join(k.lower() for k in keywords or [])}")
    score = 0.0
    for t in q:
        keys = [k.lower() for k in keywords or []]
        score += 3 if t in keys else 2 if any(t in k for k in keys) else 1 if t in words else 0.5 if any(t in w or w in t for w in words) else 0
    return score / len(q) if q else 0.0


def test_scores_against_every_pair(spark):
    rng = random.Random(1)
    syllables = ["gla", "ss", "fro", "nt", "a", "rute", "é", "hva", "the", "x1"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    text = lambda n: " ".join(word() for _ in range(rng.randint(0, n)))
    articles = [(i, text(12), [word() + rng.choice(["", " " + word()]) for _ in range(rng.randint(0, 3))]) for i in range(25)] + [(90, None, None), (91, "Frontrute, GLASS!", ["Pris-liste"])]
    questions = [(i, i % 3, text(9)) for i in range(80)] + [(200, 0, None), (201, 0, "the og a"), (202, 0, "pris glass frontrutene")]
    frames = spark.createDataFrame(questions, "a int, b int, text string"), spark.createDataFrame(articles, "article_id int, text string, keywords array<string>")
    got = {(r.a, r.article_id): round(r.score, 9) for r in article_scores(*frames, ids=["a", "b"], stop=STOP).collect()}
    want = {(a, i): round(s, 9) for a, _, q in questions for i, t, k in articles if (s := by_hand(q, t, k)) > 0}
    assert got == want
    best = {r.a: r.article_id for r in best_articles(*frames, ids=["a", "b"], stop=STOP).collect()}
    for a, _, _ in questions:
        own = sorted((-s, i) for (x, i), s in want.items() if x == a)
        assert best.get(a) == (own[0][1] if own and -own[0][0] >= 0.3 else None)


def test_best_over_blocks_and_shards(spark, monkeypatch):
    monkeypatch.setattr(module, "QUESTIONS", 20)
    monkeypatch.setattr(module, "ARTICLES", 290)  # two shards, one of them over what is scored at a time
    rng = random.Random(3)
    syllables = ["gla", "ss", "fro", "nt", "a", "rute", "é", "hva", "x1"]
    text = lambda n: " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(0, n)))
    articles = [(f"i{i:03}", text(4), [text(1)]) for i in range(570)] + [("a", None, None), ("b", "fro rute", []), ("c", "fro rute", [])]
    questions = [(rng.choice([None, 1, 2]), i, text(6)) for i in range(60)] + [(1, 100, "fro rute"), (None, 101, None)]
    frames = spark.createDataFrame(questions, "a int, b int, text string"), spark.createDataFrame(articles, "article_id string, text string, keywords array<string>")
    got = {(r.a, r.b): (r.article_id, r.score) for r in best_articles(*frames, ids=["a", "b"], stop=STOP, digits=6).collect()}
    want = {}
    for a, b, q in questions:
        less, item = min((-round(by_hand(q, t, k), 6), i) for i, t, k in articles)
        if -less >= 0.3:
            want[a, b] = item, -less
    assert got == want


def test_no_row_a_question_and_article(spark):
    plan = registry.QUERIES["article_search"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[conv_id#\d+L?, turn#\d+L?, (article|item)_id", plan)
