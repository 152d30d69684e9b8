"""Negation in texts, token by token, and how often tokens are made."""

import random
import re

from fenestra import registry


def by_hand(text):
    if text is None:
        return None
    w = [t.upper() for t in re.findall("[A-Za-z0-9]+", text)]
    if "THE" not in w:
        return None
    i = w.index("THE")
    return not {"OF", "NOT"} & {*w[max(0, i - 3) : i], *w[i + 1 : i + 2]}


def test_against_every_token(spark, tmp_path):
    rng = random.Random(5)
    bits = ["the", "The", "THE", "then", "bathe", "of", "not", "Not", "a", "x1", "\U0001f600", "æ", "ı", "\n", "é", "-", "\u2028"]
    texts = ["".join(x + rng.choice(["", " ", " ", ". ", "\n", ",", "\U0001f600", "é"]) for x in rng.choices(bits, k=rng.randint(0, 12))) for _ in range(600)]
    texts += [None, "", "the", "OF the", "a b c of d e f the of", "the\U0001f600not", "x " * 20000 + "of a b the c", "the " + "y " * 20000, "æthe", "theæ of", "othe the not"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.flag for r in registry.QUERIES["negation_flags"](spark, str(tmp_path)).collect()}
    assert got == {i: by_hand(t) for i, t in enumerate(texts)}


def test_tokens_are_made_once(spark):
    plan = registry.QUERIES["negation_flags"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
