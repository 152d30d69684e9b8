import random
import re

import pytest
from pyspark.sql import functions as F

from fenestra.operators import normalise, phrases

SPLIT = re.compile(r"[\x00-\x25\x28-\x2A\x2C\x3A-\x40\x5B-\x60\x7B-\x7F]+")
RULES = "rule bigint, phrase string, make string, replacement string, priority int"


def words(text):
    return [w for w in SPLIT.split(re.sub("[a-z]+", lambda m: m[0].upper(), text)) if w]


def brute(text, make, rules):
    """[(at, n, rule)] from the left, longest first; of equal phrases the make's own, then the higher priority, then the smaller id."""
    w, out, at = words(text), [], 0
    while at < len(w):
        hits = []
        for rule, phrase, m, _, priority in rules:
            p = words(phrase)
            if p and w[at : at + len(p)] == p and m in (None, make):
                hits.append((-len(p), m is None, -priority, rule))
        if hits:
            n, _, _, rule = min(hits)
            out.append((at, -n, rule))
            at += -n
        else:
            at += 1
    return out


def example(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "c-1", "d.", "é", "x/y"]
    phrase = lambda n: " ".join(rng.choices(vocabulary, k=n))
    rules = [(i, phrase(rng.randint(1, 4)), rng.choice([None, None, "m1", "m2"]), rng.choice(["", "NEW", "TWO WORDS"]), rng.randint(0, 2)) for i in range(60)] + [(90, " ;, ", None, "none", 5)]
    texts = [(i, rng.choice(["m1", "m2", None]), phrase(rng.randint(0, 25)).replace(" ", rng.choice([" ", ", ", "\n"])), "clash") for i in range(120)] + [(500, "m1", None, ""), (501, "m1", "", ""), (502, None, "a " * 3000, "")]
    return rules, texts


@pytest.mark.parametrize(("seed", "edges"), [(1, 200_000), (2, 0)])
def test_trie_against_brute_force(spark, monkeypatch, seed, edges):
    monkeypatch.setattr(phrases, "BROADCAST_EDGES", edges)
    rules, texts = example(seed)
    table, docs = spark.createDataFrame(rules, RULES), spark.createDataFrame(texts, "doc_id bigint, lang string, text string, rule string")
    spots = phrases.chosen(phrases.found(docs, table, key="doc_id", text="text", make="lang"), key="doc_id")
    got = {r.doc_id: [(m["at"], m["n"], m["rule"]) for m in r.matches] for r in spots.collect()}
    want = {i: b for i, make, text, _ in texts if text and (b := brute(text, make, rules))}
    assert got == want
    replaced = {r[0]: r[3] for r in rules}

    def written(text, make):
        w, out, at = words(text), [], 0
        for a, n, rule in brute(text, make, rules):
            out += w[at:a] + ([replaced[rule]] if replaced[rule] else [])
            at = a + n
        return " ".join(out + w[at:])

    done = phrases.normalised(docs, table, text="text", make="lang", into="done")
    assert {r.doc_id: r.done for r in done.collect()} == {i: None if t is None else written(t, m) for i, m, t, _ in texts}


def test_no_rules_and_no_texts(spark):
    rules, texts = example(3)
    docs = spark.createDataFrame(texts, "doc_id bigint, lang string, text string, rule string")
    none = phrases.normalised(docs, spark.createDataFrame([], RULES), text="text", make=None, into="done")
    assert {r.doc_id: r.done for r in none.collect()} == {i: None if t is None else " ".join(words(t)) for i, _, t, _ in texts}
    assert phrases.found(docs.limit(0), spark.createDataFrame(rules, RULES), key="doc_id", text="text").collect() == []


def test_thousands_of_rules_meet_by_equality(spark):
    rules = spark.range(5000).select(F.col("id").alias("rule"), F.concat(F.lit("word"), F.col("id").cast("string"), F.lit(" tail")).alias("phrase"), F.lit(None).cast("string").alias("make"), F.lit("").alias("replacement"), F.lit(0).alias("priority"))
    docs = spark.range(200).select("id", F.concat(F.lit("see word"), (F.col("id") * 20).cast("string"), F.lit(" tail end")).alias("text"))
    spots = phrases.found(docs, rules, key="id", text="text")
    assert {(r.id, r.rule, r.at) for r in spots.collect()} == {(i, i * 20, 1) for i in range(200)}
    plan = spots._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


BRANDS = [
    ("volvo", "V70 glass", "VOLVO"), (" Volvo ", None, "VOLVO"), ("NEW", "the MINI one", "MINI"), ("NEW", "MINIATURE", "UNKNOWN"), ("NEW", None, "UNKNOWN"), ("GOLF", "x", "VW"),
    ("DD1234", "glass, SAAB then VOLVO", "SAAB"), ("DD1234", "nothing", "UNKNOWN"), ("K", "for VOLVO", "VOLVO"), ("VW", "for VOLVO", "VW"), ("PILKINGTON", "RANGE ROVER door", "LAND ROVER"), ("TOOLS", "VOLVO", "TILBEHØR"),
    (None, "VOLVO", "UNKNOWN"), ("  ", "VOLVO", "UNKNOWN"), ("ÅÄÖ", None, "ÅÄÖ"),
]


def test_brands(spark):
    aliases = spark.createDataFrame([("NEW", "MINI", "MINI"), ("NEW", None, "UNKNOWN"), ("GOLF", None, "VW"), ("VOLVO", None, "VOLVO")], "brand string, context string, normal string")
    known = spark.createDataFrame([("VOLVO", "VOLVO"), ("SAAB", "SAAB"), ("RANGE ROVER", "LAND ROVER")], "phrase string, brand string")
    rows = spark.createDataFrame([(i, b, d) for i, (b, d, _) in enumerate(BRANDS + BRANDS)], "id int, b string, d string")
    got = normalise.brands(rows, aliases, known, brand="b", description="d", suppliers=["PILKINGTON"], no_vehicle=["TOOLS"])
    assert {r.id: r.normal_brand for r in got.collect()} == {i: w for i, (*_, w) in enumerate(BRANDS + BRANDS)}


MODELS = [
    ("HONDA", "Honda CRV 02-", "CR-V 02-"), ("HONDA", "CRV", "CR-V"), ("AUDI", "A4 IV", "A4 IV"), ("AUDI", "A4IV", "A4 IV"), ("KIA", "CRV", "CR V"), ("FORD", "Gala 5D Stasjonsvogn", "GALAXY"), ("FORD", "TRANSIT &amp; VAREBIL", "TRANSIT &"),
    ("LAND ROVER", "Land Rover Defender", "DEFENDER"), ("FORD", "5D SUV", ""), ("FORD", None, None), (None, "CRV", "CR-V"), ("FORD", "RAMBLER RAM", "RAMBLER"),
]


def test_models(spark):
    aliases = spark.createDataFrame([("CRV", None, "CR-V", 0), ("crv", "KIA", "CR V", 0), ("A4IV", None, "A4 IV", 0), ("GALA", None, "GALAXY", 1), ("Gala", None, "GALANT", 0)], "phrase string, make string, replacement string, priority int")
    rows = spark.createDataFrame([(i, b, m) for i, (b, m, _) in enumerate(MODELS)], "id int, make string, m string")
    got = normalise.models(rows, aliases, model="m", make="make")
    assert {r.id: r.normal_model for r in got.collect()} == {i: w for i, (*_, w) in enumerate(MODELS)}


DESCRIBED = [
    ("JEEP", "JEEP GRAND CHEROKEE 99-04 frontrute", "GRAND CHEROKEE"), ("JEEP", "Cherokee 97", "CHEROKEE"), ("JEEP", "JEEP ODDITY 5D", "ODDITY"), ("JEEP", "JEEP 97-04 x", None), ("JEEP", "JEEP GLASS x", None), ("JEEP", "BRUK W123", None),
    ("JEEP", "=W55 CHEROKEE", None), ("FORD", "CHEROKEE", "CHEROKEE"), ("FORD", "x", None), (None, "CHEROKEE", "CHEROKEE"), ("JEEP", None, None), ("JEEP", "", None),
]


def test_models_from_descriptions(spark):
    known = spark.createDataFrame([("GRAND CHEROKEE", "JEEP", 2), ("CHEROKEE", "JEEP", 1)], "phrase string, make string, priority int")
    rows = spark.createDataFrame([(i, b, d) for i, (b, d, _) in enumerate(DESCRIBED)], "id int, make string, d string")
    got = normalise.described_models(rows, known, description="d", make="make")
    assert {r.id: r.model for r in got.collect()} == {i: w for i, (*_, w) in enumerate(DESCRIBED)}
