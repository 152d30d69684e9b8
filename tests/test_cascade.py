import random
import re
import tempfile

from fenestra.operators import match

KINDS = "a bigint, b string"


def test_cascade_asks_each_layer_for_what_is_left(spark):
    rng = random.Random(1)
    asked = [(rng.choice([None, *range(40)]), rng.choice(["x", "y", None])) for _ in range(300)]
    layers = [[(a, rng.choice("xy"), rng.randint(1, 9)) for a in rng.sample(range(60), 15) for _ in range(2)], [(a, rng.randint(1, 9)) for a in rng.sample(range(60), 15)], [(a, 7) for a in rng.sample(range(60), 30)]]
    frames = [spark.createDataFrame(layers[0], "a bigint, b string, answer int"), *(spark.createDataFrame(x, "a bigint, answer int") for x in layers[1:])]
    home = tempfile.mkdtemp(dir="/tmp")
    rows, log = match.residual_cascade(spark.createDataFrame(asked, KINDS), list(zip("pqr", frames, strict=True)), ["a", "b"], home)
    want, left, counts = {}, set(asked), []
    for i, layer in enumerate(layers):
        answers = {}
        for *k, v in layer:
            answers.setdefault(tuple(k), []).append(v)
        hit = {k for k in left if (k if i == 0 else k[:1]) in answers}
        want |= {k: (i, "pqr"[i], min(answers[k if i == 0 else k[:1]])) for k in hit}
        counts.append((i, "pqr"[i], len(left), len(hit), len(left) - len(hit)))
        left -= hit
    want |= dict.fromkeys(left, (None, None, None))
    assert {(r.a, r.b): (r.layer, r.name, r.answer) for r in rows.collect()} == want
    assert [tuple(r) for r in log.orderBy("layer").collect()] == counts
    # what a layer has read is what the one before has left, and nothing else
    for i in (1, 2):
        assert {(r.a, r.b) for r in spark.read.parquet(f"{home}/{i}").collect()} == {(r.a, r.b) for r in spark.read.parquet(f"{home}/{i - 1}/known=false").collect()}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 4 and len(re.findall(r"PartitionFilters: \[[^\]]*known", plan)) == 4


def test_cascade_ends_when_nothing_is_left(spark):
    asked = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], KINDS)
    all_known = spark.createDataFrame([(1, 5), (2, 6)], "a bigint, answer int")
    rows, log = match.residual_cascade(asked, [("one", all_known), ("two", all_known)], ["a", "b"], tempfile.mkdtemp(dir="/tmp"))
    assert {(r.a, r.layer, r.answer) for r in rows.collect()} == {(1, 0, 5), (2, 0, 6)} and [tuple(r) for r in log.collect()] == [(0, "one", 2, 2, 0)]
    rows, log = match.residual_cascade(asked.limit(0), [("one", all_known)], ["a", "b"], tempfile.mkdtemp(dir="/tmp"))
    assert rows.collect() == [] and [tuple(r) for r in log.collect()] == [(0, "one", 0, 0, 0)]
