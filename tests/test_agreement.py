import random

import pytest

from fenestra.operators.agreement import agreement, best_offers

WEIGHTS = [
    ("rain", "*", "=", 0.2), ("rain", "*", "*", -0.1), ("rain", "*", None, -0.1), ("heat", "*", "=", 0.2), ("heat", "*", "*", -0.1), ("body", "cab", "cab", 0.3), ("body", "cab", "sedan", -0.5), ("body", "*", "*", 0.05),
    ("body", None, "sedan", -0.02), ("body", None, "*", -0.01), ("body", "cab", None, -0.03), ("body", "*", None, 0.0), ("hud", None, "*", -0.2),
]
CLAMPS = [("low", -0.3, 0.3, 0.1), ("wide", -1.0, 1.0, 0.0)]
VALUES = {"rain": ["y", "n"], "heat": ["y", "n"], "body": ["cab", "sedan", "van"], "hud": ["y"], "loose": ["y"]}


def by_hand(make, a, o):
    """None without a common feature."""
    if not set(a) & set(o):
        return None
    table = {(f, x, y): p for f, x, y, p in WEIGHTS}
    get = lambda *keys: next((table[k] for k in keys if k in table), 0.0)
    total = 0.0
    for f in set(a) | set(o):
        if f in a and f in o:
            total += get((f, a[f], o[f]), *([(f, "*", "=")] if a[f] == o[f] else []), (f, "*", "*"))
        elif f in a:
            total += get((f, a[f], None), (f, "*", None))
        else:
            total += get((f, None, o[f]), (f, None, "*"))
    low, high, perfect = {m: r for m, *r in CLAMPS}.get(make, (-9e9, 9e9, 0.0))
    total += perfect if all(o.get(f) == v for f, v in a.items()) else 0.0
    return round(max(low, min(high, total)), 9)


def sides(seed):
    rng = random.Random(seed)
    some = lambda: {f: rng.choice(v) for f, v in VALUES.items() if rng.random() < 0.5}
    return {i: (rng.choice(["low", "wide", "other", None]), some()) for i in range(60)}, {i: some() for i in range(100, 150)}


def frames(spark, asked, offered):
    a = [(i, m, f, v) for i, (m, own) in asked.items() for f, v in [*own.items(), (None, None)]]
    o = [(i, f, v) for i, own in offered.items() for f, v in [*own.items(), ("rain", None)]]
    return (
        spark.createDataFrame(a, "asked_id bigint, make string, feature string, value string"), spark.createDataFrame(o, "offered_id bigint, feature string, value string"),
        spark.createDataFrame(WEIGHTS, "feature string, asked string, offered string, points double"), spark.createDataFrame(CLAMPS, "make string, low double, high double, perfect double"),
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_scores_against_pairs_by_hand(spark, seed):
    asked, offered = sides(seed)
    scored, who_asks, who_offers = agreement(*frames(spark, asked, offered))
    got = {(r.asked_id, r.offered_id): r.score for r in scored.join(who_asks, "asked_key").join(who_offers, "offered_key").collect()}
    want = {(i, j): s for i, (m, a) in asked.items() for j, o in offered.items() if (s := by_hand(m, a, o)) is not None}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)
    best = {r.asked_id: (r.offered_id, r.score) for r in best_offers(*frames(spark, asked, offered)).collect()}
    assert best.keys() == {i for i, _ in want}
    for i, (j, s) in best.items():
        own = sorted((-round(v, 8), y) for (x, y), v in want.items() if x == i)
        assert (-round(s, 8), j) == own[0]


@pytest.mark.parametrize(("make", "a", "o", "score"), [
    ("low", {"rain": "y", "heat": "y"}, {"rain": "y", "heat": "y"}, 0.3), ("low", {"body": "cab"}, {"body": "sedan"}, -0.3), ("wide", {"body": "cab"}, {"body": "sedan"}, -0.5), ("other", {"rain": "y", "heat": "y"}, {"rain": "y", "heat": "y"}, 0.4),
    ("low", {"rain": "y"}, {"rain": "n"}, -0.1), ("wide", {"rain": "y"}, {"rain": "y", "hud": "y"}, 0.0), ("wide", {"body": "van"}, {"body": "cab"}, 0.05), ("wide", {"rain": "y", "body": "cab"}, {"rain": "y"}, 0.17),
])
def test_clamps_and_missing_values(spark, make, a, o, score):
    got = best_offers(*frames(spark, {1: (make, a)}, {2: o})).collect()
    assert [round(r.score, 9) for r in got] == [score]


def test_empty(spark):
    asked, offered, weights, clamps = frames(spark, *sides(3))
    for x, y in ((asked.limit(0), offered), (asked, offered.limit(0))):
        assert best_offers(x, y, weights, clamps).collect() == []
    assert {r.score for r in best_offers(asked, offered, weights.limit(0), clamps).collect()} <= {0.0, 0.1}
