"""Offers near a number, against every pair."""

import random

import pytest

from fenestra import registry
from fenestra.operators.within import least_within


@pytest.mark.parametrize("chunk", [10, 1000])
def test_least_offers_near_against_every_pair(spark, chunk):
    rng = random.Random(4)
    price = lambda: round(rng.choice([rng.uniform(0, 30), rng.randint(0, 300) / 10]), rng.choice([1, 2, 17]))
    asked = [(rng.choice("ab"), price()) for _ in range(90)] + [("a", 0.3), ("a", 8.1), ("c", 1.0), ("d", 1.0), (None, 1.0), ("a", None), ("a", float("nan")), ("b", float("inf"))]
    offered = [(rng.choice("aab"), price(), i // 2) for i in range(150)] + [("a", 8.0, -1), ("a", 0.4, -2), ("a", 0.2, 500), ("d", 9.0, 1), (None, 1.0, 2), ("b", None, 3), ("b", float("nan"), 4), ("b", float("inf"), 5), ("b", 1.0, None)]
    rng.shuffle(offered)
    want = {}
    for k, at in {x for x in asked if None not in x}:
        near = sorted(i for o, v, i in offered if o == k and None not in (v, i) and abs(at - v) < 0.1)
        if near:
            want[k, at] = (len(near), near[:5])
    frames = spark.createDataFrame(asked, "k string, at double"), spark.createDataFrame(offered, "k string, value double, item bigint")
    assert {(r.k, r.at): (r.n, r["items"]) for r in least_within(*frames, ["k"], reach=0.1, keep=5, chunk=chunk).collect()} == want


def test_no_pairs_of_parts_and_suppliers(spark):
    plan = registry.QUERIES["theta_multi_predicate_join"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "< 800.0" not in plan  # no join has the range as what is left to test
