"""Greatest overlaps against every pair."""

import random

import pytest

from fenestra import registry
from fenestra.operators.overlaps import overlapped_most

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("chunk", [7, 1000])
def test_greatest_overlaps_against_every_pair(spark, chunk):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), 3 * i - 100, lo := rng.randint(-30, 30), lo + rng.randint(-2, rng.choice([3, 40]))) for i in range(150)]
    rows += [("c", 1, 5, 9), ("c", 2, 10, 12), (None, 3, 1, 9), (None, 4, 1, 9), ("d", 5, None, None), ("d", 6, 1, 2), ("d", 7, 2, 2), ("d", 8, 1, 2)]
    want = []
    for block, a, lo, hi in rows:
        met = [(min(hi, y) - max(lo, x) + 1, -b) for other, b, x, y in rows if block and block == other and a < b and None not in (lo, x) and lo <= y and x <= hi]
        if met:
            want.append((a, -max(met)[1], max(met)[0]))
    rng.shuffle(rows)
    ranges = spark.createDataFrame(rows, "block string, id bigint, lo int, hi int")
    assert sorted(map(tuple, overlapped_most(ranges, ["block"], chunk=chunk).collect())) == sorted(want)


@pytest.mark.parametrize("name", ["interval_overlap_join", "interval_overlap_whole"])
def test_ranges_are_not_joined_with_each_other(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1  # orders with customers
