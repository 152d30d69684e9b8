import random

import pytest
from pyspark.sql import functions as F

from fenestra.operators.intervals import heaviest_holding, pieces_of


def test_pieces_make_up_the_interval(spark):
    spans = [(a, b) for a in range(0, 33) for b in range(a - 1, 33)]
    for r in spark.createDataFrame(spans, "a bigint, b bigint").select("a", "b", pieces_of(F.col("a"), F.col("b"), 6).alias("p")).collect():
        points = [x for p in r.p for x in range(p.piece << p.level, (p.piece + 1) << p.level)]
        assert sorted(points) == list(range(r.a, r.b + 1)) and len(r.p) <= 12


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    year = lambda: rng.choice([None, *range(1890, 2110, 3)])
    spans = [(rng.choice("ab"), year(), year(), rng.randint(1, 9), i) for i in range(150)]
    probes = [(i, rng.choice("abc"), rng.choice([None, 1899, *range(1900, 2101, 7)]), "clash") for i in range(200)]
    got = heaviest_holding(
        spark.createDataFrame(spans, "k string, lo int, hi int, w bigint, item bigint"), spark.createDataFrame(probes, "id int, k string, y int, level string"), ["k"], lo="lo", hi="hi", weight="w", item="item", at="y", least=1900, most=2100
    )
    want = {}
    for i, k, y, _ in probes:
        hits = [(-w, item) for kk, lo, hi, w, item in spans if kk == k and y is not None and 1900 <= y <= 2100 and (lo is None or lo <= y) and (hi is None or y <= hi)]
        want[i] = (-min(hits)[0], min(hits)[1]) if hits else (None, None)
    assert {r.id: (r.w, r.item) for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
