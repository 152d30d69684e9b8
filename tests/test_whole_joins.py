"""Joins over whole tables, against brute force."""

from datetime import date

import pytest

from fenestra import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows_of(spark):
    kept = {}

    def read(name):
        if name not in kept:
            kept[name] = spark.read.parquet(f"{SF}/{name}.parquet").collect()
        return kept[name]

    return read


def test_lists_of_every_order(spark, rows_of):
    got = sorted(map(tuple, registry.QUERIES["exploded_list_whole"](spark, SF).collect()))
    names = {p.p_partkey: p.p_name for p in rows_of("part")}
    assert got == sorted({(x.l_orderkey, x.l_partkey, names[x.l_partkey]) for x in rows_of("lineitem") if x.l_partkey in names})
    assert {r[0] for r in got} == {x.l_orderkey for x in rows_of("lineitem")}


def test_best_overlap_among_all_customers(spark, rows_of):
    nation, first, blocks, want = {c.c_custkey: c.c_nationkey for c in rows_of("customer")}, {}, {}, []
    for o in rows_of("orders"):
        day = str(o.o_orderdate)[:10]
        first[o.o_custkey] = min(first.get(o.o_custkey, day), day)
    for k, day in first.items():
        if k in nation:
            lo = (date.fromisoformat(day) - date(1990, 1, 1)).days
            blocks.setdefault(nation[k], []).append((k, lo, lo + k % 400))
    for block in blocks.values():
        for a, lo, hi in block:
            met = [(min(hi, y) - max(lo, x) + 1, -b) for b, x, y in block if a < b and lo <= y and x <= hi]
            if met:
                want.append((a, -max(met)[1], max(met)[0]))
    got = sorted(map(tuple, registry.QUERIES["interval_overlap_whole"](spark, SF).select("a", "b", "days").collect()))
    assert got == sorted(want)
    assert {r[0] % 4 for r in got} == {0, 1, 2, 3}


def test_neighbours_of_all_parts(spark, rows_of):
    parts, want = rows_of("part"), []
    for p in (x for x in parts if x.p_partkey % 20):
        near = []
        for s in (x for x in parts if x.p_partkey % 20 == 0 and x.p_brand == p.p_brand):
            score = round(0.6 * (p.p_type == s.p_type) + 0.4 * max(0, 1 - abs(p.p_size - s.p_size) / 50), 9)
            if score >= 0.3:
                near.append((-score, s.p_partkey))
        want += [(p.p_partkey, seed, round(-score, 6), i + 1, -score >= 0.85) for i, (score, seed) in enumerate(sorted(near)[:3])]
    got = sorted(map(tuple, registry.QUERIES["weighted_neighbour_whole"](spark, SF).select("p_partkey", "seed", "score", "rank", "accepted").collect()))
    assert got == sorted(want)
    assert len({r[0] % 20 for r in got}) > 1


def test_every_part_is_verified(spark, rows_of):
    parts, want = rows_of("part"), []
    for f in parts:
        for p in sorted(parts, key=lambda x: x.p_partkey):
            brand, name, kind = f.p_brand == p.p_brand, f.p_name == p.p_name, f.p_type == p.p_type
            if f.p_partkey != p.p_partkey and name and (brand or kind):
                score = 25 * (brand + name + kind)
                want.append((f.p_partkey, p.p_partkey, score, "exact" if score >= 75 else "probable"))
                break
    got = sorted(map(tuple, registry.QUERIES["or_match_whole"](spark, SF).select("f_key", "p_partkey", "score", "bucket").collect()))
    assert got == sorted(want)
    assert len({r[0] % 10 for r in got}) == 10
