import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from fenestra.operators.learning import LearningCycle
from fenestra.plans import loads
from fenestra.sources.keyed import KeyedTable
from fenestra.streaming import counters

SCHEMA = "k bigint, price double, note string, hits bigint"
POLICY = {"price": "max", "note": "fill", "hits": "sum"}


@pytest.fixture
def home():
    return tempfile.mkdtemp(prefix="keyed-", dir="/tmp")


def table_of(spark, home, buckets=8, policy=POLICY, keys=("k",)):
    return KeyedTable(spark, home, list(keys), policy, buckets=buckets)


def state(table):
    return {r[0]: tuple(r)[1:] for r in table.rows().collect()}


def brute(deliveries):
    out = {}
    for rows in deliveries:
        one = {}
        for k, *v in rows:
            one.setdefault(k, []).append(tuple(v))
        for k, many in one.items():
            price, hits = max(v[0] for v in many), sum(v[2] for v in many)
            note = max(many, key=lambda v: (v[0], v[1] is not None, v[1] or "", v[2]))[1]
            a = out.get(k, (None, None, 0))
            out[k] = (price if a[0] is None else max(a[0], price), note if note is not None else a[1], a[2] + hits)
    return out


def test_merges_against_brute_force(spark, home):
    rng = random.Random(1)
    deliveries = [[(rng.choice([None, *range(60)]), float(rng.randint(1, 9)), rng.choice([None, "a", "b"]), rng.randint(1, 5)) for _ in range(n)] for n in (80, 5, 1, 120)]
    table = table_of(spark, home)
    for i, rows in enumerate(deliveries):
        done = table.merge(spark.createDataFrame(rows, SCHEMA))
        assert done.published and done.version == i + 1
        assert state(table) == brute(deliveries[: i + 1])
        assert done.new + done.changed + done.unchanged == len({r[0] for r in rows})


def test_only_touched_buckets_are_written_and_repeats_change_nothing(spark, home):
    policy = {"price": "max", "note": "fill"}
    table = table_of(spark, home, policy=policy)
    rows = spark.createDataFrame([(i, float(i), "n") for i in range(200)], "k bigint, price double, note string")
    table.merge(rows)
    before = set(table.rows().inputFiles())
    again = table.merge(rows)
    assert (again.new, again.changed, again.unchanged, again.published, again.version) == (0, 0, 200, False, 1)
    assert set(table.rows().inputFiles()) == before and table.folder.names("data") == ["v=1"]
    one = table.merge(spark.createDataFrame([(7, 500.0, None)], "k bigint, price double, note string"))
    assert (one.new, one.changed, one.unchanged, len(one.buckets)) == (0, 1, 0, 1)
    after = set(table.rows().inputFiles())
    assert len(before - after) == 1 and len(after - before) == 1  # seven of eight buckets keep their files
    assert state(table)[7] == (500.0, "n")


def test_gates_keep_what_was_visible(spark, home):
    table = table_of(spark, home, policy={"price": "new", "note": "new"})
    gates = {"rows": (F.count("*"), 2, True), "no note": (F.count_if(F.col("note").isNull()), 0, False)}
    kinds = "k bigint, price double, note string"
    assert table.merge(spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "b")], kinds), gates).published
    bad = table.merge(spark.createDataFrame([(2, 9.0, None), (3, 3.0, "c")], kinds), gates)
    assert bad.failed == ["no note"] and not bad.published and state(table) == {1: (1.0, "a"), 2: (2.0, "b")}
    assert table.folder.names("data") == ["v=1"]
    assert table_of(spark, tempfile.mkdtemp(dir="/tmp"), policy={"price": "new", "note": "new"}).merge(spark.createDataFrame([(1, 1.0, "a")], kinds), gates).failed == ["rows"]


def test_killed_between_write_and_swap(spark, home, monkeypatch):
    table = table_of(spark, home)
    table.merge(spark.createDataFrame([(1, 1.0, "a", 1)], SCHEMA))
    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "publish", lambda self, manifest: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            table.merge(spark.createDataFrame([(1, 5.0, "x", 1), (2, 2.0, "b", 1)], SCHEMA))
    assert state(table_of(spark, home)) == {1: (1.0, "a", 1)}  # the files are there, but no manifest names them
    table_of(spark, home).merge(spark.createDataFrame([(2, 2.0, "b", 1)], SCHEMA))
    assert state(table) == {1: (1.0, "a", 1), 2: (2.0, "b", 1)}


def test_two_writers_cannot_both_publish(spark, home):
    table = table_of(spark, home)
    table.merge(spark.createDataFrame([(1, 1.0, "a", 1)], SCHEMA))
    with pytest.raises(FileExistsError):
        table.publish({"version": 1, "buckets": {}})
    assert state(table) == {1: (1.0, "a", 1)} and not [n for n in table.folder.names("manifest") if "tmp" in n and not n.startswith(".")]


def test_point_reads_open_only_their_buckets(spark, home):
    table = table_of(spark, home, buckets=64, policy={"price": "new"}, keys=("k", "part"))
    table.merge(spark.createDataFrame([(i, f"p{i % 3}", float(i)) for i in range(2000)] + [(None, "p0", -1.0)], "k bigint, part string, price double"))
    everything = table.rows().inputFiles()
    for wanted, found in (([(7, "p1")], {7.0}), ([(7, "p0")], set()), ([(7, "p1"), (900, "p0"), (None, "p0")], {7.0, 900.0, -1.0}), ([(5000, "p0")], set())):
        got = table.lookup(wanted)
        assert {r.price for r in got.collect()} == found
        assert len(got.inputFiles()) <= len(wanted) < len(everything)
    assert "PushedFilters: [" in table.lookup([(7, "p1")])._jdf.queryExecution().toString()


def test_errors(spark, home):
    with pytest.raises(ValueError, match="unknown policies"):
        table_of(spark, home, policy={"price": "newest"})
    with pytest.raises(FileNotFoundError):
        table_of(spark, home).rows()
    empty = table_of(spark, home).merge(spark.createDataFrame([], SCHEMA))
    assert not empty.published and empty.buckets == []


# ---------------------------------------------------------------- the learning cycle


def by_hand(periods, support, flags):
    """(version, rules, discoveries, correct, in_force, promoted) with plain dictionaries."""
    mined, out, active = {}, [], None
    for p, rows in periods:
        if mined:
            version = max(mined)

            def right(v):
                n = 0
                for a, b, *on in rows:
                    rule = mined[v].get((a, b)) or mined[v].get((a,)) or [0] * len(flags)
                    n += sum((s >= 0.5) == bool(o) for s, o in zip(rule, on, strict=True))
                return n

            before = active
            good = before is None or right(version) >= right(before)
            out.append((version, len(mined[version]), len(set(mined[version]) - set(mined.get(before, {}))), right(version), before, good))
            active = version if good else before
        groups = {}
        for a, b, *on in rows:
            groups.setdefault((a, b), []).append(on)
            groups.setdefault((a,), []).append(on)
        mined[p] = {k: [int(100 * sum(o) / len(v) + 0.5) / 100 for o in zip(*v, strict=True)] for k, v in groups.items() if len(v) >= support[len(k) == 1]}
    return out


def history(seed=3):
    rng = random.Random(seed)
    drift = {p: rng.random() for p in range(1, 8)}
    return [(p, [(rng.choice("ABU"), rng.choice("xyzw"), rng.random() < drift[p], rng.random() < 0.5, rng.random() < 0.9) for _ in range(rng.randint(30, 90))]) for p in range(1, 8)]


KINDS = "a string, b string, f1 boolean, f2 boolean, f3 boolean"


def decided(cycle):
    return [(r.version, r.rules, r.discoveries, r.correct, r.in_force, r.promoted) for r in cycle.decisions().orderBy("version").collect()]


def test_cycle_against_plain_dictionaries(spark, home):
    periods = history()
    cycle = LearningCycle(spark, home, [["a", "b"], ["a"]], ["f1", "f2", "f3"], [3, 5])
    for p, rows in periods:
        cycle.step(spark.createDataFrame(rows, KINDS), p)
    want = by_hand(periods, [3, 5], "123")
    assert decided(cycle) == want and {w[-1] for w in want} == {True, False} and cycle.versions() == [p for p, _ in periods]


def test_missing_keys_are_unknown(spark, home):
    cycle = LearningCycle(spark, home, [["a", "b"], ["a"]], ["f1"], [1, 1])
    rows = spark.createDataFrame([(None, "x", True), ("UNKNOWN", "x", False), (None, None, None)], "a string, b string, f1 boolean")
    assert {(r.a, r.b, r.n, r.f1) for r in cycle.counters(rows).collect()} == {("UNKNOWN", "x", 2, 1), ("UNKNOWN", "UNKNOWN", 1, 0)}


def test_stream_stopped_in_the_middle_decides_alike(spark, home):
    """One file a period; the third batch fails after its rules are written, and the stream starts again from its checkpoint."""
    periods, inbox = history(5), tempfile.mkdtemp(dir="/tmp")
    for p, rows in periods:
        path = f"{inbox}/{p}"
        spark.createDataFrame([(*r, p) for r in rows], f"{KINDS}, period bigint").coalesce(1).write.parquet(path)
        for name in os.listdir(path):
            if name.endswith(".parquet"):
                os.rename(f"{path}/{name}", f"{inbox}/{p:03d}.parquet")
                os.utime(f"{inbox}/{p:03d}.parquet", (p, p))
        for name in os.listdir(path):
            os.remove(f"{path}/{name}")
        os.rmdir(path)
    cycle = LearningCycle(spark, home, [["a", "b"], ["a"]], ["f1", "f2", "f3"], [3, 5])
    seen = []

    def each(batch, number):
        seen.append(number)
        cycle.follow(batch, "period")
        if number == 2 and seen.count(2) == 1:
            raise RuntimeError("stopped")

    stream = lambda: counters.stream_parquet(spark, inbox, f"{KINDS}, period bigint", files_per_batch=1)
    with pytest.raises(Exception, match="stopped"):
        counters.run_available(stream(), f"{home}/checkpoint", each)
    counters.run_available(stream(), f"{home}/checkpoint", each)
    assert seen == [0, 1, 2, 2, 3, 4, 5, 6] and decided(cycle) == by_hand(periods, [3, 5], "123")


def test_full_load_publishes_some_and_keeps_the_rest_out(spark):
    log = loads.full_load(spark, "/root/testdata/sf0.001").collect()
    assert len(log) == 7 and {r.published for r in log} == {True, False}
