"""Readers, writers and streams: round trips, and streams against their batch form."""

import json

from pyspark.sql import functions as F

from fenestra.sources import readers, writers
from fenestra.streaming import counters


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"meta": {"n": 2}, "records": [{"x": 1}, {"x": 2}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"x": 3}]))
    assert [r.x for r in readers.json_records(spark, str(tmp_path / "a.json")).orderBy("x").collect()] == [1, 2]
    assert [r.x for r in readers.json_records(spark, str(tmp_path / "b.json")).collect()] == [3]
    (tmp_path / "c.ndjson").write_text('{"x": 1, "status": "ok"}\nbroken{\n{"x": 2, "status": "no"}\n')
    assert [r.x for r in readers.ndjson(spark, str(tmp_path / "c.ndjson"), "x int, status string", status="ok").collect()] == [1]
    (tmp_path / "d.tsv").write_text("id\tname\n1\ta\n2\tb\n")
    assert readers.tsv(spark, str(tmp_path / "d.tsv"), "id int, name string").count() == 2
    assert readers.tsv_least(spark, str(tmp_path / "d.tsv"), ["a", "b", "c"]).count() == 0
    (tmp_path / "e.csv").write_text('a,b\n"x, ""y""",2\n')
    assert readers.csv_quoted(spark, str(tmp_path / "e.csv")).first().a == 'x, "y"'
    (tmp_path / "f.sql").write_text("INSERT INTO t (a, b) VALUES\n(1, 'it''s, ok'),\n(2, NULL);\n-- note\n")
    assert [tuple(r) for r in readers.insert_rows(spark, str(tmp_path / "f.sql"), ["a", "b"]).orderBy("a").collect()] == [("1", "it's, ok"), ("2", None)]
    (tmp_path / "g.txt").write_text("# comment\n\n one \ntwo\n")
    assert [r.value for r in readers.plain_list(spark, str(tmp_path / "g.txt")).collect()] == ["one", "two"]
    both = spark.createDataFrame([(None, 5), (3, 4)], "year_from int, yearFrom2 int")
    assert [r.year_from for r in readers.either_name(both, {"year_from": ["year_from", "yearFrom2"]}).collect()] == [5, 3]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("s1", 1), ("s2", 2)], "source string, v int")
    writers.snapshot(rows, str(tmp_path / "snap"), "v1")
    assert spark.read.parquet(str(tmp_path / "snap_meta")).first().records == 2
    writers.reload_source(rows, str(tmp_path / "src"))
    writers.reload_source(spark.createDataFrame([("s2", 9)], "source string, v int"), str(tmp_path / "src"))
    assert sorted((r.source, r.v) for r in spark.read.parquet(str(tmp_path / "src")).collect()) == [("s1", 1), ("s2", 9)]
    writers.append_json(rows, str(tmp_path / "log"))
    writers.append_json(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    writers.browse_export(rows, str(tmp_path / "browse"), "source")
    assert spark.read.json(str(tmp_path / "browse")).where("source = 's1'").count() == 1
    writers.minified(rows, ["v"], str(tmp_path / "min"))
    assert spark.read.json(str(tmp_path / "min")).columns == ["v"]


def test_stream_counters_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    events.repartition(6).write.parquet(str(tmp_path / "in"))
    got = {}

    def keep(batch, number):
        for r in batch.collect():
            got[r.user_id, r.event_type] = (r.hits, r.first_seen, r.last_seen)

    stream = counters.stream_parquet(spark, str(tmp_path / "in"), events.schema, files_per_batch=2)
    counters.run_available(counters.counters(stream, ["user_id", "event_type"], "ts"), str(tmp_path / "cp"), keep)
    want = {(r.user_id, r.event_type): (r.hits, r.first_seen, r.last_seen) for r in counters.counters(events, ["user_id", "event_type"], "ts").collect()}
    assert got == want


def test_stream_sessions_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    got = []
    stream = counters.stream_parquet(spark, str(tmp_path / "in"), events.schema)
    counters.run_available(counters.sessions(stream, "user_id", "ts", "6 hours", "400 days"), str(tmp_path / "cp"), lambda batch, number: got.extend(batch.collect()), mode="append")
    # sessions still open at the watermark stay in state: all that came out is right
    want = {(r.user_id, r.s.start, r.n) for r in events.groupBy("user_id", F.session_window("ts", "6 hours").alias("s")).agg(F.count("*").alias("n")).collect()}
    assert {(r.user_id, r.start, r.n) for r in got} <= want
