"""Windows, counters, sessions, gates and composite jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


from fenestra.operators import aggregate, quality, upsert, windows
from fenestra.plans.book import Book
from fenestra.sources.tables import table
from fenestra.streaming import counters

BOOK = Book()


@BOOK.query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.latest_per_key(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@BOOK.query("""
WITH m AS (SELECT *, sum(CAST(event_type <> 'error' AS int)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events)
SELECT event_id, CAST(sum(CAST(event_type = 'error' AS int)) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS bigint) AS streak,
 max(CASE WHEN event_type = 'error' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_failure FROM m""")
def failure_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.failure_streak(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") != "error").select("event_id", "streak", "last_failure")


@BOOK.query("""
SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried FROM events""")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("buy", F.when(F.col("event_type") == "purchase", F.col("value")))
    return windows.carry_forward(events, ["user_id"], ["ts", "event_id"], "buy", "carried").select("event_id", "carried")


@BOOK.query("SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS rn FROM part) WHERE rn <= 3")
def sample_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sample_per_group(table(spark, sf_dir, "part"), ["p_brand"], ["p_size", "p_partkey"], 3).select("p_brand", "p_partkey")


@BOOK.query("""
WITH m AS (SELECT date_trunc('month', CAST(o_orderdate AS date)) AS month, count(*) AS n FROM orders GROUP BY 1)
SELECT strftime(month, '%Y-%m-%d') AS month, n, lag(n) OVER (ORDER BY month) AS previous, round((n - lag(n) OVER (ORDER BY month)) / lag(n) OVER (ORDER BY month), 6) AS ratio FROM m""")
def deviation_vs_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly counts against the month before; the window runs over months, not orders."""
    months = table(spark, sf_dir, "orders").groupBy(F.date_format(F.trunc(F.to_date("o_orderdate"), "month"), "yyyy-MM-dd").alias("month")).agg(F.count("*").alias("n"))
    return windows.deviation(months, [], "month", "n").select("month", "n", "previous", F.round("ratio", 6).alias("ratio"))


@BOOK.query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n, round(avg(CAST(event_type = 'error' AS int)), 6) AS error_rate FROM events GROUP BY 1")
def uptime_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("event_type") == "error").cast("int")), 6).alias("error_rate"))


@BOOK.query("SELECT user_id, event_type, count(*) AS hits, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1, 2")
def counter_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state of counters with new events merged in; the stream form keeps the same state."""
    events = table(spark, sf_dir, "events")
    state = counters.counters(events.where("event_id % 3 <> 0"), ["user_id", "event_type"], "ts")
    return upsert.add_counts(state, events.where("event_id % 3 = 0"), ["user_id", "event_type"], "ts")


@BOOK.query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that a gap of six hours ends."""
    return table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), "n")


@BOOK.query("""
WITH s AS (SELECT user_id, event_type, count(*) AS hits, max(ts) AS last FROM events GROUP BY 1, 2), n AS (SELECT CAST(max(ts) AS date) AS today FROM events)
SELECT user_id, event_type, hits FROM s, n WHERE NOT ((hits <= 1 AND date_diff('day', CAST(last AS date), today) > 5) OR (hits <= 2 AND date_diff('day', CAST(last AS date), today) > 15))""")
def decay_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters that have not decayed."""
    events = table(spark, sf_dir, "events")
    today = events.agg(F.to_date(F.max("ts")).alias("today")).first()["today"]
    kept, _ = upsert.decayed(counters.counters(events, ["user_id", "event_type"], "ts"), today, steps=[(1, 5), (2, 15)])
    return kept.select("user_id", "event_type", "hits")


@BOOK.query("""
SELECT gate, value, threshold, CASE WHEN gate IN ('rows') THEN value >= threshold ELSE value <= threshold END AS passed FROM (
 SELECT 'rows' AS gate, CAST(count(*) AS double) AS value, 1000.0 AS threshold FROM part UNION ALL SELECT 'invalid_brand', round(avg(CAST(NOT regexp_matches(p_brand, '^Brand#[0-9]{2}$') AS int)), 9), 0.02 FROM part
 UNION ALL SELECT 'null_brand', CAST(count(*) FILTER (WHERE p_brand IS NULL) AS double), 0.0 FROM part UNION ALL SELECT 'duplicates', round(1 - count(DISTINCT p_name) / count(*), 9), 0.3 FROM part)""")
def quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = {
        "rows": (F.count("*"), 1000.0, True),
        "invalid_brand": (F.round(F.avg((~F.col("p_brand").rlike("^Brand#[0-9]{2}$")).cast("int")), 9), 0.02, False),
        "null_brand": (F.count_if(F.col("p_brand").isNull()), 0.0, False),
        "duplicates": (F.round(F.lit(1.0) - F.count_distinct("p_name") / F.count("*"), 9), 0.3, False),
    }
    return quality.gates(table(spark, sf_dir, "part"), checks)


@BOOK.query("""
WITH p AS (SELECT p_brand, p_size > 25 AS collision, p_type AS expected, [CASE WHEN p_size % 2 = 0 THEN p_type ELSE 'x' END, 'y', CASE WHEN p_size % 3 = 0 THEN p_type ELSE 'z' END] AS predicted FROM part)
SELECT p_brand, collision, count(*) AS n, round(avg(CAST(predicted[1] = expected AS int)), 6) AS top1, round(avg(CAST(list_contains(predicted, expected) AS int)), 6) AS top3 FROM p GROUP BY 1, 2""")
def topk_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    guess = F.array(F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("x"), F.lit("y"), F.when(F.col("p_size") % 3 == 0, F.col("p_type")).otherwise("z"))
    results = table(spark, sf_dir, "part").select("p_brand", (F.col("p_size") > 25).alias("collision"), F.array("p_type").alias("expected"), guess.alias("predicted"))
    found = quality.topk_accuracy(results, "expected", "predicted", ["p_brand", "collision"], [1, 3])
    return found.withColumn("top1", F.round("top1", 6)).withColumn("top3", F.round("top3", 6))


@BOOK.query("""
WITH s AS (SELECT l_partkey, l_suppkey, count(*) AS score, min(l_orderkey) AS src FROM lineitem GROUP BY 1, 2), m AS (SELECT l_partkey, l_suppkey, score, src % 3 AS priority FROM s),
g AS (SELECT *, count(*) OVER (PARTITION BY l_suppkey) AS group_size, row_number() OVER (PARTITION BY l_partkey ORDER BY priority DESC, score DESC, l_suppkey) AS rn FROM m)
SELECT CAST(least(score, 3) AS bigint) AS score_bin, CASE WHEN group_size > 600 THEN 'excluded' ELSE 'kept' END AS gate, count(*) AS n FROM g WHERE rn = 1 GROUP BY 1, 2""")
def composite_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gate chain: sources merged by priority and score, oversized groups excluded, scores binned."""
    scored = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("score"), (F.min("l_orderkey") % 3).alias("priority"))
    sized = scored.withColumn("group_size", F.count("*").over(Window.partitionBy("l_suppkey")))
    best = sized.withColumn("rn", F.row_number().over(Window.partitionBy("l_partkey").orderBy(F.desc("priority"), F.desc("score"), "l_suppkey"))).where("rn = 1")
    gate = F.when(F.col("group_size") > 600, F.lit("excluded")).otherwise(F.lit("kept"))
    return best.groupBy(F.least(F.col("score"), F.lit(3)).cast("bigint").alias("score_bin"), gate.alias("gate")).agg(F.count("*").alias("n"))


@BOOK.query("""
WITH a AS (SELECT p_partkey, p_retailprice AS v FROM part WHERE p_partkey % 10 <> 1), b AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN p_retailprice + 1 ELSE p_retailprice END AS v FROM part WHERE p_partkey % 10 <> 2)
SELECT CASE WHEN a.v IS NULL THEN 'new' WHEN b.v IS NULL THEN 'missing' WHEN a.v <> b.v THEN 'changed' ELSE 'unchanged' END AS change, count(*) AS n FROM a FULL JOIN b USING (p_partkey) GROUP BY 1""")
def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New, missing, changed and unchanged keys between two snapshots."""
    parts = table(spark, sf_dir, "part")
    old = parts.where("p_partkey % 10 <> 1").select("p_partkey", F.col("p_retailprice").alias("v"))
    new = parts.where("p_partkey % 10 <> 2").select("p_partkey", F.when(F.col("p_size") % 5 == 0, F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice")).alias("v"))
    return aggregate.classify_changes(old, new, "p_partkey", "v").groupBy("change").agg(F.count("*").alias("n"))


@BOOK.query("""
SELECT o_custkey AS c_custkey, l_partkey, n FROM (SELECT o_custkey, l_partkey, count(*) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, max(o_orderdate) DESC, l_partkey) AS rn FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2) WHERE rn <= 3""")
def customer_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each customer orders most, the latest first among equals."""
    bought = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey", "l_partkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last"))
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("n"), F.desc("last"), "l_partkey"))
    return bought.withColumn("rn", rank).where("rn <= 3").select(F.col("o_custkey").alias("c_custkey"), "l_partkey", "n")


@BOOK.query("""
SELECT 'p_name' AS "column", round(avg(CAST(nullif(trim(p_name), '') IS NOT NULL AS int)), 6) AS share FROM part UNION ALL SELECT 'p_type', round(avg(CAST(nullif(CASE WHEN p_size % 4 = 0 THEN ' ' ELSE p_type END, ' ') IS NOT NULL AS int)), 6) FROM part""")
def column_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").withColumn("p_type", F.when(F.col("p_size") % 4 == 0, " ").otherwise(F.col("p_type")))
    return quality.coverage(parts, ["p_name", "p_type"]).withColumn("share", F.round("share", 6))


QUERIES, ORACLES = BOOK.queries, BOOK.oracles
