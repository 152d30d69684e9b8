"""Aggregations, votes, merges, registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fenestra.functions import semantics, text
from fenestra.operators import aggregate, match
from fenestra.plans.book import Book
from fenestra.sources.tables import table

BOOK = Book()


@BOOK.query("SELECT l_partkey, count(*) AS n, sum(CAST(l_quantity AS bigint)) AS quantity, max(l_shipdate) AS last FROM lineitem GROUP BY l_partkey ORDER BY n DESC, l_partkey LIMIT 25")
def frequent_items_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"), F.max("l_shipdate").alias("last"))
    return lines.orderBy(F.desc("n"), "l_partkey").limit(25)


@BOOK.query("""
WITH f AS (SELECT l_returnflag AS rf, l_linestatus AS ls, CAST(floor(year(l_shipdate) / 5) * 5 AS bigint) AS y5, CAST(l_quantity > 25 AS int) AS large, CAST(l_discount > 0.05 AS int) AS discounted FROM lineitem)
SELECT rf, ls, y5, n, round(large, 6) AS large, round(discounted, 6) AS discounted, grain FROM (
 SELECT rf, ls, y5, count(*) AS n, avg(large) AS large, avg(discounted) AS discounted, CASE grouping(rf, ls, y5) WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS grain
 FROM f GROUP BY GROUPING SETS ((rf, ls, y5), (rf, ls), (rf, y5))) WHERE n >= CASE grain WHEN 0 THEN 50 WHEN 1 THEN 100 ELSE 200 END""")
def grouping_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of flags at three grains in one pass, each grain with its least support."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("rf"), F.col("l_linestatus").alias("ls"), semantics.bucket(F.year("l_shipdate"), 5).alias("y5"), (F.col("l_quantity") > 25).alias("large"), (F.col("l_discount") > 0.05).alias("discounted"))
    found = aggregate.signatures(lines, [["rf", "ls", "y5"], ["rf", "ls"], ["rf", "y5"]], ["large", "discounted"], [50, 100, 200])
    return found.withColumn("large", F.round("large", 6)).withColumn("discounted", F.round("discounted", 6))


@BOOK.query("""
SELECT p_brand, p_type, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS rank FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2)) WHERE rank <= 5""")
def top_values_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.top_values(table(spark, sf_dir, "part"), ["p_brand"], "p_type", 5).withColumn("rank", F.col("rank").cast("bigint"))


@BOOK.query("""
WITH c AS (SELECT user_id, event_type, count(*) AS votes FROM events GROUP BY 1, 2), t AS (SELECT user_id, sum(votes) AS total FROM c GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, event_type) AS rn FROM c)
SELECT user_id, event_type, votes, CAST(total AS bigint) AS total, round(votes / total, 6) AS ratio, votes / total >= 0.7 AS consensus FROM r JOIN t USING (user_id) WHERE rn = 1""")
def mode_vote_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aggregate.mode_vote(table(spark, sf_dir, "events"), ["user_id"], "event_type")
    return found.withColumn("consensus", F.col("ratio") >= 0.7).withColumn("ratio", F.round("ratio", 6))


@BOOK.query("""
SELECT o_custkey, max(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS "F", max(o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS "O", max(o_orderkey) FILTER (WHERE o_orderstatus = 'P') AS "P" FROM orders GROUP BY o_custkey""")
def pivot_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long rows to one wide row a key, the last written wins; the columns are given, so no extra pass finds them."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.max("o_orderkey"))


@BOOK.query("""
SELECT p_partkey, CASE WHEN p_name LIKE '%red%' THEN 'warm' WHEN p_name LIKE '%blue%' THEN 'cold' WHEN p_name LIKE '%a%' THEN 'vowel' ELSE 'other' END AS category FROM part""")
def rule_argmax_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("a", 0.3, "vowel"), ("blue", 0.8, "cold"), ("red", 0.9, "warm")]
    return table(spark, sf_dir, "part").select("p_partkey", text.best_rule(F.col("p_name"), rules, "other").alias("category"))


@BOOK.query("""
SELECT l_orderkey, min(l_shipdate) AS first, max(l_shipdate) AS last, count(DISTINCT l_partkey) AS n_parts, CASE WHEN count(DISTINCT l_partkey) = 1 THEN 'one' WHEN count(DISTINCT l_partkey) <= 5 THEN 'few' ELSE 'many' END AS size FROM lineitem GROUP BY l_orderkey""")
def article_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"), F.count_distinct("l_partkey").alias("n_parts"))
    return rolled.withColumn("size", semantics.ladder([(F.col("n_parts") == 1, "one"), (F.col("n_parts") <= 5, "few")], "many"))


@BOOK.query("""
WITH c AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey)
SELECT (SELECT n FROM c ORDER BY n OFFSET (SELECT CAST(floor(count(*) / 2) AS bigint) FROM c) LIMIT 1) AS median, round(avg(n), 6) AS mean FROM c""")
def group_size_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper middle of group sizes, from a histogram of sizes, and their mean."""
    sizes = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("groups"))
    upto = F.sum("groups").over(Window.orderBy("n"))
    total = F.sum("groups").over(Window.partitionBy())
    ranked = sizes.withColumn("upto", upto).withColumn("total", total)
    return ranked.agg(F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("n"))).alias("median"), F.round(F.sum(F.col("n") * F.col("groups")) / F.sum("groups"), 6).alias("mean"))


@BOOK.query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS large, round(sum(value), 3) AS total FROM events GROUP BY event_type")
def endpoint_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("large"), F.round(F.sum("value"), 3).alias("total"))


@BOOK.query("""
SELECT p_name, count(*) AS n, arg_min(p_brand, p_partkey) AS first_owner, round(1 - 1.0 / count(*), 6) AS duplicate_ratio FROM part GROUP BY p_name HAVING count(*) > 1""")
def duplicate_key_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_name").agg(F.count("*").alias("n"), F.min_by("p_brand", "p_partkey").alias("first_owner")).where("n > 1").withColumn("duplicate_ratio", F.round(F.lit(1.0) - F.lit(1.0) / F.col("n"), 6))


@BOOK.query("SELECT p_brand, min(p_size) AS lo, max(p_size) AS hi, count(*) AS n, list_aggregate(list_sort(list(DISTINCT p_type)), 'string_agg', ',') AS types FROM part GROUP BY p_brand")
def range_rollup_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi"), F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("p_type")), ",").alias("types"))


@BOOK.query("""
SELECT l_partkey, l_suppkey, group_size, rank_in_group, CASE WHEN group_size <= 1 THEN 'unique' WHEN group_size <= 20 THEN 'small' ELSE 'collision' END AS tag FROM
(SELECT l_partkey, l_suppkey, count(*) OVER (PARTITION BY l_partkey) AS group_size, row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey) AS rank_in_group FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem))""")
def collision_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aggregate.collision_registry(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", [(1, "unique"), (20, "small")], "collision")
    return found.withColumn("rank_in_group", F.col("rank_in_group").cast("bigint"))


@BOOK.query("""
WITH s AS (SELECT c_custkey, 1 AS p, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name, c_acctbal > 5000 AS rich, c_mktsegment AS seg FROM customer
 UNION ALL SELECT c_custkey, 2, c_name || ' (orders)', false, 'X' FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 3, 'unknown', c_acctbal < 0, c_mktsegment FROM customer)
SELECT c_custkey, arg_min(name, p) FILTER (WHERE name IS NOT NULL) AS name, bool_or(rich) AS rich, list_aggregate(list_sort(list(DISTINCT seg)), 'string_agg', '+') AS segs,
  arg_min(name, -1000000 * length(name) + p) FILTER (WHERE name IS NOT NULL) AS longest FROM s GROUP BY c_custkey""")
def priority_survivorship_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sources by priority: first value, any flag, all segments, longest text."""
    c = table(spark, sf_dir, "customer")
    one = c.select("c_custkey", F.lit(1).alias("p"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("name"), (F.col("c_acctbal") > 5000).alias("rich"), F.col("c_mktsegment").alias("segs"))
    two = c.where("c_custkey % 3 = 0").select("c_custkey", F.lit(2).alias("p"), F.concat("c_name", F.lit(" (orders)")).alias("name"), F.lit(False).alias("rich"), F.lit("X").alias("segs"))
    three = c.select("c_custkey", F.lit(3).alias("p"), F.lit("unknown").alias("name"), (F.col("c_acctbal") < 0).alias("rich"), F.col("c_mktsegment").alias("segs"))
    rows = one.unionByName(two).unionByName(three).withColumn("longest", F.col("name"))
    merged = aggregate.survivorship(rows, "c_custkey", "p", first=["name"], flags=["rich"], sets=["segs"], longest=["longest"])
    return merged.withColumn("segs", F.array_join("segs", "+"))


@BOOK.query("""
WITH s AS (SELECT DISTINCT l_orderkey, p_type FROM lineitem JOIN part ON l_partkey = p_partkey), b AS (SELECT a.p_type, b.p_type AS other, count(*) AS n_both FROM s a JOIN s b USING (l_orderkey) WHERE a.p_type <> b.p_type GROUP BY 1, 2),
i AS (SELECT p_type, count(*) AS n_item FROM s GROUP BY 1)
SELECT p_type, other, n_both, n_item, round(n_both / n_item, 6) AS ratio FROM b JOIN i USING (p_type) WHERE n_both >= 50 AND n_both / n_item >= 0.3""")
def cooccurrence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    found = aggregate.co_occurrence(lines, "l_orderkey", "p_type").withColumn("ratio", F.col("n_both") / F.col("n_item"))
    return found.where("n_both >= 50 AND ratio >= 0.3").select("p_type", "other", "n_both", "n_item", F.round("ratio", 6).alias("ratio"))


@BOOK.query("SELECT CAST(floor(p_retailprice / 100) * 100 AS bigint) AS bin, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size, count(*) AS n FROM part GROUP BY 1, 2")
def histogram_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = semantics.ladder([(F.col("p_size") < 10, "small"), (F.col("p_size") < 30, "medium")], "large")
    return table(spark, sf_dir, "part").groupBy(semantics.bucket(F.col("p_retailprice"), 100).alias("bin"), size.alias("size")).agg(F.count("*").alias("n"))


@BOOK.query("""
SELECT p_brand, count(*) AS n, count(*) FILTER (WHERE l IS NOT NULL) AS matched, round(count(*) FILTER (WHERE l IS NOT NULL) / count(*), 6) AS share FROM part LEFT JOIN (SELECT DISTINCT l_partkey AS l FROM lineitem WHERE l_quantity > 45) ON l = p_partkey GROUP BY p_brand""")
def coverage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"), F.lit(True).alias("sold")).distinct()
    met = table(spark, sf_dir, "part").join(sold, "p_partkey", "left")
    return met.groupBy("p_brand").agg(F.count("*").alias("n"), F.count("sold").alias("matched")).withColumn("share", F.round(F.col("matched") / F.col("n"), 6))


@BOOK.query("""
SELECT p_brand, count(*) FILTER (WHERE p_size % 4 = 0) AS without, count(*) FILTER (WHERE p_size % 4 <> 0) AS with_key, coalesce(list_aggregate(list_sort(list(p_partkey) FILTER (WHERE p_size % 4 = 0))[1:10], 'string_agg', ','), '') AS sample FROM part GROUP BY p_brand HAVING without > 0 ORDER BY without DESC, p_brand""")
def gap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a brand with and without a key, and the ten smallest parts without: ranked before they become a list."""
    gap, parts = F.col("p_size") % 4 == 0, table(spark, sf_dir, "part")
    counts = parts.groupBy("p_brand").agg(F.count_if(gap).alias("without"), F.count_if(~gap).alias("with_key")).where("without > 0")
    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    least = parts.where(gap).select("p_brand", "p_partkey", rank.alias("rank")).where("rank <= 10")
    samples = least.groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_list("p_partkey")), ",").alias("sample"))
    return counts.join(samples, "p_brand").select("p_brand", "without", "with_key", "sample").orderBy(F.desc("without"), "p_brand")


@BOOK.query("""
WITH a AS (SELECT user_id, avg(CAST(event_type = 'view' AS int)) AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id, avg(CAST(event_type = 'view' AS int)) AS v FROM events WHERE event_id % 2 = 1 GROUP BY 1),
j AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.v, 0) AS before, coalesce(b.v, 0) AS after FROM a FULL JOIN b ON a.user_id = b.user_id)
SELECT user_id, round(before, 6) AS before, round(after, 6) AS after FROM j WHERE abs(after - before) >= 0.2""")
def signature_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda part: table(spark, sf_dir, "events").where(f"event_id % 2 = {part}").groupBy("user_id").agg(F.avg((F.col("event_type") == "view").cast("int")).alias("v"))
    return aggregate.drift(share(0), share(1), ["user_id"], "v", 0.2).select("user_id", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"))


@BOOK.query("""
SELECT event_type, count(*) AS n, list_sort(list(value))[least(count(*), CAST(floor(count(*) * 0.95) AS bigint) + 1)] AS p95, list_sort(list(value))[least(count(*), CAST(floor(count(*) * 0.5) AS bigint) + 1)] AS p50
FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 1000 GROUP BY event_type""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles over the last 1000 values of each type: the list in memory is bounded by that."""
    from fenestra.operators.windows import keep_last

    recent = keep_last(table(spark, sf_dir, "events"), ["event_type"], ["ts", "event_id"], 1000)
    return recent.groupBy("event_type").agg(F.count("*").alias("n"), semantics.percentile_at(F.col("value"), 0.95).alias("p95"), semantics.percentile_at(F.col("value"), 0.5).alias("p50"))


@BOOK.query("""
SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def nested_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions with nations with their totals, nested and laid flat again."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    totals = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    tree = nations.join(totals, "n_nationkey").groupBy("r_name").agg(F.map_from_entries(F.collect_list(F.struct("n_name", F.struct("customers", "balance")))).alias("nations"))
    return tree.select("r_name", F.explode("nations").alias("n_name", "t")).select("r_name", "n_name", "t.customers", "t.balance")


@BOOK.query("SELECT l_orderkey, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 4) AS net, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 6) AS gross FROM lineitem GROUP BY l_orderkey")
def quote_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.round(F.sum(net), 4).alias("net"), F.round(F.sum(net * (1 + F.col("l_tax"))), 6).alias("gross"))


@BOOK.query("""
WITH t AS (SELECT DISTINCT unnest(string_split(p_name || ' ' || p_partkey % 40, ' ')) AS token, p_brand FROM part)
SELECT token, count(*) AS n_brands, CASE WHEN count(*) = 1 THEN min(p_brand) END AS owner FROM t GROUP BY token""")
def inverted_index_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "part").select("p_brand", F.explode(F.split(F.concat_ws(" ", "p_name", (F.col("p_partkey") % 40).cast("string")), " ")).alias("token")).distinct()
    return tokens.groupBy("token").agg(F.count("*").alias("n_brands"), F.min("p_brand").alias("b")).select("token", "n_brands", F.when(F.col("n_brands") == 1, F.col("b")).alias("owner"))


@BOOK.query("""
SELECT user_id, n, buys >= 0.5 AS buyer, views >= 0.5 AS viewer FROM (SELECT user_id, count(*) AS n, avg(CAST(event_type = 'purchase' AS int)) AS buys, avg(CAST(event_type = 'view' AS int)) AS views FROM events GROUP BY 1) WHERE n >= 3""")
def avg_flags_min_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda kind: F.avg((F.col("event_type") == kind).cast("int")) >= 0.5
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), share("purchase").alias("buyer"), share("view").alias("viewer")).where("n >= 3")


@BOOK.query("SELECT CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'urgent' WHEN o_orderpriority LIKE '5%' THEN 'low' ELSE 'other' END AS bucket, count(*) AS n FROM orders GROUP BY 1")
def other_bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = F.create_map(*(F.lit(x) for kv in {"1": "urgent", "2": "urgent", "5": "low"}.items() for x in kv))
    return table(spark, sf_dir, "orders").groupBy(F.coalesce(F.try_element_at(groups, F.substring("o_orderpriority", 1, 1)), F.lit("other")).alias("bucket")).agg(F.count("*").alias("n"))


@BOOK.query("SELECT p_brand, p_name, min(p_partkey) AS first_key, count(*) AS evidence FROM part GROUP BY 1, 2")
def evidence_per_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("first_key"), F.count("*").alias("evidence"))


@BOOK.query("SELECT p_brand, p_name, count(DISTINCT p_type) AS variants FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_type) > 1")
def variant_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_name").agg(F.count_distinct("p_type").alias("variants")).where("variants > 1")


@BOOK.query("SELECT substr(p_name, 1, 3) AS prefix, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, prefix LIMIT 5")
def prefix_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.substring("p_name", 1, 3).alias("prefix")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "prefix").limit(5)


@BOOK.query("""
WITH known AS (SELECT * FROM part WHERE p_partkey % 5 <> 0),
a AS (SELECT p_brand, p_name, p_type, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY count(*) DESC, p_type) AS rn FROM known WHERE p_size < 25 GROUP BY 1, 2, 3),
b AS (SELECT p_name, p_type, row_number() OVER (PARTITION BY p_name ORDER BY count(*) DESC, p_type) AS rn FROM known WHERE p_size < 25 GROUP BY 1, 2),
c AS (SELECT p_type, row_number() OVER (ORDER BY count(*) DESC, p_type) AS rn FROM known WHERE p_size < 25 GROUP BY 1)
SELECT p.p_partkey, coalesce(a.p_type, b.p_type, c.p_type) AS kind, CASE WHEN a.p_type IS NOT NULL THEN 0 WHEN b.p_type IS NOT NULL THEN 1 ELSE 2 END AS grain
FROM part p LEFT JOIN a ON a.p_brand = p.p_brand AND a.p_name = p.p_name AND a.rn = 1 LEFT JOIN b ON b.p_name = p.p_name AND b.rn = 1 LEFT JOIN c ON c.rn = 1 WHERE p.p_partkey % 5 = 0""")
def fallback_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent type by brand and name, else by name, else of all."""
    parts = table(spark, sf_dir, "part")
    known = parts.where("p_partkey % 5 <> 0 AND p_size < 25").select("p_brand", "p_name", F.col("p_type").alias("kind"))
    probes = parts.where("p_partkey % 5 = 0").select("p_partkey", "p_brand", "p_name")
    return aggregate.fallback_modes(known, probes, [["p_brand", "p_name"], ["p_name"], []], "kind").select("p_partkey", "kind", "grain")


@BOOK.query("""
SELECT 'brand' AS facet, p_brand AS value, n FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 10) UNION ALL SELECT 'type', p_type, count(*) FROM part GROUP BY p_type
UNION ALL SELECT 'min_size', CAST(min(p_size) AS varchar), count(*) FROM part UNION ALL SELECT 'max_size', CAST(max(p_size) AS varchar), count(*) FROM part""")
def source_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    top = parts.groupBy(F.col("p_brand").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(10).select(F.lit("brand").alias("facet"), "value", "n")
    kinds = parts.groupBy(F.col("p_type").alias("value")).agg(F.count("*").alias("n")).select(F.lit("type").alias("facet"), "value", "n")
    ends = parts.agg(F.min("p_size").cast("string").alias("min_size"), F.max("p_size").cast("string").alias("max_size"), F.count("*").alias("n")).unpivot(["n"], ["min_size", "max_size"], "facet", "value")
    return top.unionByName(kinds).unionByName(ends.select("facet", "value", "n"))


@BOOK.query("""
SELECT p_partkey, confidence, evidence FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY confidence DESC, evidence DESC, p_partkey) AS rn FROM
 (SELECT p_partkey, p_brand, p_size % 10 / 10.0 AS confidence, p_size AS evidence FROM part)) WHERE rn = 1""")
def rule_pick_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = table(spark, sf_dir, "part").select("p_partkey", "p_brand", (F.col("p_size") % 10 / 10.0).alias("confidence"), F.col("p_size").alias("evidence"))
    best = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("confidence"), F.desc("evidence"), "p_partkey"))
    return rules.withColumn("rn", best).where("rn = 1").select("p_partkey", "confidence", "evidence")


@BOOK.query("""
WITH s AS (SELECT p_partkey, p_brand, CASE WHEN p_type LIKE '%MEDIUM' THEN 1000 ELSE 0 END + CASE WHEN p_size BETWEEN 10 AND 20 THEN 50 ELSE -10 END - abs(p_size - 15) AS score FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) AS rank FROM s)
SELECT p_partkey, p_brand, score, rank FROM r WHERE rank <= 5""")
def candidate_score_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by a sum of bonuses and penalties, the best five of each block."""
    score = F.when(F.col("p_type").like("%MEDIUM"), 1000).otherwise(0) + F.when(F.col("p_size").between(10, 20), 50).otherwise(-10) - F.abs(F.col("p_size") - 15)
    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("score"), "p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", score.alias("score")).withColumn("rank", rank.cast("bigint")).where("rank <= 5")


@BOOK.query("""
SELECT p_brand, CASE WHEN count(DISTINCT p_size > 45) > 1 THEN 'size' WHEN count(DISTINCT p_type) > 1 THEN 'type' ELSE 'none' END AS question FROM part WHERE p_name LIKE 's%' AND p_size > 44 GROUP BY p_brand""")
def next_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first field, by priority, in which the candidates still differ."""
    from fenestra.functions.flags import next_question as first

    counts = table(spark, sf_dir, "part").where(F.col("p_name").like("s%") & (F.col("p_size") > 44)).groupBy("p_brand").agg(F.count_distinct(F.col("p_size") > 45).alias("size"), F.count_distinct("p_type").alias("type"))
    return counts.select("p_brand", first({"size": F.col("size"), "type": F.col("type")}).alias("question"))


@BOOK.query(r"""
WITH b AS (SELECT item_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(text, '[^A-Za-z ]', '', 'g')), ' +'), lambda x: length(x) >= 6))) AS w FROM benchmark),
d AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(text, '[^A-Za-z ]', '', 'g')), ' +'), lambda x: length(x) >= 6))) AS w FROM documents),
s AS (SELECT doc_id, item_id, count(*) AS score FROM d JOIN b USING (w) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS rn FROM s)
SELECT doc_id, item_id, score FROM r WHERE rn = 1 AND score >= 3""")
def faq_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article with most telling words in common with a text: an equality join on words."""
    words = lambda d, key: d.select(key, F.explode(F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace("text", "[^A-Za-z ]", "")), " +"), lambda x: F.length(x) >= 6))).alias("w"))
    hits = words(table(spark, sf_dir, "documents"), "doc_id").join(words(table(spark, sf_dir, "benchmark"), "item_id"), "w").groupBy("doc_id", "item_id").agg(F.count("*").alias("score"))
    return match.best_with_gap(hits, ["doc_id"], "score", ["item_id"]).where("score >= 3").select("doc_id", "item_id", "score")


QUERIES, ORACLES = BOOK.queries, BOOK.oracles
