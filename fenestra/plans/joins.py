"""Joins and resolution by analogy on the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fenestra.functions import semantics, similarity
from fenestra.operators import match, overlaps, within
from fenestra.plans.book import Book
from fenestra.sources.tables import table

BOOK = Book()

FAMILY_SQL = """
families AS (SELECT row_number() OVER (ORDER BY p_brand, p_name, p_type) AS family, p_brand, lo, hi, w FROM
  (SELECT p_brand, p_name, p_type, min(p_size) AS lo, max(p_size) AS hi, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) AS w FROM part GROUP BY p_brand, p_name, p_type)),
products AS (SELECT p_partkey, p_brand, p_size, list_distinct(string_split(lower(CASE WHEN p_partkey % 5 = 0 THEN split_part(p_name, ' ', 1) || ' unknown' WHEN p_partkey % 3 = 0 THEN p_name ELSE p_name || ' ' || p_type END), ' ')) AS w FROM part)"""


def families(parts: DataFrame) -> DataFrame:
    """Groups of a catalogue by brand, name and type: their number, range of sizes, members and tokens."""
    grouped = parts.groupBy("p_brand", "p_name", "p_type").agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi"), F.count("*").alias("members"))
    tokens = F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " "))
    return match.numbered(grouped, "p_brand", ["p_name", "p_type"], "family").select("p_brand", "family", "lo", "hi", "members", tokens.alias("f_tokens"), F.size(tokens).alias("f_n"))


def product_tokens():
    k = F.col("p_partkey")
    text = F.when(k % 5 == 0, F.concat(F.split("p_name", " ")[0], F.lit(" unknown"))).when(k % 3 == 0, F.col("p_name")).otherwise(F.concat_ws(" ", "p_name", "p_type"))
    return F.array_distinct(F.split(F.lower(text), " "))


def _products(parts: DataFrame) -> DataFrame:
    """Parts with their distinct tokens in one string, which is a cheaper key than an array."""
    return parts.select("p_partkey", "p_brand", "p_size", F.array_join(product_tokens(), " ").alias("p_text"))


def _near_families(products: DataFrame, groups: DataFrame) -> DataFrame:
    """p_brand, p_text, family, lo, hi, members, jaccard: distinct texts and the families of their brand with a common token."""
    texts = products.select("p_brand", "p_text").distinct().withColumn("p_tokens", F.split("p_text", " "))
    met = match.shared_tokens(texts, groups, ["p_brand"], ["p_text"], ["family"], tokens=("p_tokens", "f_tokens"))
    met = met.join(groups.select("family", "lo", "hi", "members", "f_n"), "family")
    return met.withColumn("jaccard", F.col("shared") / (F.size(F.split("p_text", " ")) + F.col("f_n") - F.col("shared"))).drop("shared", "f_n")


@BOOK.query(f"""
WITH {FAMILY_SQL},
s AS (SELECT p_partkey, f.p_brand, f.family, CASE WHEN p_size BETWEEN lo AND hi THEN 1 ELSE 0 END AS inside,
  least(1.0, len(list_intersect(p.w, f.w)) / len(list_distinct(list_concat(p.w, f.w))) + CASE WHEN p_size BETWEEN lo AND hi THEN 0.2 ELSE -0.1 END + CASE WHEN len(list_intersect(p.w, f.w)) > 0 THEN 0.05 ELSE 0 END) AS score
  FROM products p JOIN families f USING (p_brand)),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY round(score, 9) DESC, family) AS rn, lead(score) OVER (PARTITION BY p_partkey ORDER BY round(score, 9) DESC, family) AS second FROM s)
SELECT p_partkey, family, round(score, 6) AS score, round(score - second, 6) AS score_gap,
  CASE WHEN score >= 0.8 AND inside = 1 AND score - coalesce(second, -1) > 0.15 THEN 'high' WHEN score >= 0.5 AND inside = 1 THEN 'medium' ELSE 'low' END AS class FROM r WHERE rn = 1""")
def blocked_fuzzy_join_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products against families of their brand: best and second best by Jaccard, range and shared tokens.

    Scores depend on brand, text and size only, so distinct ones are scored and products
    join the result. Families come from an inverted index of tokens. The range moves a
    score by 0.3 at most, so a family that far behind the second best of a text is in no
    pair of best. Without a common token a family reaches 0.2: only where the second
    best is no better are the other families of the brand looked at.
    """
    parts = table(spark, sf_dir, "part")
    groups = families(parts)
    products = _products(parts)
    asked = products.select("p_brand", "p_text", "p_size").distinct()
    inside = semantics.covers(F.col("lo"), F.col("hi"), F.col("p_size"))
    key, away, near = ["p_brand", "p_text", "p_size"], 0.3, 0.2

    def ranked(pairs: DataFrame, text_score: Column) -> DataFrame:
        score = F.round(F.least(F.lit(1.0), text_score + F.when(inside, near).otherwise(near - away)), 9)
        return match.best_with_gap(pairs.select(*key, "family", inside.alias("inside"), score.alias("score")), key, "score", ["family"])

    texts = _near_families(products, groups).withColumn("text_score", F.col("jaccard") + 0.05)
    by_score = Window.partitionBy("p_brand", "p_text").orderBy(F.desc("text_score"))
    second = F.max(F.when(F.col("n") == 2, F.col("text_score"))).over(Window.partitionBy("p_brand", "p_text"))
    texts = texts.withColumn("n", F.row_number().over(by_score)).withColumn("second", second).where(f"text_score >= coalesce(second, 0) - {away + 1e-6}")
    first = ranked(asked.join(texts, ["p_brand", "p_text"]), F.col("text_score"))
    first = asked.join(first, key, "left").withColumn("sure", F.coalesce(F.col("second_score") > near + 1e-6, F.lit(False)))
    # those that aren't sure meet all families of their brand, the others none
    rest = groups.select(F.col("p_brand").alias("o_brand"), F.col("family").alias("o_family"), "lo", "hi", "f_tokens", F.lit(False).alias("o_sure"))
    wide = first.join(rest, (F.col("p_brand") == F.col("o_brand")) & (F.col("sure") == F.col("o_sure")), "left")
    of_text = similarity.jaccard(F.split("p_text", " "), F.col("f_tokens"))
    other = F.round(F.least(F.lit(1.0), of_text + F.when(of_text > 0, 0.05).otherwise(0.0) + F.when(inside, near).otherwise(near - away)), 9)
    pick = lambda own, new: F.when(F.col("sure"), F.col(own)).otherwise(new)
    wide = wide.select(*key, pick("family", F.col("o_family")).alias("family"), pick("inside", inside).alias("inside"), pick("score", other).alias("score"), F.when(F.col("sure"), F.col("second_score")).alias("known"))
    best = match.best_with_gap(wide, key, "score", ["family"]).withColumn("second_score", F.coalesce("known", "second_score"))
    best = products.join(best.withColumn("score_gap", F.col("score") - F.col("second_score")), key)
    certain = (F.col("score") >= 0.8) & F.col("inside") & (F.col("score") - F.coalesce("second_score", F.lit(-1.0)) > 0.15)
    kind = F.when(certain, F.lit("high")).when((F.col("score") >= 0.5) & F.col("inside"), F.lit("medium")).otherwise(F.lit("low"))
    return best.select("p_partkey", "family", F.round("score", 6).alias("score"), F.round("score_gap", 6).alias("score_gap"), kind.alias("class"))


@BOOK.query("""
WITH k AS (SELECT o_orderkey, o_custkey, o_orderkey % 1000 AS alt FROM orders)
SELECT o_orderkey, coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN a.c_custkey IS NOT NULL THEN 0 WHEN b.c_custkey IS NOT NULL THEN 1 END AS matched_by
FROM k LEFT JOIN customer a ON a.c_custkey = o_custkey AND a.c_custkey % 2 = 0 LEFT JOIN customer b ON b.c_custkey + 5 = o_custkey AND b.c_custkey % 2 = 1""")
def or_key_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders to customers by either of two keys; an equality join on the unpivoted keys."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).alias("k1"), F.when(F.col("c_custkey") % 2 == 1, F.col("c_custkey") + 5).alias("k2"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return match.any_key_join(orders, customers, "o_custkey", ["k1", "k2"], ["o_orderkey"], ["c_custkey"]).select("o_orderkey", "c_custkey", "matched_by")


@BOOK.query("SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def lookup_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "r_name")


@BOOK.query("""
WITH w AS (SELECT l_orderkey, max(CASE WHEN l_linenumber = 1 THEN l_partkey END) AS a, max(CASE WHEN l_linenumber = 2 THEN l_partkey END) AS b FROM lineitem GROUP BY l_orderkey),
u AS (SELECT l_orderkey, 'a' AS slot, a AS p FROM w WHERE a IS NOT NULL UNION ALL SELECT l_orderkey, 'b', b FROM w WHERE b IS NOT NULL)
SELECT l_orderkey, slot, p_brand FROM u JOIN part ON p = p_partkey""")
def unpivot_lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide slots to rows, then to the catalogue."""
    slot = lambda n: F.max(F.when(F.col("l_linenumber") == n, F.col("l_partkey")))
    wide = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(slot(1).alias("a"), slot(2).alias("b"))
    long = wide.unpivot(["l_orderkey"], ["a", "b"], "slot", "p").where("p IS NOT NULL")
    return long.join(table(spark, sf_dir, "part"), F.col("p") == F.col("p_partkey")).select("l_orderkey", "slot", "p_brand")


@BOOK.query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 1)")
def semi_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber = 1")
    return table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@BOOK.query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_missing_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@BOOK.query("""
WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) = 1995), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) = 1996)
SELECT CASE WHEN b.k IS NULL THEN 'only_a' WHEN a.k IS NULL THEN 'only_b' ELSE 'both' END AS side, count(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1""")
def set_overlap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys in one, the other or both sets, by one aggregation instead of a join."""
    orders = table(spark, sf_dir, "orders").where(F.year("o_orderdate").isin(1995, 1996))
    seen = orders.groupBy("o_custkey").agg(F.max(F.year("o_orderdate") == 1995).alias("a"), F.max(F.year("o_orderdate") == 1996).alias("b"))
    return seen.groupBy(F.when(~F.col("b"), F.lit("only_a")).when(~F.col("a"), F.lit("only_b")).otherwise(F.lit("both")).alias("side")).agg(F.count("*").alias("n"))


_RANGES = """
r AS (SELECT o_custkey, c_nationkey, date_diff('day', DATE '1990-01-01', CAST(min(o_orderdate) AS date)) AS lo, date_diff('day', DATE '1990-01-01', CAST(min(o_orderdate) AS date)) + o_custkey % 400 AS hi
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey, c_nationkey)"""


def _active_ranges(orders: DataFrame, customers: DataFrame) -> DataFrame:
    first = orders.groupBy("o_custkey").agg(F.datediff(F.min("o_orderdate"), F.lit("1990-01-01")).alias("lo"))
    return first.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_custkey", "c_nationkey", "lo", (F.col("lo") + F.col("o_custkey") % 400).alias("hi")).distinct()


_BEST_OVERLAP_SQL = """, p AS (SELECT a.o_custkey AS a, b.o_custkey AS b, least(a.hi, b.hi) - greatest(a.lo, b.lo) + 1 AS days FROM r a JOIN r b ON a.c_nationkey = b.c_nationkey AND a.o_custkey < b.o_custkey AND a.lo <= b.hi AND b.lo <= a.hi)
SELECT a, b, CAST(days AS bigint) AS days FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY days DESC, b) AS rn FROM p) WHERE rn = 1"""


@BOOK.query(f"""
WITH {_RANGES}{_BEST_OVERLAP_SQL}""")
def interval_overlap_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best overlaps among all customers with orders, without their pairs."""
    ranges = _active_ranges(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"))
    return overlaps.overlapped_most(ranges.withColumnRenamed("o_custkey", "id"), ["c_nationkey"])


@BOOK.query("""
SELECT o_orderkey, CASE WHEN n = 1 THEN 'exact' WHEN n <= 3 THEN 'probable' ELSE 'possible' END AS confidence, n FROM
(SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey, year(o_orderdate)) AS n FROM orders)""")
def match_count_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("o_custkey", F.year("o_orderdate")))
    return table(spark, sf_dir, "orders").select("o_orderkey", n.alias("n")).select("o_orderkey", semantics.ladder([(F.col("n") == 1, "exact"), (F.col("n") <= 3, "probable")], "possible").alias("confidence"), "n")


@BOOK.query("""
WITH p AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'error'), q AS (SELECT user_id, event_id AS other, ts AS at FROM events WHERE event_type = 'purchase'),
j AS (SELECT p.event_id, q.other, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(epoch_us(p.ts) - epoch_us(q.at)), q.at, q.other) AS rn FROM p JOIN q USING (user_id))
SELECT p.event_id, j.other FROM p LEFT JOIN j ON p.event_id = j.event_id AND rn = 1""")
def nearest_by_abs_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each error the user's nearest purchase in time, before or after, without multiplying them."""
    events = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    errors, buys = events.where("event_type = 'error'"), events.where("event_type = 'purchase'").withColumnRenamed("event_id", "other").withColumnRenamed("us", "at")
    return match.nearest_join(errors, buys, ["user_id"], "us", "at", "event_id", "other").select("event_id", "other")


@BOOK.query("""
WITH j AS (SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_partkey % 25 = s_nationkey AND abs(p_retailprice - s_acctbal) < 800 AND p_size >= s_suppkey % 10)
SELECT p_partkey, list_aggregate(list_sort(list(s_suppkey))[1:5], 'string_agg', ',') AS suppliers, count(*) AS n FROM j GROUP BY p_partkey""")
def theta_multi_predicate_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality on the block, a range of prices and a bound on sizes, a capped list as the result with the whole count beside it.

    Suppliers are offered for each of the sizes 0 to 9 that they are good for, larger ones ask as 9, and equal questions are asked once.
    """
    block, size = F.col("p_partkey") % 25, F.least("p_size", F.lit(9))
    parts = table(spark, sf_dir, "part").where("p_size IS NOT NULL").select("p_partkey", block.alias("block"), size.cast("bigint").alias("size"), F.col("p_retailprice").cast("double").alias("at"))
    suppliers = table(spark, sf_dir, "supplier").where("s_suppkey IS NOT NULL").select(
        F.col("s_nationkey").cast("bigint").alias("block"), F.explode(F.sequence(F.col("s_suppkey") % 10, F.lit(9).cast("bigint"))).alias("size"), F.col("s_acctbal").cast("double").alias("value"), F.col("s_suppkey").alias("item")
    )
    near = within.least_within(parts, suppliers, ["block", "size"], reach=800.0, keep=5)
    met = parts.join(near, ["block", "size", "at"]).groupBy("p_partkey").agg(within.least_of("items", 5).alias("items"), F.sum("n").alias("n"))
    return met.select("p_partkey", F.array_join(F.col("items").cast("array<string>"), ",").alias("suppliers"), "n")


@BOOK.query("""
WITH e AS (SELECT l_partkey AS k, round(max(l_extendedprice / l_quantity), 2) AS price FROM lineitem WHERE l_partkey % 3 = 0 GROUP BY l_partkey),
b AS (SELECT p_brand, p_type, round(avg(p_retailprice), 2) AS price FROM part WHERE p_size % 2 = 0 GROUP BY p_brand, p_type), t AS (SELECT p_type, round(avg(p_retailprice), 2) AS price FROM part GROUP BY p_type),
j AS (SELECT p_partkey, p_retailprice AS old, coalesce(e.price, b.price, t.price) AS new, CASE WHEN e.price IS NOT NULL THEN 0 WHEN b.price IS NOT NULL THEN 1 ELSE 2 END AS layer
 FROM part LEFT JOIN e ON p_partkey = k LEFT JOIN b USING (p_brand, p_type) LEFT JOIN t ON part.p_type = t.p_type)
SELECT layer, CASE WHEN abs(new - old) < 1 THEN 'unchanged' WHEN new > old THEN 'up' ELSE 'down' END AS change, count(*) AS n FROM j GROUP BY 1, 2""")
def waterfall_price_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices from three layers, the first that has one, and how they change."""
    parts = table(spark, sf_dir, "part")
    exact = table(spark, sf_dir, "lineitem").where("l_partkey % 3 = 0").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.round(F.max(F.col("l_extendedprice") / F.col("l_quantity")), 2).alias("e"))
    brand = parts.where("p_size % 2 = 0").groupBy("p_brand", "p_type").agg(F.round(F.avg("p_retailprice"), 2).alias("b"))
    kind = parts.groupBy("p_type").agg(F.round(F.avg("p_retailprice"), 2).alias("t"))
    met = parts.join(exact, "p_partkey", "left").join(brand, ["p_brand", "p_type"], "left").join(kind, "p_type", "left")
    layer = semantics.ladder([(F.col("e").isNotNull(), 0), (F.col("b").isNotNull(), 1)], 2)
    new = F.coalesce("e", "b", "t")
    change = semantics.ladder([(F.abs(new - F.col("p_retailprice")) < 1, "unchanged"), (new > F.col("p_retailprice"), "up")], "down")
    return met.groupBy(layer.alias("layer"), change.alias("change")).agg(F.count("*").alias("n"))


@BOOK.query("SELECT p_partkey, p_size AS year_from, max(p_size) OVER (PARTITION BY p_brand, p_name) AS year_to FROM part")
def sibling_end_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("year_from"), F.max("p_size").over(Window.partitionBy("p_brand", "p_name")).alias("year_to"))


_VERIFIER_SQL = """
WITH f AS (SELECT p_partkey AS f_key, p_brand AS f_brand, p_name AS f_name, p_type AS f_type FROM part),
m AS (SELECT f_key, p_partkey, CASE WHEN f_brand = p_brand THEN 25 ELSE 0 END + CASE WHEN f_name = p_name THEN 25 ELSE 0 END + CASE WHEN f_type = p_type THEN 25 ELSE 0 END AS score FROM f JOIN part ON (f_brand = p_brand AND f_name = p_name) OR (f_name = p_name AND f_type = p_type) WHERE f_key <> p_partkey),
b AS (SELECT *, row_number() OVER (PARTITION BY f_key ORDER BY p_partkey) AS rn FROM m)
SELECT f_key, p_partkey, score, CASE WHEN score >= 75 THEN 'exact' WHEN score >= 50 THEN 'probable' ELSE 'weak' END AS bucket FROM b WHERE rn = 1"""


def _verified(findings: DataFrame, parts: DataFrame) -> DataFrame:
    """Findings met by either of two composite keys; the first match by key is scored and bucketed."""
    keyed = lambda d: d.withColumn("k", F.explode(F.array(F.concat_ws("|", F.lit("bn"), "p_brand", "p_name"), F.concat_ws("|", F.lit("nt"), "p_name", "p_type"))))
    found = keyed(findings).select("k", F.col("p_partkey").alias("f_key"), F.col("p_brand").alias("f_brand"), F.col("p_name").alias("f_name"), F.col("p_type").alias("f_type"))
    # of each key only the two smallest parts can be the first other match of a finding
    first = F.row_number().over(Window.partitionBy("k").orderBy("p_partkey"))
    heads = keyed(parts).withColumn("n", first).where("n <= 2")
    same = lambda a, b: F.when(F.col(a) == F.col(b), 25).otherwise(0)
    pairs = found.join(heads, "k").where("f_key <> p_partkey").select("f_key", "p_partkey", (same("f_brand", "p_brand") + same("f_name", "p_name") + same("f_type", "p_type")).alias("score"))
    best = pairs.groupBy("f_key").agg(F.min_by(F.struct("p_partkey", "score"), "p_partkey").alias("m")).select("f_key", "m.*")
    return best.withColumn("bucket", similarity.level(F.col("score"), [(75, "exact"), (50, "probable")], "weak"))


@BOOK.query(_VERIFIER_SQL)
def or_match_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a finding."""
    parts = table(spark, sf_dir, "part")
    return _verified(parts, parts)


@BOOK.query("""
WITH l AS (SELECT o_orderkey, 0 AS layer, 'status ' || o_orderstatus AS code FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 50000
 UNION ALL SELECT o_orderkey, 1, 'priority ' || o_orderpriority FROM orders WHERE o_totalprice > 20000 UNION ALL SELECT o_orderkey, 2, 'any' FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY layer) AS rn FROM l)
SELECT o_orderkey, layer, code, CASE layer WHEN 0 THEN 'exact' WHEN 1 THEN 'good' ELSE 'guess' END AS confidence FROM r WHERE rn = 1""")
def layered_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered strategies; the first with a result decides code and confidence."""
    orders = table(spark, sf_dir, "orders")
    layers = [
        orders.where("o_orderstatus = 'F' AND o_totalprice > 50000").select("o_orderkey", F.concat(F.lit("status "), "o_orderstatus").alias("code")),
        orders.where("o_totalprice > 20000").select("o_orderkey", F.concat(F.lit("priority "), "o_orderpriority").alias("code")),
        orders.select("o_orderkey", F.lit("any").alias("code")),
    ]
    best = match.ordered_layers(layers, ["o_orderkey"], ["code"])
    return best.select("o_orderkey", "layer", "code", semantics.ladder([(F.col("layer") == 0, "exact"), (F.col("layer") == 1, "good")], "guess").alias("confidence"))


@BOOK.query(f"""
WITH {FAMILY_SQL}, s AS (SELECT p_partkey, family, len(list_intersect(p.w, f.w)) / len(list_distinct(list_concat(p.w, f.w))) AS score FROM products p JOIN families f USING (p_brand) WHERE p_size BETWEEN lo AND hi),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY round(score, 9) DESC, family) AS rn FROM s),
m AS (SELECT family, count(*) AS members FROM families f JOIN part p ON f.p_brand = p.p_brand AND f.w = list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) GROUP BY family)
SELECT p_partkey, r.family, round(score, 6) AS score, members FROM r JOIN m USING (family) WHERE rn = 1 AND score >= 0.3""")
def family_range_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The family whose range holds a product and whose tokens are nearest, with its number of members."""
    parts = table(spark, sf_dir, "part")
    products = _products(parts)
    texts = _near_families(products, families(parts)).withColumn("score", F.round("jaccard", 9)).where("score >= 0.3")
    pairs = products.join(texts, ["p_brand", "p_text"]).where(semantics.covers(F.col("lo"), F.col("hi"), F.col("p_size")))
    best = pairs.groupBy("p_partkey").agg(F.min(F.struct((-F.col("score")).alias("less"), "family", "members")).alias("m"))
    return best.select("p_partkey", "m.family", F.round(-F.col("m.less"), 6).alias("score"), "m.members")


def _nearest_seeds(seeds: DataFrame, asked: DataFrame, block: list[str]) -> DataFrame:
    """Of each block and size asked for, the three seeds nearest in size (off: by how much), then smallest."""
    smallest = F.row_number().over(Window.partitionBy(*block, "p_size").orderBy("p_partkey"))
    heads = seeds.withColumn("n", smallest).where("n <= 3").select(*block, F.col("p_partkey").alias("seed"), F.col("p_size").alias("s_size"))
    pairs = asked.select(*block, "p_size").distinct().join(heads, block).withColumn("off", F.abs(F.col("p_size") - F.col("s_size")))
    # beyond 50 the size counts no more
    nearest = F.row_number().over(Window.partitionBy(*block, "p_size").orderBy(F.least("off", F.lit(50)), "seed"))
    return pairs.withColumn("n", nearest).where("n <= 3").select(*block, "p_size", "seed", "off")


_NEIGHBOUR_SQL = """
WITH s AS (SELECT p_partkey AS seed, p_brand, p_size AS s_size, p_type AS s_type FROM part WHERE p_partkey % 20 = 0), q AS (SELECT * FROM part WHERE p_partkey % 20 <> 0),
j AS (SELECT p_partkey, seed, CASE WHEN p_type = s_type THEN 0.6 ELSE 0 END + 0.4 * greatest(0, 1 - abs(p_size - s_size) / 50.0) AS score FROM q JOIN s USING (p_brand)),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY round(score, 9) DESC, seed) AS rn FROM j WHERE score >= 0.3)
SELECT p_partkey, seed, round(score, 6) AS score, rn AS rank, score >= 0.85 AS accepted FROM r WHERE rn <= 3"""


@BOOK.query(_NEIGHBOUR_SQL)
def weighted_neighbour_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three nearest seeds of a block by weighted agreement, for every part that is no seed.

    The score depends on brand, type and size only, so distinct keys are scored and
    parts join the results. The best three of a key are among the three nearest in
    size of its brand and type and the three nearest of its brand; of equal seeds only the three
    smallest can be. So no join holds more rows than the keys that occur.
    """
    parts = table(spark, sf_dir, "part")
    seeds, asked = parts.where("p_partkey % 20 = 0"), parts.where("p_partkey % 20 <> 0")
    met = [_nearest_seeds(seeds, asked, block) for block in (["p_brand", "p_type"], ["p_brand"])]
    keys = asked.select("p_brand", "p_type", "p_size").distinct()
    same_type = keys.join(met[0], ["p_brand", "p_type", "p_size"]).select("p_brand", "p_type", "p_size", "seed", "off", F.lit(True).alias("same"))
    types = seeds.select(F.col("p_partkey").alias("seed"), F.col("p_type").alias("s_type"))
    any_type = keys.join(met[1], ["p_brand", "p_size"]).join(types, "seed").where("NOT p_type <=> s_type OR p_type IS NULL").select("p_brand", "p_type", "p_size", "seed", "off", F.lit(False).alias("same"))
    score = F.round(F.when(F.col("same"), 0.6).otherwise(0.0) + F.greatest(F.lit(0.0), F.lit(1.0) - F.col("off") / 50.0) * 0.4, 9)
    rank = F.row_number().over(Window.partitionBy("p_brand", "p_type", "p_size").orderBy(F.desc("score"), "seed"))
    best = same_type.unionByName(any_type).withColumn("score", score).where("score >= 0.3").withColumn("rank", rank.cast("bigint")).where("rank <= 3")
    best = best.select("p_brand", F.col("p_type").alias("t"), "p_size", "seed", "score", "rank")
    return asked.join(best, (asked["p_brand"] == best["p_brand"]) & (asked["p_size"] == best["p_size"]) & F.col("p_type").eqNullSafe(F.col("t"))).select("p_partkey", "seed", F.round("score", 6).alias("score"), "rank", (F.col("score") >= 0.85).alias("accepted"))


@BOOK.query("""
WITH pool AS (SELECT n_name, n_nationkey FROM nation WHERE n_nationkey % 2 = 0), alias AS (SELECT n_name, n_nationkey - 1 AS n_nationkey FROM nation WHERE n_nationkey % 4 = 2),
c AS (SELECT c_custkey, c_nationkey FROM customer)
SELECT c_custkey, CASE WHEN p.n_name IS NOT NULL THEN 0 WHEN a.n_name IS NOT NULL THEN 1 ELSE 2 END AS pool, coalesce(p.n_name, a.n_name, (SELECT min(n_name) FROM nation)) AS name
FROM c LEFT JOIN pool p USING (n_nationkey) LEFT JOIN alias a USING (n_nationkey)""".replace("USING (n_nationkey)", "ON c_nationkey = {x}.n_nationkey").replace("pool p ON c_nationkey = {x}", "pool p ON c_nationkey = p").replace("alias a ON c_nationkey = {x}", "alias a ON c_nationkey = a"))
def resolver_pool_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact pool, then the pool of aliases, then one answer for all the rest."""
    nations = table(spark, sf_dir, "nation")
    pool = nations.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("p"))
    alias = nations.where("n_nationkey % 4 = 2").select((F.col("n_nationkey") - 1).alias("c_nationkey"), F.col("n_name").alias("a"))
    met = table(spark, sf_dir, "customer").join(pool, "c_nationkey", "left").join(alias, "c_nationkey", "left").withColumn("z", nations.agg(F.min("n_name")).scalar())
    return met.select("c_custkey", semantics.ladder([(F.col("p").isNotNull(), 0), (F.col("a").isNotNull(), 1)], 2).alias("pool"), F.coalesce("p", "a", "z").alias("name"))


@BOOK.query("""
WITH g AS (SELECT DISTINCT p_brand, split_part(p_name, ' ', 1) AS gap FROM part WHERE p_size > 45), j AS (SELECT p_partkey, gap, row_number() OVER (PARTITION BY p_partkey ORDER BY gap) AS rn FROM part JOIN g USING (p_brand) WHERE contains(p_name, gap) OR contains(gap, p_name))
SELECT p_partkey, gap FROM j WHERE rn = 1""")
def containment_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first gap of a brand that a name holds or that holds it."""
    parts = table(spark, sf_dir, "part")
    gaps = parts.where("p_size > 45").select("p_brand", F.split("p_name", " ")[0].alias("gap")).distinct()
    pairs = parts.join(gaps, "p_brand").where(F.contains("p_name", "gap") | F.contains("gap", "p_name"))
    return pairs.groupBy("p_partkey").agg(F.min("gap").alias("gap"))


@BOOK.query("""
WITH d AS (SELECT p_brand, p_type, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size END AS s, min(p_partkey) AS code FROM part GROUP BY 1, 2, 3)
SELECT p_partkey, code FROM part p JOIN d ON p.p_brand = d.p_brand AND p.p_type = d.p_type AND (CASE WHEN p.p_size % 3 = 0 THEN NULL ELSE p.p_size END) IS NOT DISTINCT FROM d.s""")
def dictionary_tuple_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary by several columns, of which one may be null on both sides."""
    parts = table(spark, sf_dir, "part").withColumn("s", F.when(F.col("p_size") % 3 != 0, F.col("p_size")))
    rules = parts.groupBy(F.col("p_brand").alias("b"), F.col("p_type").alias("t"), F.col("s").alias("r")).agg(F.min("p_partkey").alias("code"))
    return parts.join(rules, (F.col("p_brand") == F.col("b")) & (F.col("p_type") == F.col("t")) & F.col("s").eqNullSafe(F.col("r"))).select("p_partkey", "code")


def _expanded(lines: DataFrame, parts: DataFrame) -> DataFrame:
    """Part keys listed per order, exploded and joined."""
    lists = lines.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("ps"))
    return lists.select("l_orderkey", F.explode("ps").alias("k")).join(parts, F.col("k") == F.col("p_partkey")).select("l_orderkey", "p_partkey", "p_name")


@BOOK.query("""
WITH o AS (SELECT l_orderkey, list(DISTINCT l_partkey) AS ps FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, p_partkey, p_name FROM (SELECT l_orderkey, unnest(ps) AS k FROM o) JOIN part ON k = p_partkey""")
def exploded_list_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of accessories of every order, one array a row, to their records."""
    return _expanded(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part"))


@BOOK.query("""
WITH hits AS (SELECT p_partkey FROM part WHERE p_partkey % 4 <> 0), rest AS (SELECT * FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM hits)),
t AS (SELECT p_brand AS b, p_name AS title, min(p_partkey) AS code FROM part WHERE p_partkey % 4 <> 0 GROUP BY 1, 2),
j AS (SELECT p_partkey, code, 0.7 * len(list_intersect(string_split(p_name, ' '), string_split(title, ' '))) / 2 + 0.3 AS score FROM rest JOIN t ON p_brand = b),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY round(score, 9) DESC, code) AS rn FROM j)
SELECT p_partkey, code, round(score, 6) AS score FROM r WHERE rn = 1""")
def title_map_after_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct hits are taken out; the rest is mapped by title tokens within the brand."""
    parts = table(spark, sf_dir, "part")
    direct = parts.where("p_partkey % 4 <> 0")
    titles = direct.groupBy("p_brand", F.col("p_name").alias("title")).agg(F.min("p_partkey").alias("code"))
    rest = parts.join(direct.select("p_partkey"), "p_partkey", "left_anti")
    # distinct titles, met by common tokens; without any, the first code of the brand
    words = lambda d, name: d.select("p_brand", name, F.array_distinct(F.split(name, " ")).alias(f"{name}_words"))
    asked, known = words(rest, "p_name").distinct(), words(titles, "title").join(titles, ["p_brand", "title"])
    met = match.shared_tokens(asked, known, ["p_brand"], ["p_name"], ["code"], tokens=("p_name_words", "title_words"))
    best = met.groupBy("p_brand", "p_name").agg(F.min(F.struct((-F.col("shared")).alias("less"), "code")).alias("m"))
    least = titles.groupBy("p_brand").agg(F.min("code").alias("least"))
    out = rest.select("p_partkey", "p_brand", "p_name").join(least, "p_brand").join(best, ["p_brand", "p_name"], "left")
    score = F.round(F.coalesce(-F.col("m.less"), F.lit(0)) * 0.7 / 2 + 0.3, 6)
    return out.select("p_partkey", F.coalesce("m.code", "least").alias("code"), score.alias("score"))


@BOOK.query("""
WITH e AS (SELECT c_custkey AS k, 'exact' AS how FROM customer WHERE c_acctbal > 9000), l AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT c_custkey, CASE WHEN e.how IS NOT NULL THEN 'factory' WHEN n >= 15 THEN 'learned' WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'guess' ELSE 'none' END AS source
FROM customer LEFT JOIN e ON e.k = c_custkey LEFT JOIN l ON l.k = c_custkey""")
def signature_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact key, then learned with support, then the group's guess, then nothing."""
    customers = table(spark, sf_dir, "customer")
    learned = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    source = semantics.ladder([(F.col("c_acctbal") > 9000, "factory"), (F.col("n") >= 15, "learned"), (F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "guess")], "none")
    return customers.join(learned, "c_custkey", "left").select("c_custkey", source.alias("source"))


@BOOK.query("""
WITH s AS (SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 0.95 WHEN o_orderpriority LIKE '2%' THEN 0.87 WHEN o_orderpriority LIKE '3%' THEN 0.76 WHEN o_orderpriority LIKE '4%' THEN 0.61 ELSE 0.2 END AS score FROM orders)
SELECT o_orderkey, CASE WHEN score >= 0.9 THEN 'rule' WHEN score >= 0.85 THEN 'vendor' WHEN score >= 0.75 THEN 'vin' WHEN score >= 0.6 THEN 'registry' ELSE 'unresolved' END AS resolved_by, score FROM s""")
def composite_resolver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A waterfall of resolvers, each with its own threshold."""
    p = F.substring("o_orderpriority", 1, 1)
    score = semantics.ladder([(p == "1", 0.95), (p == "2", 0.87), (p == "3", 0.76), (p == "4", 0.61)], 0.2)
    steps = [(0.9, "rule"), (0.85, "vendor"), (0.75, "vin"), (0.6, "registry")]
    return table(spark, sf_dir, "orders").select("o_orderkey", score.alias("score")).withColumn("resolved_by", similarity.level(F.col("score"), steps, "unresolved"))


@BOOK.query("""
SELECT p_brand, list_aggregate(list_sort(list(DISTINCT p_name)), 'string_agg', ',') AS expected FROM part WHERE p_size <= 5 GROUP BY p_brand""")
def golden_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set of acceptable names of each brand."""
    return table(spark, sf_dir, "part").where("p_size <= 5").groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_set("p_name")), ",").alias("expected"))


@BOOK.query("""
WITH b AS (SELECT p_brand, p_name, min(p_partkey) AS best FROM part GROUP BY 1, 2)
SELECT p_partkey, CASE WHEN best = p_partkey THEN 'keep' WHEN p_size % 7 = 0 THEN 'null' ELSE 'replace' END AS verdict, CASE WHEN best <> p_partkey AND p_size % 7 <> 0 THEN best END AS corrected FROM part JOIN b USING (p_brand, p_name)""")
def key_reverify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored keys against resolved ones: keep, replace or null."""
    best = F.min("p_partkey").over(Window.partitionBy("p_brand", "p_name"))
    verdict = semantics.ladder([(F.col("best") == F.col("p_partkey"), "keep"), (F.col("p_size") % 7 == 0, "null")], "replace")
    return table(spark, sf_dir, "part").withColumn("best", best).select("p_partkey", verdict.alias("verdict")  , F.when(verdict == "replace", F.col("best")).alias("corrected"))


QUERIES, ORACLES = BOOK.queries, BOOK.oracles
# earlier names, of queries that took only some of the keys
for _name, _whole in (("exploded_list_join", "exploded_list_whole"), ("interval_overlap_join", "interval_overlap_whole"), ("or_match_verifier", "or_match_whole"), ("weighted_neighbour", "weighted_neighbour_whole")):
    QUERIES[_name], ORACLES[_name] = QUERIES[_whole], ORACLES[_whole]
