"""Lookups, facets, searches and row-wise rules over the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenestra.functions import flags, semantics, text
from fenestra.operators import quality
from fenestra.plans.book import Book
from fenestra.sources.tables import table

BOOK = Book()

#: Stand-ins for the catalogue's nullable ranges, the same in SQL.
LOW, HIGH = "p_size", "CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size + 10 END"
ALIASES = {"N0": "NATION_0", "ZERO": "NATION_0", "N7": "NATION_7", "SEVEN": "NATION_7", "N9": "NATION_9"}


@BOOK.query("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand")
def facet_brand_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by brand, most frequent first."""
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand")


@BOOK.query("SELECT p_type, p_size, count(*) AS n, concat_ws(' / ', p_type, CAST(p_size AS varchar)) AS label FROM part GROUP BY p_type, p_size")
def facet_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_type", "p_size").agg(F.count("*").alias("n")).withColumn("label", F.concat_ws(" / ", "p_type", F.col("p_size").cast("string")))


@BOOK.query("""
SELECT 'rows' AS metric, count(*) AS value FROM part UNION ALL SELECT 'brands', count(DISTINCT p_brand) FROM part
UNION ALL SELECT 'types', count(DISTINCT p_type) FROM part UNION ALL SELECT 'names', count(DISTINCT p_name) FROM part""")
def catalog_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in one pass, one row a metric."""
    one = table(spark, sf_dir, "part").agg(F.count("*").alias("rows"), F.countDistinct("p_brand").alias("brands"), F.countDistinct("p_type").alias("types"), F.countDistinct("p_name").alias("names"))
    return one.unpivot([], ["rows", "brands", "types", "names"], "metric", "value")


@BOOK.query("""
SELECT p_partkey, p_name FROM part
WHERE (p_name ILIKE '%red%' OR p_type ILIKE '%red%' OR p_name ILIKE '%blue%' OR p_type ILIKE '%blue%')
  AND (p_name ILIKE '%e%' OR p_type ILIKE '%e%') AND p_size >= 5""")
def token_search_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tokens must be found; a token is found if any synonym is in any field. Optional filters are added."""
    return search(table(spark, sf_dir, "part"), [["red", "blue"], ["e"]], ["p_name", "p_type"], [F.col("p_size") >= 5]).select("p_partkey", "p_name")


def search(rows: DataFrame, groups: list[list[str]], fields: list[str], filters: list) -> DataFrame:
    """AND over groups of synonyms, OR over synonyms and fields; no user text is ever part of SQL."""
    found = [semantics.any_of([F.contains(F.lower(f), F.lit(s.lower())) for s in group for f in fields]) for group in groups]
    return rows.where(semantics.all_of([*found, *filters]))


@BOOK.query("""
WITH p AS (SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 21 OFFSET 40)
SELECT p_partkey, p_name, (SELECT count(*) FROM p) > 20 AS has_more FROM p ORDER BY p_partkey LIMIT 20""")
def paged_lookahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of 20 rows after 40, read with one row more to know whether there are others."""
    page = table(spark, sf_dir, "part").select("p_partkey", "p_name").orderBy("p_partkey").offset(40).limit(21)
    more = page.agg((F.count("*") > 20).alias("has_more")).scalar()
    return page.withColumn("has_more", more).orderBy("p_partkey").limit(20)


@BOOK.query(f"SELECT p_partkey, p_size FROM (SELECT *, {LOW} AS lo, {HIGH} AS hi FROM part) WHERE (lo IS NULL OR lo <= 25) AND (hi IS NULL OR hi >= 25)")
def null_tolerant_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").withColumn("lo", F.expr(LOW)).withColumn("hi", F.expr(HIGH))
    return parts.where(semantics.covers(F.col("lo"), F.col("hi"), 25)).select("p_partkey", "p_size")


@BOOK.query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE upper(n_name) IN ('NATION_0', 'NATION_7')")
def alias_expanded_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of nations given by any alias; aliases are a fixed table and broadcast."""
    asked = spark.createDataFrame([("n0",), ("seven",), ("Zero",)], "alias string")
    names = spark.createDataFrame(list(ALIASES.items()), "alias string, canonical string")
    wanted = asked.select(F.upper("alias").alias("alias")).join(names, "alias").select(F.col("canonical").alias("n_name")).distinct()
    nations = table(spark, sf_dir, "nation").join(F.broadcast(wanted.withColumnRenamed("n_name", "w")), F.upper("n_name") == F.col("w"), "left_semi")
    return table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")


@BOOK.query("""
SELECT p_partkey, 'point' AS how FROM part WHERE p_partkey = 17 UNION ALL SELECT p_partkey, 'in' FROM part WHERE p_partkey IN (3, 5, 8)
UNION ALL SELECT p_partkey, 'folded' FROM part WHERE lower(p_brand) = lower('BRAND#11') UNION ALL SELECT p_partkey, 'substring' FROM part WHERE p_type ILIKE '%prom%'""")
def point_and_in_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    kinds = {"point": F.col("p_partkey") == 17, "in": F.col("p_partkey").isin(3, 5, 8), "folded": F.lower("p_brand") == "brand#11", "substring": F.col("p_type").ilike("%prom%")}
    how = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in kinds.items())))
    return parts.where(semantics.any_of(list(kinds.values()))).select("p_partkey", F.explode(how).alias("how"))


FLAGS = {"heated": "p_size % 2 = 0", "acoustic": "p_size % 3 = 0", "camera": "p_size % 5 = 0"}
_FLAG_SQL = ", ".join(f"{v} AS {k}" for k, v in FLAGS.items())


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("*", *(f"{v} AS {k}" for k, v in FLAGS.items()))


@BOOK.query(f"SELECT p_partkey FROM (SELECT *, {_FLAG_SQL} FROM part) WHERE heated AND acoustic AND p_brand = 'Brand#12'")
def flag_conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All flags asked for, and optional equalities of which absent ones ask for nothing."""
    asked = {"p_brand": "Brand#12", "p_type": None}
    same = [F.col(k) == v for k, v in asked.items() if v is not None]
    return _flagged(spark, sf_dir).where(semantics.all_of([F.col("heated"), F.col("acoustic"), *same])).select("p_partkey")


@BOOK.query("""
SELECT p_partkey, p_name, p_type FROM part
WHERE starts_with(lower(split_part(p_name, ' ', 1)), 'r') AND (p_type ILIKE '%e%' OR p_type ILIKE '%o%') AND NOT p_type ILIKE '%econ%' AND p_size <= 30""")
def prefix_or_like_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.lower(F.split("p_name", " ")[0])
    wanted = F.startswith(first, F.lit("r")) & (F.col("p_type").ilike("%e%") | F.col("p_type").ilike("%o%")) & ~F.col("p_type").ilike("%econ%") & (F.col("p_size") <= 30)
    return table(spark, sf_dir, "part").where(wanted).select("p_partkey", "p_name", "p_type")


@BOOK.query(r"""
WITH c AS (SELECT p_partkey, CASE WHEN regexp_matches(upper(p_type), '\b(LARGE|MEDIUM)\b') THEN 'front' WHEN regexp_matches(upper(p_type), '\b(SMALL)\b') THEN 'rear' ELSE 'other' END AS category,
  CASE WHEN regexp_matches(upper(p_name), '\b(RED|HOT)\b') THEN 'left' WHEN regexp_matches(upper(p_name), '\b(BLUE)\b') THEN 'right' ELSE 'none' END AS side FROM part)
SELECT category, side, count(*) AS n FROM c WHERE category <> 'other' GROUP BY category, side""")
def category_position_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories and sides by ordered keyword rules."""
    category = text.first_keyword(F.col("p_type"), [("LARGE|MEDIUM", "front"), ("SMALL", "rear")], "other")
    side = text.first_keyword(F.col("p_name"), [("RED|HOT", "left"), ("BLUE", "right")], "none")
    return table(spark, sf_dir, "part").select(category.alias("category"), side.alias("side")).where("category <> 'other'").groupBy("category", "side").agg(F.count("*").alias("n"))


@BOOK.query(f"SELECT p_partkey FROM (SELECT *, {_FLAG_SQL} FROM part) WHERE heated = true AND camera = false")
def answer_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to questions; 'unknown' asks for nothing."""
    answers = {"heated": "yes", "acoustic": "unknown", "camera": "no"}
    return _flagged(spark, sf_dir).where(semantics.all_of([F.col(k) == (v == "yes") for k, v in answers.items() if v != "unknown"])).select("p_partkey")


@BOOK.query(f"""
WITH f AS (SELECT *, {_FLAG_SQL} FROM part), v AS (SELECT p_partkey, CAST(NOT heated AS int) + CAST(acoustic AS int) AS wrong FROM f)
SELECT p_partkey, CASE WHEN wrong = 0 THEN 'exact' ELSE 'uncertain' END AS part, CASE wrong WHEN 0 THEN 'perfect' WHEN 1 THEN 'good' ELSE 'check' END AS agreement FROM v""")
def tri_state_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by how their flags meet tri-state answers (true, false, unknown)."""
    have = {k: F.col(k) for k in FLAGS}
    answers = {"heated": F.lit(True), "acoustic": F.lit(False), "camera": F.lit(None).cast("boolean")}
    wrong = flags.violations(have, answers)
    return _flagged(spark, sf_dir).select("p_partkey", F.when(wrong == 0, F.lit("exact")).otherwise(F.lit("uncertain")).alias("part"), flags.agreement(have, answers).alias("agreement"))


@BOOK.query("SELECT p_partkey AS id, upper(p_brand) AS brand, p_name AS title, p_retailprice AS price, p_size AS size FROM part")
def projection_reshape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The API's shape, with nested properties, of which fields are picked again."""
    shaped = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.upper("p_brand").alias("brand"), F.col("p_name").alias("title"), F.struct(F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"), F.col("p_type").alias("type")).alias("properties"))
    return shaped.withColumn("properties", F.col("properties").dropFields("type")).select("id", "brand", "title", "properties.*")


@BOOK.query("""
WITH e AS (SELECT o_orderkey, concat_ws(',', CASE WHEN o_totalprice < 20000 THEN 'low_price' END, CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'status' END, CASE WHEN year(o_orderdate) < 1993 THEN 'old' END) AS errors FROM orders)
SELECT o_orderkey, errors, CASE WHEN errors = '' THEN 'OK' WHEN contains(errors, ',') THEN 'HOLD' ELSE 'REVIEW' END AS status FROM e""")
def row_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks that a row fails, and its status: none, one or more."""
    bad = quality.errors_of({"low_price": F.col("o_totalprice") < 20000, "status": ~F.col("o_orderstatus").isin("O", "F"), "old": F.year("o_orderdate") < 1993})
    status = F.when(F.size(bad) == 0, F.lit("OK")).when(F.size(bad) > 1, F.lit("HOLD")).otherwise(F.lit("REVIEW"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(bad, ",").alias("errors"), status.alias("status"))


@BOOK.query("""
SELECT event_id, CASE WHEN event_type = 'error' AND value < 0 THEN 0.0 WHEN event_type = 'view' THEN value * 2 ELSE value END AS value
FROM events WHERE ts + INTERVAL 10 DAY > (SELECT max(ts) FROM events)""")
def conditional_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that have not expired, with values corrected under conditions."""
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts").alias("now")).scalar()
    live = events.where(F.col("ts") + F.expr("INTERVAL 10 DAYS") > now)
    fixed = F.when((F.col("event_type") == "error") & (F.col("value") < 0), 0.0).when(F.col("event_type") == "view", F.col("value") * 2).otherwise(F.col("value"))
    return live.select("event_id", fixed.alias("value"))


@BOOK.query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%red-bolt%' OR lower(p_name) LIKE '%red bolt%' OR lower(p_name) LIKE '%redbolt%'")
def hint_variants_single_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spellings of a hint in one scan."""
    return hinted(table(spark, sf_dir, "part"), "Red-Bolt", "p_name").select("p_partkey", "p_name")


def hinted(rows: DataFrame, hint: str, field: str) -> DataFrame:
    return rows.where(F.exists(text.spellings(F.lit(hint)), lambda v: F.contains(F.lower(field), v)))


@BOOK.query("""
SELECT 'type' AS facet, p_type AS value, count(*) AS n, count(*) FILTER (WHERE p_size > 25) AS large FROM part GROUP BY p_type
UNION ALL SELECT 'brand', p_brand, count(*), count(*) FILTER (WHERE p_size > 25) FROM part GROUP BY p_brand""")
def distinct_sorted_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two facets with conditional counts in one pass."""
    sets = table(spark, sf_dir, "part").groupingSets([["p_type"], ["p_brand"]], "p_type", "p_brand").agg(F.count("*").alias("n"), F.count_if(F.col("p_size") > 25).alias("large"), F.grouping("p_type").alias("g"))
    return sets.select(F.when(F.col("g") == 0, F.lit("type")).otherwise(F.lit("brand")).alias("facet"), F.coalesce("p_type", "p_brand").alias("value"), "n", "large").orderBy("facet", "value")


@BOOK.query("""
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'regnr' WHEN 1 THEN 'vin' WHEN 2 THEN 'eurocode' WHEN 3 THEN 'oem' WHEN 4 THEN 'text' ELSE 'sku' END AS type,
 CASE WHEN p_partkey % 6 IN (0, 1, 2) THEN 1.0 WHEN p_partkey % 6 = 4 THEN 0.5 ELSE 0.8 END AS confidence FROM part""")
def input_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs of six kinds, made from keys, are told apart."""
    k, digits = F.col("p_partkey"), F.lpad((F.col("p_partkey") % 100000).cast("string"), 5, "1")
    raw = F.when(k % 6 == 0, F.concat(F.lit(" ab "), digits)).when(k % 6 == 1, F.concat(F.lit("wvwzzz1kz6w0"), digits)).when(k % 6 == 2, F.concat(F.lit("85"), F.substring(digits, 1, 2), F.lit("ag"), F.substring(digits, 4, 1)))
    raw = raw.when(k % 6 == 3, F.concat(F.lit("x"), digits, F.lit("yz9"))).when(k % 6 == 4, F.col("p_name")).otherwise(F.concat(F.lit("ab-"), digits, F.lit("-x")))
    kind = text.input_type(raw)
    return table(spark, sf_dir, "part").select("p_partkey", kind["type"].alias("type"), kind["confidence"].alias("confidence"))


@BOOK.query("""
SELECT p_partkey, sha256(upper(trim(p_name))) AS hash, upper(substr(p_brand, 1, 4)) AS prefix,
  concat_ws('|', coalesce(nullif(trim(p_brand), ''), '*'), CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS varchar) ELSE '*' END) AS dedupe_key FROM part""")
def prefix_and_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = text.composite_key(F.col("p_brand"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")))
    return table(spark, sf_dir, "part").select("p_partkey", text.hashed(F.col("p_name")).alias("hash"), text.prefix4(F.col("p_brand")).alias("prefix"), key.alias("dedupe_key"))


QUERIES, ORACLES = BOOK.queries, BOOK.oracles
