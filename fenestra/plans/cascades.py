"""Resolution of what earlier layers left, and agreement of features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenestra.operators import agreement, articles, intervals, match, upsert
from fenestra.plans.book import Book
from fenestra.sources.files import scratch
from fenestra.sources.tables import table

BOOK = Book()


# ---------------------------------------------------------------- five layers, each for what is left

_CASCADE = """
WITH a AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders),
l0 AS (SELECT user_id AS o_custkey, min(event_id) AS answer FROM events WHERE event_type = 'purchase' AND value > 50 GROUP BY 1),
l1 AS (SELECT c_custkey AS o_custkey, CAST(c_nationkey AS bigint) AS answer FROM customer WHERE c_acctbal > 8000),
l2 AS (SELECT o_custkey, o_orderpriority, min(l_partkey) AS answer FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_quantity >= 49 GROUP BY 1, 2),
l3 AS (SELECT c_custkey AS o_custkey, min(s_suppkey) AS answer FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE s_acctbal > 7000 GROUP BY 1),
l4 AS (SELECT p_size || '-' || p_type AS k, min(p_partkey) AS answer FROM part WHERE p_size % 5 <> 0 GROUP BY 1),
m AS (SELECT a.*, l0.answer AS a0, l1.answer AS a1, l2.answer AS a2, l3.answer AS a3, l4.answer AS a4 FROM a LEFT JOIN l0 USING (o_custkey) LEFT JOIN l1 USING (o_custkey) LEFT JOIN l2 USING (o_custkey, o_orderpriority) LEFT JOIN l3 USING (o_custkey)
  LEFT JOIN l4 ON l4.k = (o_custkey % 50 + 1) || '-' || 'ECONOMY'),
r AS (SELECT o_custkey, o_orderpriority, CASE WHEN a0 IS NOT NULL THEN 0 WHEN a1 IS NOT NULL THEN 1 WHEN a2 IS NOT NULL THEN 2 WHEN a3 IS NOT NULL THEN 3 WHEN a4 IS NOT NULL THEN 4 END AS layer, coalesce(a0, a1, a2, a3, a4) AS answer FROM m)"""
LAYER_NAMES = ["purchase", "account", "returned", "supplier", "size"]


def cascade(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers and priorities of all orders through layers of five tables."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity >= 49").join(orders.select("o_orderkey", "o_custkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    near = table(spark, sf_dir, "supplier").where("s_acctbal > 7000").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_suppkey").alias("answer"))
    sizes = table(spark, sf_dir, "part").where("p_size % 5 <> 0 AND p_type = 'ECONOMY'").groupBy(F.col("p_size").cast("bigint").alias("size")).agg(F.min("p_partkey").alias("answer"))
    layers = [
        table(spark, sf_dir, "events").where("event_type = 'purchase' AND value > 50").select(F.col("user_id").alias("o_custkey"), F.col("event_id").alias("answer")),
        customers.where("c_acctbal > 8000").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("bigint").alias("answer")),
        returned.select("o_custkey", "o_orderpriority", F.col("l_partkey").alias("answer")),
        customers.join(near, "c_nationkey").select(F.col("c_custkey").alias("o_custkey"), "answer"),
        sizes,
    ]
    asked = orders.select("o_custkey", "o_orderpriority", (F.col("o_custkey") % 50 + 1).alias("size"))
    return match.residual_cascade(asked, list(zip(LAYER_NAMES, layers, strict=True)), ["o_custkey", "o_orderpriority", "size"], scratch(spark, "cascade"))


@BOOK.query(_CASCADE + "\nSELECT o_custkey, o_orderpriority, layer, answer FROM r")
def cascade_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first layer that knows a customer and priority, and its answer."""
    return cascade(spark, sf_dir)[0].select("o_custkey", "o_orderpriority", "layer", "answer")


@BOOK.query(_CASCADE + f""",
n AS (SELECT layer, CAST(unnest({LAYER_NAMES}) AS varchar) AS name FROM (SELECT unnest(range(5)) AS layer) WHERE false UNION ALL SELECT i - 1, {LAYER_NAMES}[i] FROM (SELECT unnest(range(1, 6)) AS i))
SELECT CAST(n.layer AS integer) AS layer, name, (SELECT count(*) FROM r WHERE coalesce(r.layer, 9) >= n.layer) AS asked, (SELECT count(*) FROM r WHERE r.layer = n.layer) AS found, (SELECT count(*) FROM r WHERE coalesce(r.layer, 9) > n.layer) AS "left"
FROM n WHERE (SELECT count(*) FROM r WHERE coalesce(r.layer, 9) >= n.layer) > 0""")
def cascade_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many distinct keys each layer was asked for, found and left."""
    return cascade(spark, sf_dir)[1]


# ---------------------------------------------------------------- features


#: feature, asked, offered, points: see `agreement.agreement`.
WEIGHTS = [
    ("colour", "*", "=", 0.2), ("colour", "*", "*", -0.1), ("colour", "*", None, -0.1), ("kind", "*", "=", 0.3), ("kind", "*", "*", -0.05), ("kind", "bolt", "rod", 0.1), ("kind", "ring", "gear", -0.5), ("kind", None, "*", -0.02),
    ("kind", "*", None, -0.04), ("type", "*", "=", 0.2), ("type", "*", "*", -0.1), ("type", None, "PROMO", -0.05), ("type", None, "*", 0.01),
]
CLAMPS = [("BUILDING", -0.3, 0.3, 0.1), ("MACHINERY", -1.0, 1.0, 0.0), ("AUTOMOBILE", -0.1, 0.45, 0.2)]


def _points_sql(feature: str) -> str:
    rows = [(x, y, p) for f, x, y, p in WEIGHTS if f == feature]
    named = " ".join(f"WHEN a.{feature} = '{x}' AND o.{feature} = '{y}' THEN {p}" for x, y, p in rows if x not in ("*", None) and y not in ("*", "=", None))
    alone = " ".join(f"WHEN a.{feature} IS NULL AND o.{feature} = '{y}' THEN {p}" for x, y, p in rows if x is None and y != "*")
    rest = {(x, y): p for x, y, p in rows}
    return (
        f"CASE {named} {alone} WHEN a.{feature} IS NULL AND o.{feature} IS NULL THEN 0 WHEN a.{feature} IS NULL THEN {rest.get((None, '*'), 0.0)} WHEN o.{feature} IS NULL THEN {rest.get(('*', None), 0.0)} "
        f"WHEN a.{feature} = o.{feature} THEN {rest[('*', '=')]} ELSE {rest[('*', '*')]} END"
    )


_LIMIT = lambda i, other: "CASE a.make " + " ".join(f"WHEN '{c[0]}' THEN {c[i]}" for c in CLAMPS) + f" ELSE {other} END"


@BOOK.query(f"""
WITH t AS (SELECT o_custkey, arg_max(l_partkey, (l_extendedprice, l_orderkey, l_linenumber)) AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1),
asked AS (SELECT c_custkey, c_mktsegment AS make, CASE WHEN c_custkey % 5 <> 0 THEN split_part(p_name, ' ', 1) END AS colour, split_part(p_name, ' ', 2) AS kind, CASE WHEN c_custkey % 3 <> 0 THEN p_type END AS type FROM customer JOIN t ON c_custkey = o_custkey JOIN part ON p = p_partkey),
offered AS (SELECT min(p_partkey) AS p_partkey, colour, kind, type FROM (SELECT p_partkey, split_part(p_name, ' ', 1) AS colour, CASE WHEN p_size % 7 <> 0 THEN split_part(p_name, ' ', 2) END AS kind, p_type AS type FROM part) GROUP BY colour, kind, type),
a AS (SELECT DISTINCT make, colour, kind, type FROM asked),
s AS (SELECT a.*, o.p_partkey, round(greatest({_LIMIT(1, -1e9)}, least({_LIMIT(2, 1e9)}, {_points_sql('colour')} + {_points_sql('kind')} + {_points_sql('type')}
  + CASE WHEN (a.colour IS NULL OR coalesce(a.colour = o.colour, false)) AND coalesce(a.kind = o.kind, false) AND (a.type IS NULL OR coalesce(a.type = o.type, false)) THEN {_LIMIT(3, 0.0)} ELSE 0 END)), 9) AS score
  FROM a JOIN offered o ON a.colour IS NOT NULL OR (o.kind IS NOT NULL) OR a.type IS NOT NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY make, colour, kind, type ORDER BY score DESC, p_partkey) AS rn FROM s)
SELECT c_custkey, b.p_partkey, round(b.score, 6) AS score FROM asked JOIN b ON rn = 1 AND asked.make = b.make AND asked.colour IS NOT DISTINCT FROM b.colour AND asked.kind = b.kind AND asked.type IS NOT DISTINCT FROM b.type""")
def feature_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every customer the part whose features agree best with the dearest one that they returned."""
    parts, orders = table(spark, sf_dir, "part"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    back = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    dearest = back.groupBy("o_custkey").agg(F.max_by("l_partkey", F.struct("l_extendedprice", "l_orderkey", "l_linenumber")).alias("p_partkey"))
    colour, kind = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    known = table(spark, sf_dir, "customer").join(dearest, F.col("c_custkey") == F.col("o_custkey")).join(parts, "p_partkey")
    long = lambda d, ids, **features: reduce(DataFrame.unionByName, (d.select(*ids, F.lit(f).alias("feature"), c.alias("value")) for f, c in features.items()))
    asked = long(known, [F.col("c_custkey").alias("asked_id"), F.col("c_mktsegment").alias("make")], colour=F.when(F.col("c_custkey") % 5 != 0, colour), kind=kind, type=F.when(F.col("c_custkey") % 3 != 0, F.col("p_type")))
    offered = long(parts, [F.col("p_partkey").alias("offered_id")], colour=colour, kind=F.when(F.col("p_size") % 7 != 0, kind), type=F.col("p_type"))
    weights = spark.createDataFrame(WEIGHTS, "feature string, asked string, offered string, points double")
    clamps = spark.createDataFrame(CLAMPS, "make string, low double, high double, perfect double")
    best = agreement.best_offers(asked, offered, weights, clamps)
    return best.select(F.col("asked_id").alias("c_custkey"), F.col("offered_id").alias("p_partkey"), F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- articles


_TOKENS = lambda x: f"list_filter(regexp_split_to_array(regexp_replace(lower({x}), '[^a-z0-9_\\sæøåéäöü]', ' ', 'g'), '\\s+'), lambda t: length(t) > 1 AND t NOT IN ('the', 'and', 'die', 'que'))"


@BOOK.query(f"""
WITH b AS (SELECT item_id, {_TOKENS('text')} AS w FROM benchmark), k AS (SELECT item_id, w, list_distinct(list_filter(w, lambda t: length(t) >= 9)) AS k FROM b),
q AS (SELECT conv_id, turn, {_TOKENS('text')} AS w FROM conversations), t AS (SELECT DISTINCT unnest(w) AS word FROM q),
bw AS (SELECT DISTINCT item_id, unnest(w) AS o FROM b), bk AS (SELECT DISTINCT item_id, unnest(k) AS o FROM k),
p AS (SELECT word, item_id, max(points) AS points FROM (
  SELECT word, item_id, CASE WHEN word = o THEN 3.0 ELSE 2.0 END AS points FROM t JOIN bk ON contains(o, word)
  UNION ALL SELECT word, item_id, CASE WHEN word = o THEN 1.0 ELSE 0.5 END FROM t JOIN bw ON contains(o, word) OR contains(word, o)) GROUP BY 1, 2),
c AS (SELECT conv_id, turn, len(w) AS total, unnest(w) AS word FROM q),
s AS (SELECT conv_id, turn, item_id, round(CAST(sum(points) AS double) / any_value(total), 6) AS score FROM c JOIN p USING (word) GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, item_id) AS rn FROM s)
SELECT conv_id, turn, item_id, score FROM r WHERE rn = 1 AND score >= 0.3""")
def article_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every turn of every conversation the benchmark item that answers it best, its long words as keywords."""
    stop = ["the", "and", "die", "que"]
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("article_id"), "text")
    keyed = items.withColumn("keywords", F.array_distinct(F.filter(articles.tokens(F.col("text"), stop), lambda t: F.length(t) >= 9)))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return articles.best_articles(turns, keyed, ids=["conv_id", "turn"], stop=stop, digits=6).withColumnRenamed("article_id", "item_id")


# ---------------------------------------------------------------- fingerprints and rules


@BOOK.query("""
WITH n AS (SELECT l_partkey, count(*) AS samples FROM lineitem GROUP BY 1),
f AS (SELECT p_brand, p_size AS lo, CASE WHEN p_size % 7 <> 0 THEN p_size + p_partkey % 12 END AS hi, samples, p_partkey FROM part JOIN n ON l_partkey = p_partkey),
q AS (SELECT o_orderkey, 'Brand#' || (o_custkey % 26 + 1) AS p_brand, CAST(o_orderkey % 70 AS integer) AS size FROM orders),
d AS (SELECT DISTINCT p_brand, size FROM q),
b AS (SELECT d.p_brand, d.size, min((-samples, p_partkey)) AS m FROM d JOIN f ON d.p_brand = f.p_brand AND d.size >= lo AND (hi IS NULL OR d.size <= hi) GROUP BY 1, 2)
SELECT o_orderkey, -m[1] AS samples, m[2] AS p_partkey FROM q LEFT JOIN b USING (p_brand, size)""")
def fingerprint_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every order the fingerprint of its brand whose range holds its size and that most samples support."""
    samples = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("samples"))
    size = F.col("p_size")
    known = table(spark, sf_dir, "part").join(samples, "p_partkey").select("p_brand", size.alias("lo"), F.when(size % 7 != 0, size + F.col("p_partkey") % 12).alias("hi"), "samples", "p_partkey")
    asked = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Brand#"), (F.col("o_custkey") % 26 + 1).cast("string")).alias("p_brand"), (F.col("o_orderkey") % 70).cast("int").alias("size"))
    return intervals.heaviest_holding(known, asked, ["p_brand"], lo="lo", hi="hi", weight="samples", item="p_partkey", at="size", least=0, most=127).select("o_orderkey", "samples", "p_partkey")


@BOOK.query("""
WITH c AS (SELECT user_id, event_type, count(*) AS hits FROM events GROUP BY 1, 2), m AS (SELECT c_nationkey, event_type, CAST(sum(hits) AS bigint) AS hits, count(*) AS users FROM c JOIN customer ON user_id = c_custkey GROUP BY 1, 2),
s AS (SELECT c_nationkey, event_type, hits, round(hits / sum(hits) OVER (PARTITION BY c_nationkey), 6) AS confidence FROM m WHERE users >= 3),
o AS (SELECT n_nationkey AS c_nationkey, 'view' AS event_type, 0.5 AS confidence, CAST(7 AS bigint) AS hits, CAST(1 AS bigint) AS evidence FROM nation WHERE n_nationkey % 2 = 0)
SELECT c_nationkey, event_type, CAST(coalesce(s.confidence, o.confidence) AS double) AS confidence, greatest(s.hits, o.hits) AS hits, coalesce(o.evidence, 0) + CASE WHEN s.hits IS NULL THEN 0 ELSE 1 END AS evidence FROM o FULL JOIN s USING (c_nationkey, event_type)""")
def seed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules by nation seeded from counters of users, through the customers' table, and merged into those that exist."""
    hits = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("hits"))
    seeded = hits.join(table(spark, sf_dir, "customer"), F.col("user_id") == F.col("c_custkey")).groupBy("c_nationkey", "event_type").agg(F.sum("hits").alias("hits"), F.count("*").alias("users")).where("users >= 3")
    totals = seeded.groupBy("c_nationkey").agg(F.sum("hits").alias("total"))
    fresh = seeded.join(totals, "c_nationkey").select("c_nationkey", "event_type", F.round(F.col("hits") / F.col("total"), 6).alias("confidence"), "hits")
    old = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("c_nationkey"), F.lit("view").alias("event_type"), F.lit(0.5).alias("confidence"), F.lit(7).cast("bigint").alias("hits"), F.lit(1).cast("bigint").alias("evidence"))
    return upsert.merge_evidence(old, fresh, ["c_nationkey", "event_type"], fill=["confidence"], most=["hits"])


QUERIES, ORACLES = BOOK.queries, BOOK.oracles
