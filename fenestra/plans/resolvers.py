"""Resolution in layers: routed lookups, threshold and position waterfalls, a scored search of a pool."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fenestra.functions import semantics, similarity, text
from fenestra.operators import match
from fenestra.plans.book import Book
from fenestra.sources.tables import table

BOOK = Book()


# ---------------------------------------------------------------- search routed by the type of its input


@BOOK.query(r"""
WITH asked AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN ' ab ' || lpad(CAST(c_custkey % 100000 AS varchar), 5, '0') WHEN 1 THEN 'wvwzzz1kz' || lpad(CAST(c_custkey % 100000000 AS varchar), 8, '0')
   WHEN 2 THEN lpad(CAST(c_custkey % 10000 AS varchar), 4, '0') || 'ag' || c_custkey % 10 WHEN 3 THEN 'Made in ' || n_name ELSE 'x-' || c_custkey || '-y' END AS q FROM customer JOIN nation ON c_nationkey = n_nationkey),
typed AS (SELECT c_custkey, trim(q) AS q, CASE WHEN regexp_full_match(regexp_replace(upper(trim(q)), '[\s.-]+', '', 'g'), '[A-Z]{2}\d{4,5}') THEN 'regnr' WHEN regexp_full_match(regexp_replace(upper(trim(q)), '[\s.-]+', '', 'g'), '[A-HJ-NPR-Z0-9]{17}') THEN 'vin'
   WHEN regexp_matches(trim(q), '\s') THEN 'text' WHEN regexp_matches(trim(q), '[.-]') THEN 'sku' ELSE 'eurocode' END AS type FROM asked),
r AS (SELECT 'AB' || lpad(CAST(o_custkey % 100000 AS varchar), 5, '0') AS k, min(o_orderkey) AS target FROM orders GROUP BY 1),
v AS (SELECT 'WVWZZZ1KZ' || lpad(CAST(s_suppkey % 100000000 AS varchar), 8, '0') AS k, min(s_suppkey) AS target FROM supplier GROUP BY 1),
e AS (SELECT lpad(CAST(p_partkey % 10000 AS varchar), 4, '0') AS k, min(p_partkey) AS target FROM part GROUP BY 1),
w AS (SELECT DISTINCT c_custkey, unnest(regexp_split_to_array(lower(q), '[^a-z0-9]+')) AS k FROM typed WHERE type = 'text'),
t AS (SELECT c_custkey, min(n_nationkey) AS target FROM w JOIN nation ON k = lower(n_name) WHERE length(k) >= 2 GROUP BY c_custkey)
SELECT y.c_custkey, y.type, CAST(coalesce(r.target, v.target, e.target, t.target) AS bigint) AS target, coalesce(r.target, v.target, e.target, t.target) IS NOT NULL AS found FROM typed y
LEFT JOIN r ON type = 'regnr' AND r.k = regexp_replace(upper(q), '[\s.-]+', '', 'g') LEFT JOIN v ON type = 'vin' AND v.k = regexp_replace(upper(q), '[\s.-]+', '', 'g')
LEFT JOIN e ON type = 'eurocode' AND e.k = substr(upper(q), 1, 4) LEFT JOIN t ON type = 'text' AND t.c_custkey = y.c_custkey""")
def search_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs of several kinds, each looked up where its detected type says: registration, VIN, code or words.

    The targets of all kinds are one table (type, key), so that whatever the kind, an
    input meets its target by one equality join; words are an inverted index.
    """
    key = F.col("c_custkey")
    padded = lambda c, n: F.lpad((c % 10**n).cast("string"), n, "0")
    named = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    kinds = [
        F.concat(F.lit(" ab "), padded(key, 5)), F.concat(F.lit("wvwzzz1kz"), padded(key, 8)), F.concat(padded(key, 4), F.lit("ag"), (key % 10).cast("string")),
        F.concat(F.lit("Made in "), "n_name"), F.concat(F.lit("x-"), key.cast("string"), F.lit("-y")),
    ]
    raw = reduce(lambda out, i: F.when(key % 5 == i, kinds[i]).otherwise(out), range(4), kinds[4])
    asked = named.select("c_custkey", text.input_type(raw).alias("i")).select("c_custkey", "i.type", "i.normalized")
    first = lambda name, kind, k, target: table(spark, sf_dir, name).groupBy(F.lit(kind).alias("type"), k.alias("key")).agg(F.min(target).cast("bigint").alias("target"))
    targets = [
        first("orders", "regnr", F.concat(F.lit("AB"), padded(F.col("o_custkey"), 5)), "o_orderkey"),
        first("supplier", "vin", F.concat(F.lit("WVWZZZ1KZ"), padded(F.col("s_suppkey"), 8)), "s_suppkey"),
        first("part", "eurocode", padded(F.col("p_partkey"), 4), "p_partkey"),
        first("nation", "text", F.lower("n_name"), "n_nationkey"),
    ]
    keys = F.when(F.col("type") == "text", text.tokens(F.col("normalized"))).when(F.col("type") == "eurocode", F.array(text.prefix4(F.col("normalized")))).otherwise(F.array("normalized"))
    met = asked.select("c_custkey", "type", F.explode_outer(keys).alias("key")).join(reduce(DataFrame.union, targets), ["type", "key"], "left")
    return met.groupBy("c_custkey", "type").agg(F.min("target").alias("target")).withColumn("found", F.col("target").isNotNull())


# ---------------------------------------------------------------- a waterfall of learned layers


LAYERS = [("rule", ["p_brand", "p_name", "p_size"], 0.90), ("vendor", ["p_name", "p_size"], 0.85), ("vin", ["p_brand", "p_name"], 0.75), ("registry", ["p_brand", "p_size"], 0.60)]
_LAYER_SQL = lambda name, keys, least: f"""{name} AS (SELECT {', '.join(keys)}, arg_min(p_type, (-n, p_type)) AS best, max(n) / sum(n) AS share FROM (SELECT {', '.join(keys)}, p_type, count(*) AS n FROM part GROUP BY ALL) GROUP BY {', '.join(keys)} HAVING sum(n) >= 2 AND max(n) / sum(n) >= {least})"""


@BOOK.query(f"""
WITH {', '.join(_LAYER_SQL(*x) for x in LAYERS)}
SELECT p_partkey, coalesce(rule.best, vendor.best, vin.best, registry.best) AS type, round(coalesce(rule.share, vendor.share, vin.share, registry.share, 0.0), 6) AS score,
  CASE WHEN rule.best IS NOT NULL THEN 'rule' WHEN vendor.best IS NOT NULL THEN 'vendor' WHEN vin.best IS NOT NULL THEN 'vin' WHEN registry.best IS NOT NULL THEN 'registry' ELSE 'unresolved' END AS resolved_by
FROM part {' '.join(f"LEFT JOIN {name} ON {' AND '.join(f'part.{k} = {name}.{k}' for k in keys)}" for name, keys, _ in LAYERS)}""")
def threshold_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers learned from the catalogue, each with its own least share of agreement; the first that is sure enough answers.

    A layer is the most frequent type of its keys and that type's share, with two rows at least.
    """
    parts = table(spark, sf_dir, "part")
    out = parts
    for name, keys, least in LAYERS:
        counts = parts.groupBy(*keys, "p_type").agg(F.count("*").alias("n"))
        votes = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("less"), "p_type")).alias("m"), F.sum("n").alias("all"))
        share = -F.col("m.less") / F.col("all")
        sure = votes.where((F.col("all") >= 2) & (share >= least)).select(*keys, F.struct(F.lit(name).alias("by"), F.col("m.p_type").alias("type"), share.alias("share")).alias(name))
        out = out.join(sure, keys, "left")
    found = F.coalesce(*(F.col(name) for name, *_ in LAYERS))
    return out.select("p_partkey", found["type"].alias("type"), F.round(F.coalesce(found["share"], F.lit(0.0)), 6).alias("score"), F.coalesce(found["by"], F.lit("unresolved")).alias("resolved_by"))


# ---------------------------------------------------------------- positions from five sources


POSITIONS = {"STEEL": "front", "COPPER": "rear", "TIN": "side"}
WORDS = {"red": "front", "blue": "rear", "green": "side"}


@BOOK.query(f"""
WITH said AS (SELECT p_partkey, p_brand, CASE WHEN p_size % 11 = 0 THEN 'front' WHEN p_size % 11 = 1 THEN 'rear' END AS s1,
  CASE {' '.join(f"WHEN regexp_matches(upper(p_type), '(^|[^A-Z0-9]){w}($|[^A-Z0-9])') THEN '{p}'" for w, p in POSITIONS.items())} END AS s2,
  CASE {' '.join(f"WHEN list_contains(string_split(p_name, ' '), '{w}') THEN '{p}'" for w, p in WORDS.items())} END AS s3 FROM part),
votes AS (SELECT p_brand, coalesce(s1, s2, s3) AS pos, count(*) AS n FROM said WHERE coalesce(s1, s2, s3) IS NOT NULL GROUP BY 1, 2),
brands AS (SELECT p_brand, arg_min(pos, (-n, pos)) AS s4, max(n) / sum(n) AS share FROM votes GROUP BY p_brand)
SELECT p_partkey, coalesce(s1, s2, s3, s4, 'unknown') AS position, CASE WHEN s1 IS NOT NULL THEN 'code' WHEN s2 IS NOT NULL THEN 'type' WHEN s3 IS NOT NULL THEN 'name' WHEN s4 IS NOT NULL THEN 'brand' ELSE 'none' END AS source,
  round(CASE WHEN s1 IS NOT NULL THEN 1.0 WHEN s2 IS NOT NULL THEN 0.9 WHEN s3 IS NOT NULL THEN 0.7 ELSE coalesce(0.5 * share, 0.0) END, 6) AS confidence
FROM said LEFT JOIN brands USING (p_brand)""")
def position_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The position of a part from its code, the words of its type, those of its name, the vote of its brand, or none; in this order."""
    k = F.col("p_size") % 11
    by_type = semantics.ladder([(F.upper("p_type").rlike(semantics.whole_word(w)), p) for w, p in POSITIONS.items()])
    by_name = semantics.ladder([(F.array_contains(F.split("p_name", " "), w), p) for w, p in WORDS.items()])
    said = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.when(k == 0, "front").when(k == 1, "rear").alias("s1"), by_type.alias("s2"), by_name.alias("s3"))
    own = F.coalesce("s1", "s2", "s3")
    votes = said.where(own.isNotNull()).groupBy("p_brand", own.alias("pos")).agg(F.count("*").alias("n"))
    brands = votes.groupBy("p_brand").agg(F.min(F.struct((-F.col("n")).alias("less"), "pos")).alias("m"), F.sum("n").alias("all"))
    brands = brands.select("p_brand", F.col("m.pos").alias("s4"), (-F.col("m.less") / F.col("all")).alias("share"))
    steps = [("s1", "code", F.lit(1.0)), ("s2", "type", F.lit(0.9)), ("s3", "name", F.lit(0.7)), ("s4", "brand", F.col("share") * 0.5)]
    pick = lambda value, default: semantics.ladder([(F.col(s).isNotNull(), value(s, name, sure)) for s, name, sure in steps], default)
    out = said.join(brands, "p_brand", "left")
    return out.select("p_partkey", F.coalesce(*(s for s, *_ in steps), F.lit("unknown")).alias("position"), pick(lambda s, name, sure: F.lit(name), "none").alias("source"), F.round(pick(lambda s, name, sure: sure, 0.0), 6).alias("confidence"))


# ---------------------------------------------------------------- exact pool, aliases, then a scored search


ALIASES = {"Brand#12": "Brand#11", "Brand#23": "Brand#22", "Brand#34": "Brand#33"}
_JACCARD = "len(list_intersect(a.w, p.w)) / len(list_distinct(list_concat(a.w, p.w)))"


@BOOK.query(f"""
WITH pool AS (SELECT p_brand, p_name, p_type, min(p_partkey) AS entry FROM part WHERE p_size > 40 GROUP BY 1, 2, 3), asked AS (SELECT DISTINCT p_brand, p_name, p_type FROM part),
alias AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in ALIASES.items())}) AS t(b, other)),
tiers AS (SELECT a.*, p.entry AS e0, q.entry AS e1 FROM asked a LEFT JOIN pool p USING (p_brand, p_name, p_type) LEFT JOIN alias ON alias.b = a.p_brand LEFT JOIN pool q ON q.p_brand = alias.other AND q.p_name = a.p_name AND q.p_type = a.p_type),
texts AS (SELECT p_name, p_type, min(entry) AS entry, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) AS w FROM pool GROUP BY 1, 2),
rest AS (SELECT DISTINCT p_name, p_type, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) AS w FROM tiers WHERE e0 IS NULL AND e1 IS NULL),
scored AS (SELECT a.p_name, a.p_type, p.entry, {_JACCARD} AS score FROM rest a JOIN texts p ON {_JACCARD} >= 0.15),
best AS (SELECT *, row_number() OVER (PARTITION BY p_name, p_type ORDER BY round(score, 9) DESC, entry) AS rank FROM scored)
SELECT p_brand, p_name, p_type, CASE WHEN e0 IS NOT NULL THEN 0 ELSE 1 END AS tier, coalesce(e0, e1) AS entry, 1 AS rank, 1.0 AS score, 'exact' AS grade FROM tiers WHERE coalesce(e0, e1) IS NOT NULL
UNION ALL SELECT t.p_brand, t.p_name, t.p_type, 2, b.entry, b.rank, round(b.score, 6), CASE WHEN round(b.score, 9) >= 0.75 THEN 'high' WHEN round(b.score, 9) >= 0.4 THEN 'medium' ELSE 'low' END FROM tiers t JOIN best b USING (p_name, p_type) WHERE e0 IS NULL AND e1 IS NULL AND rank <= 5""")
def resolver_pool_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names against a pool: the same key, then the key of an alias of the brand, then the five best of the whole pool by common words, graded.

    The search scores distinct texts, found through an inverted index of the pool's words;
    what shares less than 0.15 is left out.
    """
    parts = table(spark, sf_dir, "part")
    key = ["p_brand", "p_name", "p_type"]
    pool = parts.where("p_size > 40").groupBy(*key).agg(F.min("p_partkey").alias("entry"))
    other = F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv))
    asked = parts.select(*key).distinct().withColumn("alias", F.try_element_at(other, F.col("p_brand")))
    renamed = lambda brand, entry: pool.select(F.col("p_brand").alias(brand), "p_name", "p_type", F.col("entry").alias(entry))
    tiers = asked.join(renamed("p_brand", "e0"), key, "left").join(renamed("alias", "e1"), ["alias", "p_name", "p_type"], "left")
    known, rest = tiers.where("coalesce(e0, e1) IS NOT NULL"), tiers.where("coalesce(e0, e1) IS NULL").select(*key)
    words = F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " "))
    texts = pool.groupBy("p_name", "p_type").agg(F.min("entry").alias("entry")).select(words.alias("w"), "entry", F.size(words).alias("n"), F.lit(0).alias("all"))
    wanted = rest.select("p_name", "p_type", words.alias("v"), F.size(words).alias("m"), F.lit(0).alias("all")).distinct()
    met = match.shared_tokens(wanted, texts, ["all"], ["p_name", "p_type", "m"], ["entry", "n"], tokens=("v", "w"))
    scored = met.withColumn("score", F.round(F.col("shared") / (F.col("m") + F.col("n") - F.col("shared")), 9)).where("score >= 0.15")
    rank = F.row_number().over(Window.partitionBy("p_name", "p_type").orderBy(F.desc("score"), "entry"))
    best = scored.withColumn("rank", rank).where("rank <= 5")
    grade: Column = similarity.level(F.col("score"), [(0.75, "high"), (0.4, "medium")], "low")
    sure = known.select(*key, F.when(F.col("e0").isNotNull(), 0).otherwise(1).alias("tier"), F.coalesce("e0", "e1").alias("entry"), F.lit(1).alias("rank"), F.lit(1.0).alias("score"), F.lit("exact").alias("grade"))
    return sure.union(rest.join(best, ["p_name", "p_type"]).select(*key, F.lit(2).alias("tier"), "entry", "rank", F.round("score", 6).alias("score"), grade.alias("grade")))


QUERIES, ORACLES = BOOK.queries, BOOK.oracles
