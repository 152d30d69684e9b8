"""Gates, checks and reports over a catalogue, and the small scores that they use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fenestra.functions import flags, semantics, similarity, years
from fenestra.operators import match, quality, windows
from fenestra.plans.book import Book
from fenestra.sources.tables import table
from fenestra.sources.writers import markdown_lines

BOOK = Book()


@BOOK.query("""
WITH r AS (SELECT p_partkey, p_size % 4 - 1 AS layer, p_size % 5 = 0 AS has_vin, CASE WHEN p_size % 10 = 0 THEN p_brand ELSE 'other' END AS decoded, p_brand AS make, p_type AS expected,
  [CASE WHEN p_size % 2 = 0 THEN p_type ELSE 'x' END, 'y'] AS candidates, p_size % 7 AS ktype, CASE WHEN p_size % 3 = 0 THEN p_size % 7 ELSE 1 END AS wanted FROM part)
SELECT p_partkey, CASE WHEN has_vin AND decoded <> make THEN 'vin_decode_error' WHEN layer = 0 AND ktype <> 0 AND wanted <> 0 AND ktype <> wanted THEN 'wrong_ktype' WHEN layer = 0 AND NOT list_contains(candidates, expected) THEN 'missing_candidate'
  WHEN layer = 1 THEN 'year/generation_gate' WHEN layer >= 2 OR NOT list_contains(candidates, expected) THEN 'model_alias_miss' ELSE 'equipment_mismatch' END AS bucket FROM r""")
def failure_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why an evaluated request failed."""
    size = F.col("p_size")
    wrong_vin = (size % 5 == 0) & (F.when(size % 10 == 0, F.col("p_brand")).otherwise("other") != F.col("p_brand"))
    candidates = F.array(F.when(size % 2 == 0, F.col("p_type")).otherwise("x"), F.lit("y"))
    bucket = quality.failure_bucket(wrong_vin, F.array_contains(candidates, F.col("p_type")), size % 4 - 1, size % 7, F.when(size % 3 == 0, size % 7).otherwise(1))
    return table(spark, sf_dir, "part").select("p_partkey", bucket.alias("bucket"))


@BOOK.query("""
SELECT p_partkey, round(((CASE WHEN p_size % 4 = 0 THEN 3 ELSE 0 END) + 2 + (CASE WHEN p_size % 3 <> 0 THEN 1 ELSE 0 END) + (CASE WHEN p_size > 25 THEN 1 ELSE 0 END) + (CASE WHEN p_type LIKE '%S%' THEN 1 ELSE 0 END)) / 8.0, 6) AS confidence FROM part""")
def extraction_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How complete an extraction is: identifier, make, model, year and position by weight."""
    size = F.col("p_size")
    fields = [(F.when(size % 4 == 0, F.lit("id")), 3), (F.col("p_brand"), 2), (F.when(size % 3 != 0, F.col("p_name")), 1), (F.when(size > 25, size), 1), (F.when(F.contains("p_type", F.lit("S")), F.col("p_type")), 1)]
    return table(spark, sf_dir, "part").select("p_partkey", F.round(similarity.completeness(fields), 6).alias("confidence"))


@BOOK.query("""
WITH f AS (SELECT p_partkey, p_size AS year, p_size - p_size % 10 AS lo, CASE WHEN p_size % 3 = 0 THEN max(p_size) OVER (PARTITION BY p_brand, p_name) ELSE p_size + 4 END AS hi FROM part)
SELECT p_partkey, round(0.1 * (1 - CASE WHEN hi - lo + 1 > 0 THEN least(1.0, abs(year - (lo + hi) / 2.0) / ((hi - lo + 1) / 2.0)) ELSE 0.0 END), 6) AS bonus FROM f""")
def year_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bonus for years near the middle of a range, of which an open end is the last of the siblings."""
    last = F.max("p_size").over(Window.partitionBy("p_brand", "p_name"))
    high = F.when(F.col("p_size") % 3 == 0, last).otherwise(F.col("p_size") + 4)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(semantics.centrality(F.col("p_size") - F.col("p_size") % 10, high, F.col("p_size")) * 0.1, 6).alias("bonus"))


@BOOK.query("""
WITH d AS (SELECT doc_id, lower(regexp_replace(text, '[^A-Za-z ]', ' ', 'g')) AS t FROM documents),
p AS (SELECT doc_id, t, instr(t, 'the') AS a, instr(t, 'and') AS b FROM d)
SELECT doc_id, CASE WHEN a = 0 AND b = 0 THEN NULL ELSE NOT (coalesce(a > 0 AND regexp_matches(substr(t, greatest(1, a - 15), least(15, a - 1)), 'of|is'), false) OR coalesce(b > 0 AND regexp_matches(substr(t, greatest(1, b - 15), least(15, b - 1)), 'of|is'), false)) END AS flag FROM p""")
def character_negation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a keyword occurs without a negation in the fifteen characters before it; null where none occurs."""
    clean = F.lower(F.regexp_replace("text", "[^A-Za-z ]", " "))
    return table(spark, sf_dir, "documents").select("doc_id", flags.mentioned_within(clean, ["the", "and"], "of|is", 15).alias("flag"))


@BOOK.query("""
WITH c AS (SELECT p_partkey AS code, p_brand AS c_brand, lpad(CAST(p_partkey * 7 % 400 AS varchar), 4, '0') || substr(p_type, 1, 1) AS sku FROM part WHERE p_size > 25),
a AS (SELECT p_partkey, p_brand, lpad(CAST(p_partkey * 3 % 600 AS varchar), 4, '0') || substr(p_name, 1, 1) AS sku FROM part),
e AS (SELECT sku, min(code) AS code FROM c GROUP BY sku), b AS (SELECT substr(sku, 1, 4) AS prefix, c_brand, min(code) AS code FROM c GROUP BY 1, 2), f AS (SELECT substr(sku, 1, 4) AS prefix, min(code) AS code FROM c GROUP BY 1)
SELECT p_partkey, coalesce(e.code, b.code, f.code) AS code, CASE WHEN e.code IS NOT NULL THEN 'exact' WHEN f.code IS NOT NULL THEN 'prefix4' ELSE 'none' END AS match
FROM a LEFT JOIN e ON a.sku = e.sku LEFT JOIN b ON substr(a.sku, 1, 4) = b.prefix AND a.p_brand = b.c_brand LEFT JOIN f ON substr(a.sku, 1, 4) = f.prefix""")
def prefix_fallback_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes by equality, else by their first four characters, of the same brand if any; each fallback is reduced to a row a key before it is joined."""
    parts = table(spark, sf_dir, "part")
    sku = lambda by, most, c: F.concat(F.lpad((F.col("p_partkey") * by % most).cast("string"), 4, "0"), F.substring(c, 1, 1))
    known = parts.where("p_size > 25").select("p_partkey", "p_brand", sku(7, 400, "p_type").alias("sku")).withColumn("prefix", F.substring("sku", 1, 4))
    least = lambda keys, name: known.groupBy(*keys).agg(F.min("p_partkey").alias(name))
    asked = parts.select("p_partkey", "p_brand", sku(3, 600, "p_name").alias("sku")).withColumn("prefix", F.substring("sku", 1, 4))
    met = asked.join(least(["sku"], "exact"), "sku", "left").join(least(["prefix", "p_brand"], "own"), ["prefix", "p_brand"], "left").join(least(["prefix"], "any"), "prefix", "left")
    return met.select("p_partkey", F.coalesce("exact", "own", "any").alias("code"), semantics.ladder([(F.col("exact").isNotNull(), "exact"), (F.col("any").isNotNull(), "prefix4")], "none").alias("match"))


@BOOK.query("""
WITH r AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'trusted' ELSE 'supplier' END AS source, CASE WHEN p_size % 5 = 0 THEN 'UNKNOWN' ELSE p_brand END AS brand, CASE WHEN p_size % 9 = 0 THEN ' ' ELSE p_name END AS model,
  CASE p_size % 7 WHEN 0 THEN '+++ USE ' || p_name WHEN 1 THEN 'use ' || p_name ELSE p_name END AS text FROM part)
SELECT p_partkey, source FROM r WHERE (source = 'trusted' OR (brand <> 'UNKNOWN' AND trim(model) <> '')) AND NOT regexp_matches(upper(text), '^(\\+\\+\\+ ?)?(USE|BRUK) ')""".replace("\\\\", "\\"))
def supplier_row_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with make and model, or of a trusted source, that don't merely refer to another article."""
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(size % 4 == 0, "trusted").otherwise("supplier").alias("source"), F.when(size % 5 == 0, "UNKNOWN").otherwise(F.col("p_brand")).alias("brand"), F.when(size % 9 == 0, " ").otherwise(F.col("p_name")).alias("model"),
        F.when(size % 7 == 0, F.concat(F.lit("+++ USE "), "p_name")).when(size % 7 == 1, F.concat(F.lit("use "), "p_name")).otherwise(F.col("p_name")).alias("text"),
    )
    known = (F.col("brand") != "UNKNOWN") & semantics.blank_to_null(F.col("model")).isNotNull()
    return rows.where(((F.col("source") == "trusted") | known) & ~F.upper("text").rlike(r"^(\+\+\+ ?)?(USE|BRUK) ")).select("p_partkey", "source")


@BOOK.query("""
WITH s AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part)
SELECT p_brand, count(*) AS checked, count(*) FILTER (WHERE NOT regexp_matches(p_name, '^[a-z]+ [a-z]+$') OR p_size % 13 = 0) AS invalid, count(*) FILTER (WHERE NOT regexp_matches(p_name, '^[a-z]+ [a-z]+$') OR p_size % 13 = 0) <= 0.1 * count(*) AS passed FROM s WHERE rn <= 100 GROUP BY p_brand""")
def source_sample_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred rows of each source: how many are invalid, and whether that is few enough. The limit is the check."""
    first = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    bad = ~F.col("p_name").rlike("^[a-z]+ [a-z]+$") | (F.col("p_size") % 13 == 0)
    checked = table(spark, sf_dir, "part").withColumn("rn", first).where("rn <= 100").groupBy("p_brand").agg(F.count("*").alias("checked"), F.count_if(bad).alias("invalid"))
    return checked.withColumn("passed", F.col("invalid") <= F.col("checked") * 0.1)


@BOOK.query("""
WITH c AS (SELECT (p_partkey - 1) // 500 AS chunk, count(*) AS n, count(DISTINCT p_partkey) AS keys FROM part WHERE p_partkey % 997 <> 3 GROUP BY 1)
SELECT chunk, n, n = keys AND n = 500 AS ok FROM c""")
def chunk_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published chunks of 500 keys: rows of each, and whether they are whole and without repeats."""
    published = table(spark, sf_dir, "part").where("p_partkey % 997 <> 3").withColumn("chunk", F.expr("(p_partkey - 1) div 500"))
    found = published.groupBy("chunk", "p_partkey").agg(F.count("*").alias("k")).groupBy("chunk").agg(F.sum("k").alias("n"), F.count("*").alias("keys"))
    return found.select("chunk", "n", ((F.col("n") == F.col("keys")) & (F.col("n") == 500)).alias("ok"))


@BOOK.query("""
WITH m AS (SELECT date_trunc('month', CAST(o_orderdate AS date)) AS month, count(*) AS n FROM orders GROUP BY 1), d AS (SELECT *, lag(n) OVER (ORDER BY month) AS previous FROM m)
SELECT strftime(month, '%Y-%m-%d') AS month, coalesce(abs(n - previous) / previous <= 0.1, true) AS passed FROM d""")
def deviation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a month's count is within a tenth of the month before."""
    months = table(spark, sf_dir, "orders").groupBy(F.date_format(F.trunc(F.to_date("o_orderdate"), "month"), "yyyy-MM-dd").alias("month")).agg(F.count("*").alias("n"))
    return windows.deviation(months, [], "month", "n").select("month", F.coalesce(F.abs("ratio") <= 0.1, F.lit(True)).alias("passed"))


@BOOK.query("SELECT p_partkey, p_name FROM part ORDER BY md5('7|' || p_partkey), p_partkey LIMIT 50")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty parts at random by a seed; the same at every run, and a top-k instead of a sort of all rows."""
    return table(spark, sf_dir, "part").select("p_partkey", "p_name").orderBy(F.md5(F.concat(F.lit("7|"), F.col("p_partkey").cast("string"))), "p_partkey").limit(50)


@BOOK.query("""
WITH b AS (SELECT p_brand, count(*) AS n, CAST(floor(avg(CAST(p_size % 4 <> 0 AS int)) * 100 + 0.5) AS bigint) AS share FROM part GROUP BY p_brand)
SELECT 0 AS i, '| brand | rows | with key, % |' AS line UNION ALL SELECT 1, '|---|---|---|' UNION ALL SELECT 1 + row_number() OVER (ORDER BY n DESC, p_brand), '| ' || p_brand || ' | ' || n || ' | ' || share || ' |' FROM b""")
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of the brands as lines of Markdown; a row a brand is ordered, not the parts."""
    brands = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.floor(F.avg((F.col("p_size") % 4 != 0).cast("int")) * 100 + 0.5).alias("share"))
    return markdown_lines(brands, {"p_brand": "brand", "n": "rows", "share": "with key, %"}, [F.desc("n"), "p_brand"])


@BOOK.query("""
WITH r AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN ' ' || lower(p_brand) ELSE p_brand END AS brand, CASE WHEN p_size > 40 THEN 20 ELSE p_size END AS lo, CASE p_type WHEN 'STEEL' THEN 'metal' END AS category, p_size FROM part),
c AS (SELECT brand <> 'Brand' || substr(trim(brand), 6) AS b, lo <> p_size AS y, category IS NULL AS k FROM r)
SELECT 'brand' AS field, count(*) FILTER (WHERE b) AS changed FROM c UNION ALL SELECT 'year', count(*) FILTER (WHERE y) FROM c UNION ALL SELECT 'category', count(*) FILTER (WHERE k) FROM c UNION ALL SELECT 'rows', count(*) FILTER (WHERE b OR y OR k) FROM c""")
def catalogue_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand, years and category put right in one projection, with the number of changes of each and of changed rows."""
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select(F.when(size % 5 == 0, F.concat(F.lit(" "), F.lower("p_brand"))).otherwise(F.col("p_brand")).alias("brand"), F.when(size > 40, 20).otherwise(size).alias("lo"), F.when(F.col("p_type") == "STEEL", "metal").alias("category"), "p_size")
    fixed = rows.select((F.concat(F.lit("Brand"), F.substring(F.trim("brand"), 6, 100)) != F.col("brand")).alias("brand"), (F.col("lo") != F.col("p_size")).alias("year"), F.col("category").isNull().alias("category"))
    counts = fixed.withColumn("rows", F.col("brand") | F.col("year") | F.col("category")).agg(*(F.count_if(c).alias(c) for c in ("brand", "year", "category", "rows")))
    return counts.unpivot([], ["brand", "year", "category", "rows"], "field", "changed")


STEPS = [("STEEL", 1, 20, "T4"), ("STEEL", 21, 35, "T5"), ("STEEL", 36, None, "T6"), ("TIN", 1, 25, "T5"), ("TIN", 26, None, "T6")]
_STEPS_SQL = ", ".join(f"('{k}', {lo}, {'NULL' if hi is None else hi}, '{g}')" for k, lo, hi, g in STEPS)


@BOOK.query(f"""
WITH g AS (SELECT * FROM (VALUES {_STEPS_SQL}) AS t(key, lo, hi, generation)),
r AS (SELECT p_partkey, p_type, p_size AS year, p_name || CASE p_partkey % 4 WHEN 0 THEN ' (t5) 2' WHEN 1 THEN ' mk6' WHEN 2 THEN ' T-4' ELSE '' END AS text, CASE WHEN p_partkey % 3 > 0 THEN p_size - p_partkey % 9 + 3 END AS lo, CASE WHEN p_partkey % 3 > 1 THEN p_size + p_partkey % 5 END AS hi FROM part),
e AS (SELECT r.*, g.generation AS expected, CASE WHEN regexp_matches(upper(text), '\\b(T|MK)[- ]?[456]\\b') THEN 'T' || regexp_extract(upper(text), '\\b(T|MK)[- ]?([456])\\b', 2) END AS said FROM r LEFT JOIN g ON p_type = key AND year >= g.lo AND (g.hi IS NULL OR year <= g.hi)),
i AS (SELECT e.*, g.generation AS inferred FROM e LEFT JOIN g ON p_type = key AND (e.lo + coalesce(e.hi, e.lo + 10)) / 2.0 >= g.lo AND (g.hi IS NULL OR (e.lo + coalesce(e.hi, e.lo + 10)) / 2.0 < g.hi + 1))
SELECT p_partkey, CASE WHEN expected IS NOT NULL AND said IS NOT NULL THEN expected = said WHEN expected IS NOT NULL AND inferred IS NOT NULL AND inferred <> expected THEN false ELSE (lo IS NULL OR year >= lo) AND (hi IS NULL OR year <= hi) END AS fits FROM i""".replace("\\\\", "\\"))
def generation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a record fits a year: by the generation that its text says, else by that which its range implies, else by the range.

    Both generations come from one table of steps, a range join to a fixed, broadcast dimension.
    """
    steps = F.broadcast(spark.createDataFrame(STEPS, "key string, s_lo int, s_hi int, generation string"))
    k = F.col("p_partkey") % 4
    text = F.concat("p_name", F.when(k == 0, " (t5) 2").when(k == 1, " mk6").when(k == 2, " T-4").otherwise(""))
    low, high = F.when(F.col("p_partkey") % 3 > 0, F.col("p_size") - F.col("p_partkey") % 9 + 3), F.when(F.col("p_partkey") % 3 > 1, F.col("p_size") + F.col("p_partkey") % 5)
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_type", F.col("p_size").alias("year"), years.generation_of(text).alias("said"), low.alias("lo"), high.alias("hi"))

    def with_step(d: DataFrame, at: Column, name: str) -> DataFrame:
        held = (F.col("p_type") == F.col("key")) & (at >= F.col("s_lo")) & (F.col("s_hi").isNull() | (at < F.col("s_hi") + 1))
        return d.join(steps, held, "left").withColumnRenamed("generation", name).drop("key", "s_lo", "s_hi")

    middle = (F.col("lo") + F.coalesce("hi", F.col("lo") + 10)) / 2
    both = with_step(with_step(rows, F.col("year"), "expected"), middle, "inferred")
    other = F.coalesce(F.col("inferred") != F.col("expected"), F.lit(False))
    in_range = semantics.covers(F.col("lo"), F.col("hi"), F.col("year"))
    return both.select("p_partkey", semantics.ladder([(F.col("expected").isNotNull() & F.col("said").isNotNull(), F.col("expected") == F.col("said")), (other, F.lit(False))], None).alias("told"), in_range.alias("r")).select("p_partkey", F.coalesce("told", "r").alias("fits"))


@BOOK.query("""
WITH d AS (SELECT DISTINCT p_brand, p_type, p_name, p_size FROM part WHERE p_size % 6 = 0), c AS (SELECT p_brand, p_type, p_name, p_size, min(p_partkey) AS code FROM part WHERE p_size % 6 <> 0 GROUP BY ALL),
s AS (SELECT d.*, code, round(0.4 + CASE WHEN abs(d.p_size - c.p_size) <= 2 THEN 0.2 ELSE 0 END + CASE WHEN d.p_type = c.p_type THEN 0.25 ELSE 0 END + 0.15 + CASE WHEN count(*) OVER (PARTITION BY d.p_brand, d.p_type, d.p_name, d.p_size) = 1 THEN 0.1 ELSE 0 END, 6)::double AS score FROM d JOIN c ON d.p_brand = c.p_brand AND d.p_name = c.p_name),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type, p_name, p_size ORDER BY score DESC, code) AS rn FROM s)
SELECT p_partkey, code, score FROM part JOIN r USING (p_brand, p_type, p_name, p_size) WHERE rn = 1""")
def sku_mapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own articles to catalogue codes of the same brand and title: 0.40, 0.20 for near years, 0.25 for the type, 0.15 for the title, 0.10 more for an only candidate."""
    parts, key = table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_name", "p_size"]
    asked = parts.where("p_size % 6 = 0").select(*key).distinct()
    codes = parts.where("p_size % 6 <> 0").groupBy("p_brand", F.col("p_type").alias("c_type"), "p_name", F.col("p_size").alias("c_size")).agg(F.min("p_partkey").alias("code"))
    near, same = F.when(F.abs(F.col("p_size") - F.col("c_size")) <= 2, 0.2).otherwise(0.0), F.when(F.col("p_type") == F.col("c_type"), 0.25).otherwise(0.0)
    pairs = match.blocked_join(asked, codes, ["p_brand", "p_name"], near + same + 0.55)
    only = F.when(F.count("*").over(Window.partitionBy(*key)) == 1, 0.1).otherwise(0.0)
    best = match.best_with_gap(pairs.withColumn("score", F.round(F.col("score") + only, 6)), key, "score", ["code"])
    return parts.join(best.select(*key, "code", "score"), key).select("p_partkey", "code", "score")


QUERIES, ORACLES = BOOK.queries, BOOK.oracles
