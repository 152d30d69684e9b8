"""Scalar functions applied to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenestra.functions import flags, semantics, similarity, text, years
from fenestra.plans.book import Book
from fenestra.sources.tables import table

BOOK = Book()
STOP = ["the", "of", "and"]
NATION_TYPES = [("A", "alpha"), ("B", "beta")]


@BOOK.query(r"""
WITH s AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'X ' || year(o_orderdate) || '-' || (year(o_orderdate) + 3) || '; A' WHEN 1 THEN 'X ' || right(CAST(year(o_orderdate) AS varchar), 2) || '- B'
  WHEN 2 THEN 'X ' || year(o_orderdate) || ' C' ELSE 'X none' END AS d, year(o_orderdate) AS y FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN CAST(y AS int) END AS year_from, CASE WHEN o_orderkey % 4 = 0 THEN CAST(y + 3 AS int) END AS year_to FROM s""")
def year_range_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year ranges written in several forms are read back."""
    y, k = F.year("o_orderdate"), F.col("o_orderkey") % 4
    d = F.when(k == 0, F.concat(F.lit("X "), y.cast("string"), F.lit("-"), (y + 3).cast("string"), F.lit("; A"))).when(k == 1, F.concat(F.lit("X "), F.substring(y.cast("string"), 3, 2), F.lit("- B"))).when(k == 2, F.concat(F.lit("X "), y.cast("string"), F.lit(" C"))).otherwise(F.lit("X none"))
    return table(spark, sf_dir, "orders").select("o_orderkey", years.year_range(d).alias("r")).select("o_orderkey", "r.year_from", "r.year_to")


@BOOK.query(r"""
WITH w AS (SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z0-9 ]', ' ', 'g')) AS t FROM documents),
m AS (SELECT doc_id, list_concat(list_concat(regexp_extract_all(t, '\b([A-Z]\d{2,3})\b', 1), regexp_extract_all(t, '\b(\d[A-Z]{1,2})\b', 1)), regexp_extract_all(t, '\b([A-Z]{2}\d)\b', 1)) AS c FROM w)
SELECT doc_id, CAST(len(list_distinct(c)) AS bigint) AS n_codes, coalesce(list_aggregate(list_sort(list_distinct(c)), 'string_agg', ','), '') AS codes FROM m""")
def chassis_code_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = text.chassis_codes(F.regexp_replace("text", "[^A-Za-z0-9 ]", " "))
    return table(spark, sf_dir, "documents").select("doc_id", codes.alias("c")).select("doc_id", F.size("c").cast("bigint").alias("n_codes"), F.array_join(F.array_sort("c"), ",").alias("codes"))


@BOOK.query("""
WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part), b AS (SELECT unnest(['blues', 'reds', 'bolts', 'gears', 'plates', 'widgets']) AS brand),
s AS (SELECT word, brand, levenshtein(word, brand) AS d, row_number() OVER (PARTITION BY word ORDER BY levenshtein(word, brand), brand) AS r FROM w, b)
SELECT word, CASE WHEN d <= CASE WHEN length(word) <= 4 THEN 1 ELSE 2 END THEN brand END AS brand, d AS distance FROM s WHERE r = 1""")
def levenshtein_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary word nearest to each distinct word, if within a threshold by length. The dictionary is a literal: nothing is joined."""
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    brands = ["blues", "reds", "bolts", "gears", "plates", "widgets"]
    best = F.array_min(F.array(*(F.struct(F.levenshtein(F.col("word"), F.lit(b)).alias("d"), F.lit(b).alias("b")) for b in brands)))
    near = F.col("best.d") <= F.when(F.length("word") <= 4, 1).otherwise(2)
    return words.select("word", best.alias("best")).select("word", F.when(near, F.col("best.b")).alias("brand"), F.col("best.d").cast("bigint").alias("distance"))


@BOOK.query("SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS int), -1) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of a JSON column, with a default for what can't be read."""
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.from_json("props", "k int")["k"], F.lit(-1)).alias("k"))


@BOOK.query(r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(text, '[^A-Za-z0-9 .,]', ' ', 'g'), '[\s;,.\[\]()+-]+'), lambda x: x <> '') AS raw FROM documents),
u AS (SELECT doc_id, list_transform(raw, lambda x: upper(x)) AS w FROM t),
p AS (SELECT doc_id, w, list_position(w, 'THE') AS i FROM u)
SELECT doc_id, CASE WHEN i IS NULL OR i = 0 THEN NULL ELSE NOT (list_has_any(w[greatest(1, i - 3):i - 1], ['OF', 'NOT']) OR list_has_any(w[i + 1:i + 1], ['OF', 'NOT'])) END AS flag FROM p""")
def negation_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a word's first place is without negation near it; null where it doesn't occur. What comes after that place is not cut into tokens."""
    clean = flags.flag_tokens(F.regexp_replace(flags.up_to(F.col("text"), "THE"), "[^A-Za-z0-9 .,]", " "))
    return table(spark, sf_dir, "documents").select("doc_id", flags.mentioned(clean, ["THE"], negations=["OF", "NOT"]).alias("flag"))


@BOOK.query(r"""
WITH w AS (SELECT doc_id, string_split(regexp_replace(text, '[^A-Za-z ]', '', 'g'), ' ') AS w FROM documents)
SELECT doc_id, CAST(len(list_filter(range(1, len(w) + 1), lambda i: i = 1 OR w[i] <> w[i - 1])) AS bigint) AS n FROM w""")
def adjacent_word_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split(F.regexp_replace("text", "[^A-Za-z ]", ""), " ")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.adjacent_once(words)).cast("bigint").alias("n"))


@BOOK.query(r"""
SELECT p_partkey, trim(regexp_replace(regexp_replace(upper(p_name || ' (x) 1.6-16v'), '[^A-Z0-9 ]', ' ', 'g'), '\s+', ' ', 'g')) AS plain,
  list_aggregate(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda t: length(t) >= 2))), 'string_agg', ' ') AS tokens, replace(p_name, ' ', '') AS family
FROM part""")
def text_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.concat("p_name", F.lit(" (x) 1.6-16v"))
    family = F.regexp_replace(text.family_key(F.concat(F.col("p_name"), F.lit(" (x) 1.6 16v")), ["sedan"]), " ", "")
    return table(spark, sf_dir, "part").select("p_partkey", text.plain_upper(noisy).alias("plain"), F.array_join(F.array_sort(text.tokens(F.col("p_name"))), " ").alias("tokens"), family.alias("family"))


CODES = {"GYEL": "green heated", "GN": "green", "BL": "blue", "EL": "heated"}


@BOOK.query("""
WITH c AS (SELECT p_partkey, upper(replace('  ' || p_brand || '-' || p_size || ' ', '#', '')) AS raw, CASE p_size % 3 WHEN 0 THEN 'xgyelbl' WHEN 1 THEN 'gn.el' ELSE 'none' END AS code FROM part)
SELECT p_partkey, regexp_replace(trim(raw), '[\\s.-]+', '', 'g') AS compact, CASE WHEN contains(upper(code), 'GYEL') THEN 'green heated' WHEN contains(upper(code), 'GN') THEN 'green' WHEN contains(upper(code), 'BL') THEN 'blue' WHEN contains(upper(code), 'EL') THEN 'heated' END AS color FROM c""".replace("\\\\s", "\\s"))
def compact_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers without separators, and the longest code of a string."""
    raw = F.regexp_replace(F.concat(F.lit("  "), "p_brand", F.lit("-"), F.col("p_size").cast("string"), F.lit(" ")), "#", "")
    code = F.when(F.col("p_size") % 3 == 0, "xgyelbl").when(F.col("p_size") % 3 == 1, "gn.el").otherwise("none")
    return table(spark, sf_dir, "part").select("p_partkey", text.compact_upper(raw).alias("compact"), text.first_code(code, CODES).alias("color"))


@BOOK.query("""
WITH c AS (SELECT p_partkey, upper(CASE p_size % 3 WHEN 0 THEN 'xgyelbl' ELSE 'gnel' END || right(p_brand, 1)) AS code FROM part),
a AS (SELECT *, CASE WHEN contains(code, 'GYEL') THEN 'green heated' END AS f1, replace(code, 'GYEL', '#') AS r1 FROM c), b AS (SELECT *, CASE WHEN contains(r1, 'GN') THEN 'green' END AS f2, replace(r1, 'GN', '#') AS r2 FROM a),
d AS (SELECT *, CASE WHEN contains(r2, 'BL') THEN 'blue' END AS f3, replace(r2, 'BL', '#') AS r3 FROM b), e AS (SELECT *, CASE WHEN contains(r3, 'EL') THEN 'heated' END AS f4 FROM d)
SELECT p_partkey, concat_ws(', ', f1, f2, f3, f4) AS decoded FROM e""")
def decode_nonoverlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All codes of a string, longest first, none overlapping another."""
    code = F.concat(F.when(F.col("p_size") % 3 == 0, F.lit("xgyelbl")).otherwise(F.lit("gnel")), F.substring("p_brand", -1, 1))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.all_codes(code, [CODES]), ", ").alias("decoded"))


@BOOK.query("""
SELECT o_orderkey, concat_ws(' ', o_orderpriority, CASE WHEN o_totalprice > 100000 THEN 'large' END, CAST(year(o_orderdate) AS varchar)) AS title,
 CASE WHEN d <= 0 THEN 'today' WHEN d = 1 THEN 'yesterday' WHEN d < 7 THEN d || ' days ago' WHEN d < 31 THEN CAST(floor(d / 7) AS bigint) || ' weeks ago' ELSE CAST(floor(d / 30) AS bigint) || ' months ago' END AS age
FROM (SELECT *, date_diff('day', CAST(o_orderdate AS date), DATE '1998-12-01') AS d FROM orders)""")
def label_builders(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat_ws(" ", "o_orderpriority", F.when(F.col("o_totalprice") > 100000, F.lit("large")), F.year("o_orderdate").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", title.alias("title"), text.day_label(F.to_date("o_orderdate"), F.lit("1998-12-01").cast("date")).alias("age"))


@BOOK.query("""
WITH c AS (SELECT o_orderkey, unnest(string_split(o_orderstatus || ',' || substr(o_orderpriority, 1, 1), ',')) AS code FROM orders),
d AS (SELECT * FROM (VALUES ('O', 'open'), ('F', 'final'), ('1', 'urgent'), ('2', 'high')) AS t(code, feature))
SELECT o.o_orderkey, coalesce(string_agg(DISTINCT feature, ',' ORDER BY feature), '') AS features, bool_or(coalesce(feature = 'urgent', false)) AS urgent
FROM orders o LEFT JOIN c USING (o_orderkey) LEFT JOIN d ON c.code = d.code GROUP BY o.o_orderkey""")
def feature_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code lists to features by a small dictionary, which is a literal map: no shuffle."""
    names = F.create_map(*(F.lit(x) for kv in {"O": "open", "F": "final", "1": "urgent", "2": "high"}.items() for x in kv))
    found = F.array_compact(F.transform(F.array(F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)), lambda c: F.try_element_at(names, c)))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("features"), F.array_contains(found, "urgent").alias("urgent"))


@BOOK.query("""
WITH t AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS a, string_split(lower(p_name || ' ' || p_type), ' ') AS b FROM part),
u AS (SELECT p_partkey, list_distinct(a) AS a, list_distinct(b) AS b FROM t),
s AS (SELECT p_partkey, CASE WHEN len(a) <= 2 THEN len(list_intersect(a, b)) / len(a) ELSE len(list_intersect(a, b)) / greatest(len(a), len(b)) END AS score FROM u)
SELECT p_partkey, round(least(0.9, 0.6 + score * 0.3), 6) AS confidence, CASE WHEN score >= 0.95 THEN 'exact' WHEN score >= 0.5 THEN 'high' ELSE 'low' END AS level FROM s""")
def token_precision_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    score = similarity.token_score(words(F.col("p_name")), words(F.concat_ws(" ", "p_name", "p_type")))
    return table(spark, sf_dir, "part").select("p_partkey", score.alias("s")).select("p_partkey", F.round(F.least(F.lit(0.9), F.col("s") * 0.3 + 0.6), 6).alias("confidence"), similarity.level(F.col("s"), [(0.95, "exact"), (0.5, "high")], "low").alias("level"))


GENERATIONS = [("F", 1990, 1993, "mk1"), ("F", 1994, 1996, "mk2"), ("F", 1997, None, "mk3"), ("O", None, 1995, "a"), ("O", 1996, None, "b")]


@BOOK.query("""
WITH g AS (SELECT * FROM (VALUES ('F', 1990, 1993, 'mk1'), ('F', 1994, 1996, 'mk2'), ('F', 1997, NULL, 'mk3'), ('O', NULL, 1995, 'a'), ('O', 1996, NULL, 'b')) AS t(st, lo, hi, generation))
SELECT o_orderkey, generation FROM orders LEFT JOIN g ON o_orderstatus = st AND (lo IS NULL OR lo <= year(o_orderdate)) AND (hi IS NULL OR hi >= year(o_orderdate))""")
def generation_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generations from a table of steps by key and year: a range join to a fixed, broadcast dimension."""
    steps = spark.createDataFrame(GENERATIONS, "st string, lo int, hi int, generation string")
    orders = table(spark, sf_dir, "orders")
    return orders.join(F.broadcast(steps), (F.col("o_orderstatus") == F.col("st")) & semantics.covers(F.col("lo"), F.col("hi"), F.year("o_orderdate")), "left").select("o_orderkey", "generation")


@BOOK.query("""
WITH v AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'WVW' WHEN 1 THEN 'YV1' ELSE 'XXX' END || 'ZZZ1K' || CASE c_custkey % 2 WHEN 0 THEN 'K' ELSE '8' END || '0' FROM customer)
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'volkswagen' WHEN 1 THEN 'volvo' END AS make, CASE c_custkey % 2 WHEN 0 THEN 2019 ELSE 2008 END AS model_year, CASE WHEN c_acctbal > 7000 THEN 'large' WHEN c_acctbal > 3000 THEN 'medium' ELSE 'small' END AS body FROM customer""")
def vin_style_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    vin = F.concat(F.when(k % 3 == 0, F.lit("WVW")).when(k % 3 == 1, F.lit("YV1")).otherwise(F.lit("XXX")), F.lit("ZZZ1K0"), F.when(k % 2 == 0, F.lit("K")).otherwise(F.lit("8")), F.lit("0123456"))
    body = semantics.ladder([(F.col("c_acctbal") > 7000, "large"), (F.col("c_acctbal") > 3000, "medium")], "small")
    return table(spark, sf_dir, "customer").select("c_custkey", years.make_of(vin, [("WVW", "volkswagen"), ("YV", "volvo")]).alias("make"), years.model_year(vin).alias("model_year"), body.alias("body"))


@BOOK.query(r"""
SELECT doc_id, nullif(regexp_extract(text, '\b((?:19|20)\d{2})\b', 1), '') AS year, CASE WHEN regexp_matches(lower(text), '\b(password|token)\b') THEN 'secret' WHEN regexp_matches(lower(text), '\b(license|licensed)\b') THEN 'license' ELSE 'other' END AS intent,
  nullif(regexp_extract(text, '\b(AKIA[A-Z0-9]+)\b', 1), '') AS code FROM (SELECT doc_id, regexp_replace(text, '[^A-Za-z0-9 =.,]', ' ', 'g') AS text FROM documents)""")
def text_entity_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year, intent and code found in free text by ordered patterns."""
    t = F.col("t")
    part = lambda p: F.nullif(F.regexp_extract(t, semantics.whole_word(p).replace("(?:", "(", 1), 1), F.lit(""))
    intent = text.first_keyword(t, [("PASSWORD|TOKEN", "secret"), ("LICENSE|LICENSED", "license")], "other")
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[^A-Za-z0-9 =.,]", " ").alias("t")).select("doc_id", part(r"(?:19|20)\d{2}").alias("year"), intent.alias("intent"), part("AKIA[A-Z0-9]+").alias("code"))


@BOOK.query("""
SELECT p_partkey, upper(split_part(p_name, ' ', 1)) AS brand, trim(substr(p_name, length(split_part(p_name, ' ', 1)) + 1)) AS model, CAST(1990 + p_size % 20 AS int) AS year FROM part""")
def free_text_vehicle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand, model and year of a line of text."""
    line = F.concat_ws(" ", "p_name", (F.col("p_size") % 20 + 1990).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", text.vehicle_text(line, {"LAND ROVER": "LANDROVER", "ALFA ROMEO": "ALFAROMEO"}).alias("v")).select("p_partkey", "v.*")


@BOOK.query()
def jaro_winkler_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names against one hint, scored by overlap and Jaro-Winkler, best 50 of those above 0.4."""
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    scored = names.withColumn("score", F.round(similarity.fuzzy_score(F.lit("blue bolts"), F.col("p_name")), 6))
    return scored.where("score >= 0.4").orderBy(F.desc("score"), "p_name").limit(50)


#: Spellings of models by make, which parts are dealt out over.
MODELS = [
    ("volkswagen nutzfahrzeuge", "Transporter T5"), ("volkswagen nutzfahrzeuge", "Transporter T6"), ("mercedes-amg", "C-Klasse"), ("mercedes-amg", "E-Klasse"), ("mercedes-amg", "Serie W205"),
    ("volkswagen", "Transporter T5"), ("volkswagen", "Multivan T6"), ("volkswagen", "Caravelle"), ("volkswagen", "Golf Variant"), ("volvo", "XC60"), ("volvo", "XC 60"), ("volvo", "V 90"), ("volvo", "740_760-80 serie"), ("volvo", "780"),
    ("jaguar", "Jaguar I-Pace"), ("jaguar", "E-PACE"), ("mazda", "CX-5"), ("mazda", "CX 50"), ("mazda", "cx5"), ("bmw", "BMW X3"), ("bmw", "X30"), ("bmw", "3-serie"), ("bmw", "5 serie"), ("bmw", "3 serie touring"), ("audi", "A3"), ("audi", "A 3"), ("audi", "A30"), ("audi", "Q3 Sportback"),
    ("mercedes", "C-Klasse"), ("mercedes", "serie W204"), ("mercedes", "serie W211 w213b"), ("mercedes", "E-class"), ("mercedes", "Gelandewagen"), ("mercedes", "G-Klasse"), ("mercedes", "GLC"), ("mercedes", "x253"), ("mini", "Countryman"), ("mini", "Mini Countryman Cross"), ("mini", "Cooper S Cross"), ("mini", ""),
]
_PER_PART = f"""
names AS (SELECT row_number() OVER () - 1 AS i, * FROM (VALUES {", ".join(f"('{m}', '{n}')" for m, n in MODELS)}) AS t(make, name)),
dealt AS (SELECT p_partkey, p_brand, make, name FROM part JOIN names ON p_partkey % {len(MODELS)} = i)"""
_MAKE_SQL = lambda makes: "(" + " OR ".join([f"make IN ({', '.join(map(repr, makes))})", *(f"contains(make, '{m}')" for m in makes if m in similarity.LONGER_NAMES)]) + ")"
_SERIES_SQL = " ".join(
    f"WHEN {_MAKE_SQL(makes)} AND regexp_matches(a, '{p}') AND regexp_matches(b, '{p}') THEN " + " AND ".join(f"regexp_extract(a, '{p}', {i + 1}) = regexp_extract(b, '{p}', {i + 1})" for i in range(p.count("(")))
    for makes, p in similarity.SERIES
)
_CLASS_SQL = lambda m: "CASE " + " ".join(f"WHEN contains({m}, '{c}') THEN '{c}'" for c in similarity.CLASS_CODES) + " END"
_ALLOWED_SQL = lambda c: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in similarity.CLASS_CODES.items()) + " ELSE [] END"


@BOOK.query(rf"""
WITH {_PER_PART},
pairs AS (SELECT DISTINCT x.make, x.name AS vehicle, y.name AS record FROM dealt x JOIN dealt y ON x.p_brand = y.p_brand AND x.make = y.make AND x.name <> y.name),
bare AS (SELECT *, trim(CASE WHEN starts_with(lower(vehicle), make || ' ') THEN substr(lower(vehicle), length(make) + 1) ELSE lower(vehicle) END) AS a, trim(CASE WHEN starts_with(lower(record), make || ' ') THEN substr(lower(record), length(make) + 1) ELSE lower(record) END) AS b FROM pairs),
sized AS (SELECT *, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS s, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS l, regexp_replace(a, '[^a-z0-9]', '', 'g') AS pa, regexp_replace(b, '[^a-z0-9]', '', 'g') AS pb,
  list_filter(regexp_split_to_array(a, '[^a-z0-9]+'), lambda t: length(t) >= 2) AS wa, list_filter(regexp_split_to_array(b, '[^a-z0-9]+'), lambda t: length(t) >= 2) AS wb, {_CLASS_SQL('a')} AS ca, {_CLASS_SQL('b')} AS cb,
  regexp_extract_all(a, '\b([wxcr]\d{{3}})[a-z]?\b', 1) AS oa, regexp_extract_all(b, '\b([wxcr]\d{{3}})[a-z]?\b', 1) AS ob FROM bare),
shared AS (SELECT *, list_filter(wb, lambda t: list_contains(wa, t)) AS common FROM sized),
told AS (SELECT make, vehicle, record, CASE WHEN a = '' OR b = '' THEN false
  WHEN contains(l, s) AND NOT (regexp_matches(s, '\d$') AND regexp_matches(substr(l, instr(l, s) + length(s), 1), '^\d')) THEN true
  WHEN (make = 'vw' OR contains(make, 'volkswagen')) AND regexp_matches(a, 'transporter|multivan|caravelle|california') AND regexp_matches(b, 'transporter|multivan|caravelle|california')
    THEN regexp_extract(a, '\b(t[456])\b', 1) = '' OR regexp_extract(b, '\b(t[456])\b', 1) = '' OR regexp_extract(a, '\b(t[456])\b', 1) = regexp_extract(b, '\b(t[456])\b', 1)
  {_SERIES_SQL}
  WHEN make = 'volvo' AND regexp_matches(a, '^\d{{3}}$') AND contains(b, substr(a, 2, 2)) AND contains(b, substr(a, 1, 1)) THEN true
  WHEN contains(make, 'mercedes') AND (coalesce(ca = cb, false) OR (regexp_matches(a, 'g-klasse|gelandewagen') AND regexp_matches(b, 'g-klasse|gelandewagen')) OR list_has_any({_ALLOWED_SQL('ca')}, ob) OR list_has_any({_ALLOWED_SQL('cb')}, oa)) THEN true
  WHEN least(length(pa), length(pb)) >= 3 AND (contains(pa, pb) OR contains(pb, pa)) AND (least(length(pa), length(pb)) >= 4 OR least(length(pa), length(pb)) >= 0.8 * greatest(length(pa), length(pb))) THEN true
  WHEN len(common) >= 2 THEN true
  WHEN len(common) = 1 THEN (length(common[1]) >= 4 AND (common[1] NOT IN ({', '.join(map(repr, similarity.GENERAL_WORDS))}) OR regexp_replace(regexp_replace(a, '^(.*)' || common[1], '\1'), '[^a-z0-9]', '', 'g') = '' OR regexp_replace(regexp_replace(b, '^(.*)' || common[1], '\1'), '[^a-z0-9]', '', 'g') = ''))
    OR (length(common[1]) = 3 AND len(wb) = 1)
  ELSE false END AS same FROM shared)
SELECT make, vehicle, record, same FROM told""")
def model_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the spellings of one make that parts of a brand have, whether they mean the same model.

    Pairs are made of distinct spellings of a brand and make, not of its parts.
    """
    names = F.array(*(F.struct(F.lit(m).alias("make"), F.lit(n).alias("name")) for m, n in MODELS))
    dealt = table(spark, sf_dir, "part").select("p_brand", F.element_at(names, (F.col("p_partkey") % len(MODELS) + 1).cast("int")).alias("m")).select("p_brand", "m.make", F.col("m.name").alias("vehicle")).distinct()
    pairs = dealt.join(dealt.withColumnRenamed("vehicle", "record"), ["p_brand", "make"]).where("vehicle <> record").select("make", "vehicle", "record").distinct()
    return pairs.withColumn("same", similarity.model_equivalent(F.col("vehicle"), F.col("record"), F.col("make")))


QUERIES, ORACLES = BOOK.queries, BOOK.oracles
