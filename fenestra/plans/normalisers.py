"""Brand and model normalisers over parts, phrase rules over documents; rules are rows that the tables give."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenestra.functions import codes
from fenestra.operators import normalise, phrases
from fenestra.plans.book import Book
from fenestra.sources.tables import table

BOOK = Book()
QUOTED = lambda names: ", ".join("'" + n + "'" for n in names)
#: Words of `phrases.words`, in DuckDB.
WORDS_SQL = lambda x: f"list_filter(regexp_split_to_array(translate({x}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[\\x00-\\x25\\x28-\\x2A\\x2C\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"


# ---------------------------------------------------------------- brands

_RAW_BRAND = """CASE p_partkey % 9 WHEN 0 THEN ' ' || lower(p_brand) WHEN 1 THEN 'NEW' WHEN 2 THEN 'FW' || p_partkey WHEN 3 THEN 'X' WHEN 4 THEN 'PILKINGTON' WHEN 5 THEN 'BOSCH' WHEN 6 THEN 'Tools' WHEN 7 THEN '' ELSE p_brand END"""
_BRAND_TEXT = """CASE WHEN p_size % 3 = 0 THEN p_type || ' ' || p_name ELSE p_type || ' (' || p_brand || '), ' || p_name END"""


@BOOK.query(f"""
WITH r AS (SELECT p_partkey, {_RAW_BRAND} AS brand, {_BRAND_TEXT} AS text, upper(p_brand) AS own, p_name, p_size % 3 <> 0 AS says FROM part)
SELECT p_partkey, CASE WHEN trim(brand) = '' THEN 'UNKNOWN' WHEN trim(upper(brand)) = own THEN own WHEN brand = 'Tools' THEN 'TILBEHØR'
  WHEN brand = 'NEW' THEN CASE WHEN contains(' ' || upper(p_name) || ' ', ' WIDGET ') THEN 'MINI' ELSE 'OTHER' END WHEN says THEN own ELSE 'UNKNOWN' END AS normal_brand FROM r""")
def brand_fixups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands of all parts: aliases in their context, codes, suppliers and short brands by the first known brand in the description."""
    parts = table(spark, sf_dir, "part")
    raw = parts.select("p_partkey", "p_brand", F.expr(_RAW_BRAND).alias("brand"), F.expr(_BRAND_TEXT).alias("text"))
    known = parts.select(F.col("p_brand").alias("phrase"), F.upper("p_brand").alias("brand")).distinct()
    aliases = spark.createDataFrame([("NEW", "WIDGET", "MINI"), ("NEW", None, "OTHER")], "brand string, context string, normal string")
    return normalise.brands(raw, aliases, known, brand="brand", description="text", suppliers=["PILKINGTON", "BOSCH"], no_vehicle=["TOOLS"]).select("p_partkey", "normal_brand")


# ---------------------------------------------------------------- models

_RAW_MODEL = """CASE p_partkey % 4 WHEN 0 THEN p_brand || ' ' || p_name || ' 5D' WHEN 1 THEN replace(p_name, ' ', '') WHEN 2 THEN p_name || '&nbsp;SUV' ELSE 'lastebil ' || p_name END"""
_EVEN = "CAST(substr(p_brand, 7) AS int) % 2 = 0"


@BOOK.query(f"""
WITH r AS (SELECT p_partkey, p_partkey % 4 AS kind, {_EVEN} AS even, split_part(upper(p_name), ' ', 1) AS a, split_part(upper(p_name), ' ', 2) AS b FROM part)
SELECT p_partkey, CASE WHEN kind = 1 THEN a || '-' || b WHEN kind <> 3 AND even THEN a || '-LINE ' || b ELSE a || ' ' || b END AS normal_model FROM r""")
def model_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model texts of all parts: brand and noise gone, the whole or the first word by an alias, of the make first."""
    parts = table(spark, sf_dir, "part")
    raw = parts.select("p_partkey", "p_brand", F.expr(_RAW_MODEL).alias("model"))
    first, second = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    whole = parts.select(F.concat(first, second).alias("phrase"), F.lit(None).cast("string").alias("make"), F.upper(F.concat(first, F.lit("-"), second)).alias("replacement")).distinct()
    heads = parts.where(F.expr(_EVEN)).select(first.alias("phrase"), F.col("p_brand").alias("make"), F.upper(F.concat(first, F.lit("-LINE"))).alias("replacement")).distinct()
    aliases = whole.unionByName(heads).withColumn("priority", F.lit(0))
    return normalise.models(raw, aliases, model="model", make="p_brand").select("p_partkey", "normal_model")


_TEXT = """CASE p_partkey % 6 WHEN 0 THEN '=W' || p_partkey WHEN 1 THEN p_brand || ' 97-04' WHEN 2 THEN p_brand || ' ' || p_type || ' for ' || p_name WHEN 3 THEN 'Bruk W12 ' || p_name WHEN 4 THEN p_brand || ' glass ' || p_type ELSE p_type || ' ' || p_name || ' (new)' END"""


@BOOK.query(f"""
WITH r AS (SELECT p_partkey, p_partkey % 6 AS kind, upper(p_type) AS type, {_EVEN} AS even, upper(p_name) AS name FROM part)
SELECT p_partkey, CASE WHEN kind IN (0, 1, 3) THEN NULL WHEN kind = 4 THEN NULL WHEN even THEN name ELSE type END AS model FROM r""")
def model_from_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models read from descriptions of all parts: known models of the make, else the word after the brand."""
    parts = table(spark, sf_dir, "part")
    known = parts.where(F.expr(_EVEN)).select(F.upper("p_name").alias("phrase"), F.col("p_brand").alias("make")).distinct().withColumn("priority", F.size(F.split("phrase", " ")))
    rows = parts.select("p_partkey", "p_brand", F.expr(_TEXT).alias("text"))
    return normalise.described_models(rows, known, description="text", make="p_brand").select("p_partkey", "model")


# ---------------------------------------------------------------- phrases in documents


HEADS = [2, 3, 5]


@BOOK.query(f"""
WITH RECURSIVE b AS (SELECT item_id, {WORDS_SQL('text')} AS w FROM benchmark WHERE text IS NOT NULL),
rules AS ({' UNION ALL '.join(f"SELECT item_id * 10 + {k} AS rule, {k} AS n, array_to_string(w[1:{k}], ' ') AS phrase, CASE WHEN item_id % 3 = 0 THEN 'en' END AS make FROM b WHERE len(w) >= {k}" for k in HEADS)}),
best AS (SELECT n, phrase, make, min(rule) AS rule FROM rules GROUP BY ALL),
d AS (SELECT doc_id, lang, {WORDS_SQL('text')} AS w FROM documents WHERE text IS NOT NULL),
grams AS ({' UNION ALL '.join(f"SELECT doc_id, lang, {k} AS n, unnest(range(len(w) - {k - 1})) AS pos, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS phrase FROM d WHERE len(w) >= {k}" for k in HEADS)}),
hits AS (SELECT doc_id, pos, n, rule, row_number() OVER (PARTITION BY doc_id, pos ORDER BY n DESC, make IS NULL, rule) AS rn FROM grams JOIN best USING (n, phrase) WHERE make IS NULL OR make = lang),
places AS (SELECT doc_id, pos, n, rule FROM hits WHERE rn = 1),
kept AS (SELECT doc_id, list_reduce(list_prepend({{'e': CAST(0 AS bigint), 'o': ''}}, list({{'e': CAST(pos + n AS bigint), 'o': pos || ':' || n || ':' || rule}} ORDER BY pos)),
  lambda s, x: CASE WHEN CAST(split_part(x.o, ':', 1) AS bigint) >= s.e THEN {{'e': x.e, 'o': s.o || CASE WHEN s.o = '' THEN '' ELSE ',' END || x.o}} ELSE s END) AS k FROM places GROUP BY doc_id)
SELECT doc_id, CAST(len(string_split(k.o, ',')) AS bigint) AS n_matches, sha256(k.o) AS matches_sha256 FROM kept""")
def phrase_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads of benchmark items, a third of them only in English, found in all documents: from the left, longest first."""
    items = table(spark, sf_dir, "benchmark").select("item_id", phrases.words(F.col("text")).alias("w"))
    make = F.when(F.col("item_id") % 3 == 0, F.lit("en"))
    head = lambda k: items.where(F.size("w") >= k).select((F.col("item_id") * 10 + k).alias("rule"), F.array_join(F.slice("w", 1, k), " ").alias("phrase"), make.alias("make"), F.lit("").alias("replacement"), F.lit(0).alias("priority"))
    rules = reduce(DataFrame.unionByName, map(head, HEADS))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    spots = phrases.chosen(phrases.found(docs, rules, key="doc_id", text="text", make="lang"), key="doc_id")
    listed = F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["at"].cast("string"), m["n"].cast("string"), m["rule"].cast("string"))), ",")
    return spots.select("doc_id", F.size("matches").cast("bigint").alias("n_matches"), F.sha2(listed, 256).alias("matches_sha256"))


# ---------------------------------------------------------------- part codes


_CODE_TYPES = [(c, t) for c, t in ((1, "A"), (2, "B"), (3, "F"), (3, "R"), (4, "G"), (5, "AK"), (5, "RS"), (6, "GX"))]
_CODE_TRAITS = ["A", "C", "H", "M", "U"]
_AT = lambda values, i: f"[{', '.join(repr(str(v)) for v in values)}][{i} + 1]"


def _code_sql(pick) -> str:
    """What a part's code is made of, by arithmetic on key and size; `pick` writes the i-th of a list."""
    tables = {"tint": codes.TINTS, "top": codes.TOP_TINTS, "place": codes.PLACES}
    symbol = {k: list(t) for k, t in tables.items()} | {"body": ["H", "S", "C", "E", "M"]}
    return f"""SELECT p_partkey, p_size, {pick([c for c, _ in _CODE_TYPES], "p_partkey % 8")} AS category, {pick([t for _, t in _CODE_TYPES], "p_partkey % 8")} AS type, {pick(symbol["tint"], "p_size % 27")} AS tint,
    CASE WHEN p_partkey % 2 = 1 THEN {pick(symbol["top"], "p_size % 6")} END AS top, CASE WHEN p_partkey % 8 = 1 THEN {pick(symbol["body"], "p_size % 5")} END AS body,
    CASE WHEN p_partkey % 8 IN (2, 3) AND p_size % 4 <> 0 THEN {pick(symbol["place"], "p_size % 9")} END AS place,
    concat({', '.join(f"CASE WHEN floor(p_size / {1 << i}) % 2 = 1 THEN '{t}' ELSE '' END" for i, t in enumerate(_CODE_TRAITS))}) AS traits, lpad(CAST(p_partkey % 10000 AS varchar(9)), 4, '0') AS vehicle FROM part"""


_LABEL = lambda table, key: "CASE " + key + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


@BOOK.query(f"""
WITH c AS ({_code_sql(_AT)}), w AS (SELECT *, vehicle || type || tint || coalesce(top, '') || coalesce(body, '') || coalesce(place, '') || traits AS whole, p_partkey % 13 AS fault FROM c),
x AS (SELECT *, fault NOT IN (5, 7) AS good FROM w)
SELECT p_partkey, CASE fault WHEN 5 THEN vehicle WHEN 7 THEN vehicle || '?' || type WHEN 9 THEN whole || '#1' ELSE whole END AS code,
  CASE WHEN good THEN {_LABEL(codes.CATEGORIES, 'category')} END AS category, CASE WHEN good THEN {_LABEL({t: v for types in codes.TYPES.values() for t, v in types.items()}, 'type')} END AS glass_type,
  CASE WHEN good THEN {_LABEL(codes.TINTS, 'tint')} END AS tint, CASE WHEN good THEN {_LABEL(codes.TOP_TINTS, 'top')} END AS top_tint, CASE WHEN good THEN {_LABEL(codes.BODIES, 'body')} END AS body,
  CASE WHEN good THEN {_LABEL(codes.PLACES, 'place')} END AS position, CASE WHEN good AND place[1] = 'F' THEN 'driver' WHEN good AND place[1] = 'R' THEN 'passenger' END AS side, CASE WHEN good THEN traits ELSE '' END AS traits,
  CASE fault WHEN 5 THEN 'short' WHEN 7 THEN 'type' WHEN 9 THEN 'rest' END AS error, CAST(CASE fault WHEN 5 THEN 5 WHEN 7 THEN 5 WHEN 9 THEN length(whole) + 1 END AS integer) AS error_at FROM x""")
def code_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A code for every part, encoded from its features and decoded again; some are malformed, and the place of the fault is reported."""
    pick = lambda values, i: f"element_at(array({', '.join(repr(str(v)) for v in values)}), CAST({i} AS int) + 1)"
    made = spark.sql(_code_sql(pick).replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))
    whole = codes.encoded(F.col("vehicle"), F.col("type"), F.col("tint"), F.col("top"), F.col("body"), F.col("place"), traits=F.split("traits", ""))
    fault = F.col("p_partkey") % 13
    code = F.when(fault == 5, F.col("vehicle")).when(fault == 7, F.concat("vehicle", F.lit("?"), "type")).when(fault == 9, F.concat(whole, F.lit("#1"))).otherwise(whole)
    read = made.select("p_partkey", code.alias("code")).withColumn("d", codes.decoded(F.col("code")))
    return read.select("p_partkey", "code", "d.category", "d.glass_type", "d.tint", "d.top_tint", "d.body", "d.position", "d.side", F.array_join("d.traits", "").alias("traits"), "d.error", F.col("d.at").alias("error_at"))


QUERIES, ORACLES = BOOK.queries, BOOK.oracles
