"""Readers of the catalogue's file formats; each is Spark's own reader with the rules of the format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a document that is a list of records, or an object with `records`."""
    raw = spark.read.option("multiLine", True).json(path)
    return raw.select(F.explode("records").alias("r")).select("r.*") if "records" in raw.columns else raw


def ndjson(spark: SparkSession, path: str, schema: StructType | str | None = None, *, status: str | None = None) -> DataFrame:
    """One JSON object a line; broken lines are skipped."""
    reader = spark.read.option("mode", "DROPMALFORMED")
    rows = (reader.schema(schema) if schema else reader).json(path)
    return rows if status is None else rows.where(F.col("status") == status)


def tsv(spark: SparkSession, path: str, schema: str, *, header: bool = True) -> DataFrame:
    """Tab-separated, columns by position; gzipped parts and globs are read alike, missing parts skipped."""
    return spark.read.option("sep", "\t").option("header", header).option("enforceSchema", True).option("ignoreMissingFiles", True).schema(schema).csv(path)


def tsv_least(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Tab-separated without header: lines with fewer fields than names are dropped."""
    cells = spark.read.text(path).select(F.split("value", "\t").alias("c")).where(F.size("c") >= len(names))
    return cells.select(*(F.get("c", F.lit(i)).alias(n) for i, n in enumerate(names)))


def csv_quoted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)


def insert_rows(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Rows of INSERT statements in SQL text, as strings: numbers as they are, quoted texts without quotes, NULL as null."""
    rows = spark.read.text(path).where(F.col("value").rlike(r"^\s*(INSERT\b.*VALUES\s*)?\(")).select(F.explode(F.regexp_extract_all("value", F.lit(r"\(((?:'(?:[^']|'')*'|[^'()])*)\)(?=\s*[,;]|\s*$)"), F.lit(1))).alias("row"))
    fields = rows.select(F.regexp_extract_all("row", F.lit(r"\s*('(?:[^']|'')*'|[^,]+)"), F.lit(1)).alias("f"))
    value = lambda i: F.trim(F.get("f", F.lit(i)))
    clean = lambda v: F.when(F.upper(v) == "NULL", F.lit(None)).when(F.startswith(v, F.lit("'")), F.regexp_replace(F.substr(v, F.lit(2), F.length(v) - 2), "''", "'")).otherwise(v)
    return fields.select(*(clean(value(i)).alias(n) for i, n in enumerate(names)))


def plain_list(spark: SparkSession, path: str, *, comment: str = "#") -> DataFrame:
    """value: trimmed lines that are neither empty nor comments."""
    lines = spark.read.text(path).select(F.trim("value").alias("value"))
    return lines.where((F.col("value") != "") & ~F.startswith("value", F.lit(comment)))


def either_name(rows: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """Columns under one name that sources spell differently: the first spelling with a value."""
    out = rows
    for name, spellings in names.items():
        have = [s for s in spellings if s in rows.columns]
        if have:
            out = out.withColumn(name, F.coalesce(*(rows[s] for s in have))).drop(*(s for s in have if s != name))
    return out


def counter_rows(spark: SparkSession, path: str, form: str) -> DataFrame:
    """(ktype, eurocode, hit_count) of counters in one of three forms, one row for each pair: the one with most hits.

    csv: a header line and plain commas; ndjson: objects, of which broken lines are skipped; seed: objects that
    name types only, which have no code yet and so give no row until one is learned. Codes
    are trimmed and upper-cased; rows without a type (or with 0) or a code ("undefined" and "null" are none in ndjson) are
    left out; a missing, zero or unreadable count is 1. Numbers are read up to their first character that is no digit.
    """
    number = lambda c: F.try_to_number(F.nullif(F.regexp_extract(F.trim(c.cast("string")), r"^([+-]?\d+)", 1), F.lit("")), F.lit("S999999999999999999")).cast("bigint")
    if form == "csv":
        lines = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("quote", "\0").csv(path)
        raw = lines.select(*(F.col(c) if c in lines.columns else F.lit(None).cast("string").alias(c) for c in ("ktype", "eurocode", "hit_count")))
    elif form in ("ndjson", "seed"):
        raw = spark.read.option("mode", "DROPMALFORMED").schema("ktype string, eurocode string, hit_count string").json(path)
        raw = raw.where(~F.upper(F.trim("eurocode")).isin("UNDEFINED", "NULL")) if form == "ndjson" else raw.withColumn("eurocode", F.lit(None).cast("string"))
    else:
        raise ValueError(f"no such form: {form}")
    code = F.nullif(F.upper(F.trim("eurocode")), F.lit(""))
    hits = F.coalesce(F.nullif(number(F.col("hit_count")), F.lit(0)), F.lit(1))
    rows = raw.select(number(F.col("ktype")).alias("ktype"), code.alias("eurocode"), hits.cast("bigint").alias("hit_count")).where("ktype <> 0 AND eurocode IS NOT NULL")
    return rows.groupBy("ktype", "eurocode").agg(F.max("hit_count").alias("hit_count"))
