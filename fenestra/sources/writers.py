"""Writers: snapshots, appends, idempotent reloads, partitioned exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snapshot(rows: DataFrame, path: str, version: str) -> None:
    """The rows and, beside them, one row with version and count."""
    rows.write.mode("overwrite").parquet(path)
    rows.sparkSession.read.parquet(path).agg(F.count("*").alias("records")).withColumn("version", F.lit(version)).write.mode("overwrite").parquet(f"{path}_meta")


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def export_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def reload_source(rows: DataFrame, path: str, source: str = "source") -> None:
    """Replaces the partitions of the sources that `rows` has; others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(source).parquet(path)


def browse_export(rows: DataFrame, path: str, by: str) -> None:
    rows.repartition(by).write.mode("overwrite").partitionBy(by).json(path)


def minified(rows: DataFrame, columns: list[str], path: str) -> None:
    rows.select(*columns).write.mode("overwrite").option("compression", "gzip").option("ignoreNullFields", True).json(path)


def markdown_lines(rows: DataFrame, columns: dict[str, str], order: list) -> DataFrame:
    """i, line: a short table as lines of Markdown, its heads first. Only for results of few rows, as all are put in one order."""
    spark = rows.sparkSession
    heads = spark.createDataFrame([(0, "| " + " | ".join(columns.values()) + " |"), (1, "|" + "---|" * len(columns))], "i int, line string")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), F.lit(" |"))
    return heads.union(rows.select((F.row_number().over(Window.orderBy(*order)) + 1).alias("i"), line.alias("line")))
