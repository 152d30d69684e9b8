"""Queries of the numbered operators, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fenestra.llm import decontaminate, exact, jaccard, langid, licenses, lines, mixing, oracles, packing, prefix_trie, secrets, tokens, toxicity, treaps

QUERIES: dict = {}
ORACLES: dict = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents")).drop("matches")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(_table(spark, sf_dir, "documents")).drop("text")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_groups(_table(spark, sf_dir, "documents"), words=4, percent=85).drop("row", "kept")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_table(spark, sf_dir, "documents")).drop("row", "keep_row")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.edited_counts(_table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("row", "n_near")


def op9_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proximity matches beside the columns of the contract, which op9_decontaminate alone has."""
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("row")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"))


def op11_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treaps.ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"), family=5, shares=prefix_trie.crc_shares, most=8)


QUERIES |= {
    f.__name__: f
    for f in (op1_mix_sources, op2_toxicity, op3_line_dedup, op4_language, op5_ngram_jaccard, op6_licenses, op7_exact_dedup, op8_token_counts, op9_decontaminate, op9_proximity, op10_secrets, op11_pack, op12_ranked_search, op13_prefix_trie)
}
ORACLES |= {"op3_line_dedup": oracles.LINES, "op5_ngram_jaccard": oracles.JACCARD, "op7_exact_dedup": oracles.COPIES, "op9_decontaminate": oracles.LEAKS, "op12_ranked_search": oracles.RANKED, "op13_prefix_trie": oracles.TRIE}
