"""From raw documents to a training mix: five stages, each one of the numbered operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fenestra.llm import decontaminate, exact, jaccard, mixing, toxicity
from fenestra.llm.common import stored

#: SQL can't express the first stage (a trained model), the fourth's index or the last one's optimum.
ORACLE_SQL = None


def _drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.7 or more go; labels are those that aren't held out."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space, the longest original stays, then the smallest doc_id."""
    return exact.drop_copies(docs)


def _drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 on five-word shingles, the smallest doc_id stays."""
    return jaccard.drop_near(docs, words=5, percent=80)


def _drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their copies: doc_id, source, size, source_size, target, taken, copies."""
    mix = mixing.mix_sources(docs)
    return mix.where("copies > 0").select("doc_id", "source", "size", "source_size", "target", "taken", "copies")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", _drop_toxic),
    ("exact_dedup", _drop_copies),
    ("ngram_jaccard", _drop_near),
    ("decontaminate", _drop_contaminated),
    ("mix_sources", _mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage keeps is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
