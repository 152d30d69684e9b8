"""Gates on tables and accuracy of rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fenestra.functions.semantics import ladder


def gates(rows: DataFrame, checks: dict[str, tuple[Column, float, bool]]) -> DataFrame:
    """gate, value, threshold, passed, in one pass: aggregate, bound, and whether the value must reach it (or stay below or at it)."""
    one = rows.agg(*(c.cast("double").alias(k) for k, (c, _, _) in checks.items()))
    lines = [F.struct(F.lit(k).alias("gate"), F.col(k).alias("value"), F.lit(float(t)).alias("threshold"), ((F.col(k) >= t) if up else (F.col(k) <= t)).alias("passed")) for k, (_, t, up) in checks.items()]
    return one.select(F.inline(F.array(*lines)))


def topk_accuracy(results: DataFrame, expected: str, predicted: str, by: list[str], ks: list[int]) -> DataFrame:
    """Per group: share of rows of which one of the first k predictions is expected."""
    hit = lambda k: F.arrays_overlap(expected, F.slice(predicted, 1, k)).cast("double")
    return results.groupBy(*by).agg(F.count("*").alias("n"), *(F.avg(hit(k)).alias(f"top{k}") for k in ks))


def coverage(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, share of rows with a value that isn't blank."""
    shares = rows.agg(*(F.avg(F.when(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).isNull(), 0.0).otherwise(1.0)).alias(c) for c in columns))
    return shares.unpivot([], columns, "column", "share")


def errors_of(checks: dict[str, Column]) -> Column:
    """Names of the checks that a row fails."""
    return F.array_compact(F.array(*(F.when(bad, F.lit(k)) for k, bad in checks.items())))


def failure_bucket(wrong_vin: Column, candidate: Column, layer: Column, ktype: Column, wanted: Column) -> Column:
    """Why a request failed: wrongly decoded, another type, no `candidate`, or lost in a later layer.

    A type of null or 0 is unknown.
    """
    other_type = (F.coalesce(ktype, F.lit(0)) != 0) & (F.coalesce(wanted, F.lit(0)) != 0) & (ktype != wanted)
    steps = [(wrong_vin, "vin_decode_error"), ((layer == 0) & other_type, "wrong_ktype"), ((layer == 0) & ~candidate, "missing_candidate"), (layer == 1, "year/generation_gate"), ((layer >= 2) | ~candidate, "model_alias_miss")]
    return ladder(steps, "equipment_mismatch")
