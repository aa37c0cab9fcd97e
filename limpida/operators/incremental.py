"""Reports that add up: a small sketch per day is stored, and any span of days is read from the sketches.

A day is summed up once; later reports merge the stored sketches and read no findings again. Merging is
exact for what the sketches hold, so the errors below are those of one sketch, not of a sum of days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers of a distinct-count sketch as a power of two, and its relative standard error.
HLL_POWER = 12
HLL_ERROR = 1.04 / 2 ** (HLL_POWER / 2)
#: Size of a quantile sketch, and the error in rank that it keeps at 99 % confidence.
KLL_SIZE = 800
KLL_ERROR = 0.01


def daily_distinct(findings: DataFrame, day: Column, value: str, *keys: str) -> DataFrame:
    """Per day and key: rows, and a sketch of the distinct values."""
    return findings.groupBy(day.alias("day"), *keys).agg(
        F.count("*").alias("n"), F.hll_sketch_agg(value, HLL_POWER).alias("sketch")
    )


def distinct_of_days(daily: DataFrame, *keys: str) -> DataFrame:
    """Rows and distinct values over the given days, by key; a value of several days counts once."""
    return daily.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_values")
    )


def daily_quantiles(df: DataFrame, day: Column, value: str, *keys: str) -> DataFrame:
    """Per day and key: rows, and a sketch of the distribution of ``value``; nulls are left out."""
    given = df.where(F.col(value).isNotNull())
    return given.groupBy(day.alias("day"), *keys).agg(
        F.count("*").alias("n"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), KLL_SIZE).alias("sketch"),
    )


def quantiles_of_days(daily: DataFrame, quantiles: Sequence[float], *keys: str) -> DataFrame:
    """Rows and quantiles over the given days, by key; each within ``KLL_ERROR`` of its rank."""
    merged = daily.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    points = [
        F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias(f"p{q * 100:g}".replace(".", "_")) for q in quantiles
    ]
    return merged.select(*keys, "n", *points)
