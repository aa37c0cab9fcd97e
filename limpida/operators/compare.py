"""Comparison of two runs, and of findings with what was expected.

Runs are compared as multisets by grouping, never by joining on the key: a key that
occurs n times on each side would join to n times n rows, and a hot key to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _comparable(df: DataFrame, name: str) -> Column:
    """A column as text; maps become sorted entries, nulls stay apart from texts."""
    kind = df.schema[name].dataType
    value = F.col(name)
    if isinstance(kind, T.MapType):
        value = F.array_sort(F.map_entries(value))
    if isinstance(kind, (T.MapType, T.ArrayType, T.StructType)):
        value = F.to_json(value)
    return value.cast("string")


def differing_rows(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that do not occur equally often on both sides, with both counts.

    ``columns`` are the key first, then what is compared; of these only a digest is shuffled
    and returned, as column ``digest``.
    """
    key, *compared = columns

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            key,
            F.sha2(F.to_json(F.struct(*(_comparable(df, c).alias(c) for c in compared))), 256).alias("digest"),
            F.lit(int(name == "left")).alias("l"),
            F.lit(int(name == "right")).alias("r"),
        )

    return (
        side(left, "left")
        .unionAll(side(right, "right"))
        .groupBy(key, "digest")
        .agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right"))
        .filter(F.col("n_left") != F.col("n_right"))
    )


def is_deterministic(runs: list[DataFrame], columns: list[str]) -> bool:
    """True when all runs hold the same rows. Give runs read back from tables: two equal
    plans in one job would share their work and so agree by construction."""
    return all(differing_rows(runs[0], other, columns).isEmpty() for other in runs[1:])


def drift_by_column(
    left: DataFrame, right: DataFrame, key: str, columns: list[str]
) -> DataFrame:
    """For every column: keys compared, and keys whose values differ between two runs."""

    def side(df: DataFrame, l: int, r: int) -> DataFrame:
        cells = F.array(
            *(
                F.struct(
                    F.lit(c).alias("column_name"),
                    F.sha2(F.coalesce(_comparable(df, c), F.lit("\x00null")), 256).alias("digest"),
                )
                for c in columns
            )
        )
        return df.select(key, F.inline(cells), F.lit(l).alias("l"), F.lit(r).alias("r"))

    cells = (
        side(left, 1, 0)
        .unionAll(side(right, 0, 1))
        .groupBy(key, "column_name", "digest")
        .agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    )
    keys = cells.groupBy(key, "column_name").agg(
        F.max((F.col("l") != F.col("r")).cast("long")).alias("differs")
    )
    return keys.groupBy("column_name").agg(
        F.count("*").alias("n_keys"), F.sum("differs").alias("n_differing")
    )


def missing_findings(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Expected findings that were not made. Copies of a finding are folded first, so the
    join sees every key once per side."""
    return expected.join(found.select(*keys).distinct(), keys, "left_anti")
