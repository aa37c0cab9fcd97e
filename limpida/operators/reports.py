"""Reports over documents and their audit arrays. All aggregates combine before they
shuffle; percentiles are sketches of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limpida.operators.validate import severity


def document_stats(documents: DataFrame) -> DataFrame:
    """One row of counts per document."""
    return documents.select(
        "message_id",
        F.length("body_text_canonical").cast("long").alias("body_length"),
        F.size("pii_entities").cast("long").alias("pii_redactions_count"),
        F.array_sort(
            F.array_distinct(F.transform("pii_entities", lambda e: e["type"]))
        ).alias("pii_types"),
        F.size("removed_sections").cast("long").alias("removed_sections_count"),
        F.size("headers_canonical").cast("long").alias("header_count"),
        F.concat_ws("|", "pipeline_version.*").alias("pipeline_version"),
    )


def pii_report(entities: DataFrame) -> DataFrame:
    """Count, mean confidence and distinct pseudonyms by type and method, with subtotals.

    Distinct pseudonyms are counted in two steps, first per (type, method, pseudonym),
    so neither a frequent type nor a frequent address ends up in one task.
    """
    per_value = entities.groupBy("type", "detection_method", "original_hash").agg(
        F.count("*").alias("n"), F.sum("confidence").alias("total")
    )
    leaf = per_value.groupBy("type", "detection_method").agg(
        F.sum("n").alias("n"),
        F.sum("total").alias("total"),
        F.count("*").alias("distinct_values"),
    )
    # Values of different types or methods are different rows, so leaves simply add up.
    return (
        leaf.rollup("type", "detection_method")
        .agg(
            F.sum("n").alias("n"),
            (F.sum("total") / F.sum("n")).alias("avg_confidence"),
            F.sum("distinct_values").alias("distinct_values"),
        )
        .select("type", "detection_method", "n", "avg_confidence", "distinct_values")
    )


def approximate_distinct(entities: DataFrame, relative_error: float = 0.02) -> DataFrame:
    """Distinct pseudonyms per type by a sketch: one pass, constant memory."""
    return entities.groupBy("type").agg(
        F.approx_count_distinct("original_hash", relative_error).alias("approx_values")
    )


def sketch_quality(entities: DataFrame, relative_error: float = 0.02) -> DataFrame:
    """Exact distinct pseudonyms per type, and whether the sketch lies within three standard
    errors of them."""
    both = entities.groupBy("type").agg(
        F.count_distinct("original_hash").alias("n_values"),
        F.approx_count_distinct("original_hash", relative_error).alias("approx"),
    )
    near = F.abs(F.col("approx") - F.col("n_values")) <= 3 * relative_error * F.col("n_values") + 1
    return both.select("type", "n_values", near.alias("near"))


def section_report(sections: DataFrame) -> DataFrame:
    """Number, total and largest length of removed sections by type."""
    length = F.col("span_end") - F.col("span_start")
    return sections.groupBy("type").agg(
        F.count("*").alias("n"),
        F.sum(length.cast("long")).alias("chars_removed"),
        F.max(length.cast("long")).alias("longest"),
        F.max("confidence").alias("confidence"),
    )


def size_histogram(
    sized: DataFrame, before: str, after: str, upper: int = 20_000, buckets: int = 20
) -> DataFrame:
    """Documents per size bucket before and after cleaning."""

    def bucket(column: str) -> Column:
        return F.width_bucket(F.col(column), F.lit(0.0), F.lit(float(upper)), F.lit(buckets))

    sides = F.explode(
        F.array(
            F.struct(F.lit("before").alias("side"), bucket(before).alias("bucket")),
            F.struct(F.lit("after").alias("side"), bucket(after).alias("bucket")),
        )
    )
    return (
        sized.select(sides.alias("s"))
        .groupBy("s.side", "s.bucket")
        .agg(F.count("*").alias("n"))
    )


def outcome_report(documents: DataFrame) -> DataFrame:
    """Documents by status and severity of their error."""
    level = F.when(F.col("error").isNotNull(), severity(F.col("error")))
    return (
        documents.groupBy("status", level.alias("severity")).agg(F.count("*").alias("n"))
    )


def batch_totals(documents: DataFrame) -> DataFrame:
    return documents.agg(
        F.count("*").alias("total_count"),
        F.count_if(F.col("status") == "ok").alias("success_count"),
    )


def latency_report(
    df: DataFrame, duration: str, *keys: str, accuracy: int = 100_000
) -> DataFrame:
    """Mean, spread and percentiles of a duration column."""
    p = F.percentile_approx(duration, [0.5, 0.99], accuracy)
    return (
        df.groupBy(*keys)
        .agg(
            F.count("*").alias("n"),
            F.avg(duration).alias("mean"),
            F.min(duration).alias("min"),
            F.max(duration).alias("max"),
            F.stddev_samp(duration).alias("stddev"),
            p.alias("__p"),
        )
        .withColumns({"p50": F.col("__p")[0], "p99": F.col("__p")[1]})
        .drop("__p")
    )
