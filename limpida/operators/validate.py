"""Validation, error classes, retry and record rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words in an error message and the severity they mean, tried in order.
SEVERITY_WORDS = (
    ("critical", ("memory", "out of memory", "killed", "segfault")),
    ("high", ("pii", "parse")),
    ("medium", ("timeout", "canon")),
)
DEFAULT_SEVERITY = "low"
FINAL_ERROR_WORD = "validation"
DETECTION_METHODS = ("regex", "ner", "hybrid")  # fixed value
MAX_PREVIEW = 100  # fixed value


def _empty(value: Column) -> Column:
    return value.isNull() | (value == "")


def reject_reason(columns: list[str]) -> Column:
    """Why a message cannot be processed; null for a good one. First failing rule wins."""
    no_raw = (
        F.col("raw_bytes").isNull() | (F.octet_length("raw_bytes") == 0)
        if "raw_bytes" in columns
        else F.lit(True)
    )
    return (
        F.when(_empty(F.col("message_id")), "Missing message_id")
        .when(_empty(F.col("body_text")) & no_raw, "Empty email body")
        .when(F.col("headers").isNull() | (F.size("headers") == 0), "Missing headers")
    )


def with_reject_reason(messages: DataFrame) -> DataFrame:
    return messages.withColumn("reject_reason", reject_reason(messages.columns))


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reject_reason").isNull())


def rejected(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reject_reason").isNotNull())


def severity(message: Column) -> Column:
    """Severity of an error message."""
    lowered = F.lower(F.coalesce(message, F.lit("")))
    result = F
    for level, words in SEVERITY_WORDS:
        found = reduce(lambda a, b: a | b, (F.contains(lowered, F.lit(w)) for w in words))
        result = result.when(found, level)
    return result.otherwise(DEFAULT_SEVERITY)


def may_retry(message: Column, attempt: Column, max_attempts: int = 3) -> Column:
    """True for rows that a replay job should read again."""
    lowered = F.lower(F.coalesce(message, F.lit("")))
    return (
        (attempt < max_attempts)
        & (severity(message) != "critical")
        & ~F.contains(lowered, F.lit(FINAL_ERROR_WORD))
    )


def _bad_span(record: Column) -> Column:
    return (record["span_start"] < 0) | (record["span_end"] < record["span_start"])


def _bad_confidence(record: Column) -> Column:
    return ~record["confidence"].between(0.0, 1.0)


def with_rule_violations(documents: DataFrame) -> DataFrame:
    """Count broken record rules per document; missing arrays count as empty."""
    pii, cut = F.col("pii_entities"), F.col("removed_sections")

    def count(records: Column, rule) -> Column:
        broken = F.size(F.filter(records, rule))
        return F.when(records.isNull(), 0).otherwise(broken).cast("long")

    return documents.withColumns(
        {
            "bad_pii_confidence": count(pii, _bad_confidence),
            "bad_pii_span": count(pii, _bad_span),
            "bad_pii_method": count(
                pii, lambda r: ~r["detection_method"].isin(*DETECTION_METHODS)
            ),
            "bad_section_confidence": count(cut, _bad_confidence),
            "bad_section_span": count(cut, _bad_span),
            "bad_section_preview": count(
                cut, lambda r: F.length(r["content_preview"]) > MAX_PREVIEW
            ),
        }
    )


RULES = (
    "bad_pii_confidence",
    "bad_pii_span",
    "bad_pii_method",
    "bad_section_confidence",
    "bad_section_span",
    "bad_section_preview",
)


def valid_documents(checked: DataFrame) -> DataFrame:
    """Documents that break no rule."""
    return checked.filter(reduce(lambda a, b: a & b, (F.col(r) == 0 for r in RULES))).drop(*RULES)
