"""Canonical text: a chain of projections, one pair per removal pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limpida.functions import pii, spans, text as tx
from limpida.functions.patterns import RemovalPattern
from limpida.functions.spans import quote
from limpida.options import CleaningOptions

_CUT_TYPE = (
    "array<struct<stage:int,type:string,span_start:int,span_end:int,value:string,"
    "confidence:double>>"
)
PREVIEW_LENGTH = 100  # fixed value

_TEXT, _CUTS, _LOWER = "__canon_text", "__canon_cuts", "__canon_lower"
_FOUND, _BETWEEN = "__canon_found", "__canon_between"


def normalize(df: DataFrame, text: str, out: str) -> DataFrame:
    """Line ends, canonical composition and plain spaces, in this order.

    One projection each: every step reads its text several times.
    """
    df = df.withColumn(out, tx.unix_line_ends(F.coalesce(F.col(text), F.lit(""))))
    return tx.with_nfc(df, out, out).withColumn(out, tx.plain_spaces(F.col(out)))


def _gate_name(number: int) -> str:
    return f"__canon_gate_{number}"


def _cuts(pattern: RemovalPattern, stage: int) -> Column:
    return F.expr(
        f"""transform({spans.locate(_FOUND, _BETWEEN)}, cut_m -> named_struct(
            'stage', {stage}, 'type', {quote(pattern.type)},
            'span_start', cut_m.span_start, 'span_end', cut_m.span_end,
            'value', cut_m.value, 'confidence', {pattern.confidence}D))"""
    )


def remove_sections(
    df: DataFrame, text: str, patterns: tuple[RemovalPattern, ...], cuts: str
) -> DataFrame:
    """Cut every pattern out of column ``text`` and record what was cut in ``cuts``.

    Each pattern sees the text the ones before it left, and its spans refer to that text;
    ``stage`` tells which. A removal puts a newline in, so no fragment of ``needs`` can
    come into being on the way, and all gates can be read off the first text.
    """
    df = df.withColumn(_LOWER, F.lower(F.col(text)))
    gates = {}
    for number, pattern in enumerate(patterns):
        gate = F.lit(True)
        for fragment in pattern.needs:
            gate = gate & F.contains(F.col(_LOWER), F.lit(fragment))
        gates[_gate_name(number)] = gate
    df = df.withColumns({**gates, cuts: F.array().cast(_CUT_TYPE)}).drop(_LOWER)

    for number, pattern in enumerate(patterns):
        gate, current = F.col(_gate_name(number)), F.col(text)
        df = df.withColumns(
            {
                _FOUND: F.when(gate, spans.matches(current, pattern.java)),
                _BETWEEN: F.when(gate, spans.gaps(current, pattern.java)),
            }
        )
        hit = gate & (F.size(_FOUND) > 0)
        df = df.withColumns(
            {
                text: F.when(hit, F.array_join(_BETWEEN, "\n")).otherwise(current),
                cuts: F.when(hit, F.concat(cuts, _cuts(pattern, number + 1))).otherwise(
                    F.col(cuts)
                ),
            }
        )
    return df.withColumn(cuts, spans.once(F.col(cuts))).drop(_FOUND, _BETWEEN, *gates)


def canonicalize(
    df: DataFrame,
    text: str,
    out_text: str,
    out_sections: str,
    patterns: tuple[RemovalPattern, ...],
    redact_previews: CleaningOptions | None = None,
) -> DataFrame:
    """Add the canonical form of column ``text`` and the array of removed sections.

    Sections are ``struct<stage,type,span_start,span_end,content_preview,confidence>``.
    With ``redact_previews``, a removed text is redacted before its preview is cut off,
    so that no personal data split by the cut stays in the audit trail.
    """
    value = "sec.value"
    if redact_previews is not None:
        value = pii.redact_text_sql(value, redact_previews)
    sections = F.expr(
        f"""transform({_CUTS}, sec -> named_struct('stage', sec.stage, 'type', sec.type,
            'span_start', sec.span_start, 'span_end', sec.span_end,
            'content_preview', left({value}, {PREVIEW_LENGTH}), 'confidence', sec.confidence))"""
    )
    df = remove_sections(normalize(df, text, _TEXT), _TEXT, patterns, _CUTS)
    return df.withColumns({out_text: tx.tidy(F.col(_TEXT)), out_sections: sections}).drop(
        _TEXT, _CUTS
    )


def sections_table(df: DataFrame, sections: str, *keys: str) -> DataFrame:
    """Audit table, one row per removed section."""
    return df.select(*keys, F.inline(F.col(sections)))
