"""Personal data: detection, merge, redaction, pseudonyms.

``text`` and ``hits`` arguments are SQL expressions, most often column names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limpida.functions import spans
from limpida.functions.dialect import (
    GAP_STAND_IN,
    MARKS_AND_JOINERS,
    NUMBERS_NO_DIGITS,
    WORD_STAND_IN,
)
from limpida.functions.patterns import PERSONAL_HEADERS, PII_PATTERNS, TITLES, PiiPattern
from limpida.functions.spans import quote
from limpida.options import CleaningOptions, PiiMode

# Field order makes the natural order of hits the merge order: by start, then regex
# before names, then the order of the pattern table.
HIT_TYPE = (
    "struct<span_start:int,rank:int,span_end:int,type:string,value:string,"
    "confidence:double,method:string>"
)
NO_HITS = f"CAST(array() AS array<{HIT_TYPE}>)"
NAME_RANK = 1000

# Confidence of a name by its length, and the shortest name.
NAME_CONFIDENCE_BASE, NAME_CONFIDENCE_STEP, NAME_CONFIDENCE_TOP = 0.7, 0.01, 0.9
MIN_NAME_LENGTH = 3

_MARKER = "concat('[PII_', {0}.type, ']')"


def pseudonym_sql(value: str, salt: str) -> str:
    """Keyed 16-digit pseudonym. The salt is part of the plan, never of a table."""
    return f"left(sha2(concat({value}, {quote(salt)}), 256), 16)"


def pseudonym(value: str, salt: str) -> Column:
    return F.expr(pseudonym_sql(value, salt))


def no_hits() -> Column:
    return F.expr(NO_HITS)


def _pattern_hits(text: str, pattern: PiiPattern, rank: int) -> str:
    """Hits of one pattern; texts that fail its gate cost one cheap scan."""
    gate = f"contains({text}, '@')" if pattern.gate == "@" else f"{text} RLIKE {quote(pattern.gate)}"
    return f"""CASE WHEN {gate} THEN transform({spans.match_spans(text, pattern.java)}, pat_m ->
        named_struct('span_start', pat_m.span_start, 'rank', {rank}, 'span_end', pat_m.span_end,
            'type', {quote(pattern.type)}, 'value', pat_m.value,
            'confidence', 1.0D, 'method', 'regex')) ELSE {NO_HITS} END"""


def _suspicious(text: str, options: CleaningOptions) -> str:
    """One cheap scan that most texts fail: an at sign or some digits in a row."""
    if options.pii_patterns is not PII_PATTERNS:
        return "true"
    return (
        f"(contains({text}, '@') OR {text} RLIKE '[0-9]{{3}}' OR (octet_length({text}) > "
        f"length({text}) AND {text} RLIKE '\\\\p{{Nd}}{{10}}'))"
    )


def fit_boundaries(text: str) -> str:
    """The text with stand-ins for characters whose place at a word boundary Java sees
    differently. Lengths stay, so spans stay; almost every text passes unchanged."""
    odd = quote(f"{NUMBERS_NO_DIGITS}|{MARKS_AND_JOINERS}")
    words = f"regexp_replace({text}, {quote(NUMBERS_NO_DIGITS)}, {quote(WORD_STAND_IN)})"
    fitted = f"regexp_replace({words}, {quote(MARKS_AND_JOINERS)}, {quote(GAP_STAND_IN)})"
    plain = f"octet_length({text}) = length({text}) OR NOT {text} RLIKE {odd}"
    return f"CASE WHEN {plain} THEN {text} ELSE {fitted} END"


def _original_values(hits: str, text: str) -> str:
    """Hits with their values cut from ``text`` again."""
    value = spans.piece("org_wide", "org.span_start", "org.span_end - org.span_start")
    cut = f"""transform({hits}, org -> named_struct('span_start', org.span_start, 'rank', org.rank,
        'span_end', org.span_end, 'type', org.type,
        'value', {value},
        'confidence', org.confidence, 'method', org.method))"""
    return spans.bind("org_wide", spans.wide(text), cut)


def regex_hits_sql(text: str, options: CleaningOptions) -> str:
    """Hits of all patterns less those on business numbers, not yet merged."""
    if not options.pii_patterns:
        return NO_HITS
    lists = (_pattern_hits("fit", p, r) for r, p in enumerate(options.pii_patterns))
    hits = "concat({})".format(", ".join(lists))
    if options.allow_patterns:
        allowed = ", ".join(spans.match_spans("fit", p.java) for p in options.allow_patterns)
        kept = spans.bind("alw", f"concat({allowed})", spans.without_overlap("rgx", "alw", HIT_TYPE))
        hits = spans.bind("rgx", hits, f"CASE WHEN size(rgx) = 0 THEN rgx ELSE {kept} END")
    restored = spans.bind(
        "fnd_all",
        hits,
        f"CASE WHEN fit = {text} OR size(fnd_all) = 0 THEN fnd_all"
        f" ELSE {_original_values('fnd_all', text)} END",
    )
    found = spans.bind("fit", fit_boundaries(text), restored)
    return f"CASE WHEN {_suspicious(text, options)} THEN {found} ELSE {NO_HITS} END"


def name_hits_sql(found: str, options: CleaningOptions) -> str:
    """Apply the rules for names to raw findings (see ``operators.names``)."""
    titles = ", ".join(quote(t) for t in TITLES)
    return f"""coalesce(filter(transform(
        filter({found}, nam_e -> nam_e.label IN ('PERSON', 'PER', 'NAME', 'ORG')
            AND length(nam_e.value) >= {MIN_NAME_LENGTH}
            AND lower(nam_e.value) NOT IN ({titles})),
        nam_e -> named_struct(
            'span_start', nam_e.span_start,
            'rank', CASE WHEN nam_e.label = 'ORG' THEN {NAME_RANK + 1} ELSE {NAME_RANK} END,
            'span_end', nam_e.span_end,
            'type', CASE WHEN nam_e.label = 'ORG' THEN 'ORG' ELSE 'NAME' END,
            'value', nam_e.value,
            'confidence', least({NAME_CONFIDENCE_TOP}D,
                {NAME_CONFIDENCE_BASE}D + length(nam_e.value) * {NAME_CONFIDENCE_STEP}D),
            'method', 'ner')),
        nam_h -> nam_h.confidence >= {options.effective_threshold}D), {NO_HITS})"""


def detect_sql(text: str, options: CleaningOptions, names: str | None = None) -> str:
    raw = regex_hits_sql(text, options)
    if names is not None:
        raw = f"concat({raw}, {names})"
    return spans.bind("det", raw, spans.merge_overlaps("det", HIT_TYPE))


def detect(text: str, options: CleaningOptions, names: str | None = None) -> Column:
    """Merged hits of a text, sorted by start. ``names`` are findings to merge in."""
    found = None if names is None else name_hits_sql(names, options)
    return F.expr(detect_sql(text, options, found))


def with_hits(
    df: DataFrame, text: str, options: CleaningOptions, out: str, names: str | None = None
) -> DataFrame:
    """Add the merged hits of a text column; filters on them do not repeat the search."""
    return df.withColumn(out, spans.once(detect(text, options, names)))


def redact_sql(text: str, hits: str) -> str:
    return spans.replace_spans(text, hits, _MARKER.format("rep_h"))


def redact(text: str, hits: str) -> Column:
    return F.expr(redact_sql(text, hits))


def redact_text_sql(text: str, options: CleaningOptions) -> str:
    """Text with all regex hits replaced, for short fields such as headers and previews."""
    return spans.bind("red", detect_sql(text, options), redact_sql(text, "red"))


def redact_text(text: str, options: CleaningOptions) -> Column:
    return F.expr(redact_text_sql(text, options))


def entities(hits: str, options: CleaningOptions) -> Column:
    """Audit records. In detect-only mode ``redacted`` holds the value itself."""
    detect_only = options.pii_mode is PiiMode.DETECT_ONLY
    return F.expr(
        f"""transform({hits}, ent_h -> named_struct(
            'type', ent_h.type,
            'original_hash', {pseudonym_sql("ent_h.value", options.pii_salt)},
            'redacted', {"ent_h.value" if detect_only else _MARKER.format("ent_h")},
            'span_start', ent_h.span_start, 'span_end', ent_h.span_end,
            'confidence', ent_h.confidence, 'detection_method', ent_h.method))"""
    )


def redact_headers(headers: str, options: CleaningOptions) -> Column:
    """Redact the values of the personal header fields; others pass unchanged."""
    names = ", ".join(quote(n) for n in PERSONAL_HEADERS)
    return F.expr(
        f"""transform_values({headers}, (hdr_k, hdr_v) -> CASE WHEN hdr_k IN ({names})
            THEN {redact_text_sql("hdr_v", options)} ELSE hdr_v END)"""
    )
