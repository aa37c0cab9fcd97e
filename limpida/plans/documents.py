"""The cleaning job: messages in, documents out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limpida.functions import body, headers as hd, html, mime, pii
from limpida.functions.patterns import PERSONAL_HEADERS
from limpida.functions.spans import once
from limpida.operators import canonical, names as nm, validate
from limpida.operators.names import Finder
from limpida.options import CleaningOptions, PiiMode

UNKNOWN_SENDER = "[PII_EMAIL]"  # fixed value
NO_BODY = "[BODY UNAVAILABLE]"  # fixed value
ERROR_MARK = "[ERROR]"  # fixed value


#: Stands in for a header field in which names could not be looked for.
WITHHELD = "[PII_UNCHECKED]"
NAMES_FAILED = "pii: name detection failed"
HTML_FAILED = "parse: html"
#: How errors of failed stages begin; their rows are withheld.
STAGES = ("pii:", "parse:")


def with_bodies(messages: DataFrame) -> DataFrame:
    """Add ``plain_body``, ``html_body``, ``body_source`` and ``parse_error``.

    Raw bytes win over the given bodies; ``parsed`` holds their parts where the reader has split
    them already. Parts are read inside the row, so choosing and
    joining them needs neither a join nor a shuffle.
    """
    columns = messages.columns
    plain = F.coalesce(F.col("body_text"), F.lit(""))
    markup = F.coalesce(F.col("body_html"), F.lit("")) if "body_html" in columns else F.lit("")
    given = F.lit("given")
    if "body_truncated" in columns:
        given = F.when(F.col("body_truncated"), "truncated").otherwise("given")
    if "raw_bytes" not in columns and "parsed" not in columns:
        return messages.withColumns(
            {"plain_body": plain, "html_body": markup, "body_source": given, "parse_error": F.lit(None).cast("string")}
        )
    parsed, status = F.col("parsed"), F.col("parsed.status")
    if "parsed" not in columns:
        messages = messages.withColumn("parsed", mime.parse_message(F.col("raw_bytes")))
    return (
        messages.withColumns(
            {
                "plain_body": F.when(
                    status == "ok", mime.body_of(parsed["parts"], "text/plain")
                ).otherwise(plain),
                "html_body": F.when(status == "ok", mime.body_of(parsed["parts"], "text/html"))
                .when(status == "failed", "")
                .otherwise(markup),
                "body_source": F.when(status == "ok", "raw")
                .when(status == "failed", "fallback")
                .otherwise(given),
                "parse_error": F.when(status == "failed", F.coalesce(parsed["error"], F.lit("parse: failed"))),
            }
        )
        .drop("parsed")
    )


def with_merged_body(messages: DataFrame) -> DataFrame:
    """Add ``merged_body`` from ``plain_body`` and ``html_body``.

    Where the HTML cannot be read ``parse_error`` says so, ``body_source`` is 'fallback' and the plain body is all there is.
    """
    df = messages.withColumn("__html_text", F.lit(""))
    if "body_html" in messages.columns or "raw_bytes" in messages.columns:
        df = html.with_html_text(messages, "html_body", "__html_text")
        df = df.withColumn("__unread", once(F.isnull("__html_text"))).withColumns(
            {
                "parse_error": F.coalesce("parse_error", F.when(F.col("__unread"), F.lit(HTML_FAILED))),
                "body_source": F.when(F.col("__unread"), "fallback").otherwise(F.col("body_source")),
            }
        ).drop("__unread")
    return df.withColumn(
        "merged_body", body.merge_bodies(F.col("plain_body"), F.col("__html_text"))
    ).drop("__html_text", "plain_body", "html_body")


def with_redacted_headers(
    messages: DataFrame, options: CleaningOptions, out: str, finder: Finder | DataFrame | None = None
) -> DataFrame:
    """Redact the personal header fields; in the other modes headers pass unchanged.

    A field that the finder fails on is withheld, and ``<out>_failed`` is true for its row.
    """
    if options.pii_mode is not PiiMode.REDACT:
        return messages.withColumn(out, F.col("headers"))
    if finder is None:
        return messages.withColumn(out, pii.redact_headers("headers", options))
    values = header_values()
    found = {f"{c}_found": c for c in values}
    return _with_headers_of(nm.with_found(messages.withColumns(values), found, finder), options, out)


def header_values() -> dict[str, Column]:
    """Columns of the personal header fields: a finder may be a Python stage, which no lambda can hold."""
    return {
        f"__header_{name}": F.try_element_at(F.col("headers"), F.lit(name))
        for name in PERSONAL_HEADERS
    }


def _with_headers_of(messages: DataFrame, options: CleaningOptions, out: str) -> DataFrame:
    """The redacted headers, where ``header_values`` and what was found in them are columns."""
    values = header_values()
    found = [f"{c}_found" for c in values]
    hits = {
        f"{c}_hits": pii.detect(f"`{c}`", options, f"`{c}_found`")
        for c in values
    }

    def value(key: Column, old: Column) -> Column:
        new = F
        for name in PERSONAL_HEADERS:
            column = f"__header_{name}"
            failed = F.col(f"`{column}_found`").isNull()
            redacted = pii.redact(f"`{column}`", f"`{column}_hits`")
            new = new.when(key == name, F.when(failed, F.lit(WITHHELD)).otherwise(redacted))
        return F.coalesce(new.otherwise(old), old)

    return (
        messages.withColumns(hits)
        .withColumn(out, F.transform_values(F.col("headers"), value))
        .withColumn(f"{out}_failed", _any(*(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}_found`").isNull() for c in values)))
        .drop(*values, *found, *hits)
    )


def _any(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _version(options: CleaningOptions) -> Column:
    names = (
        "parser_version",
        "canonicalization_version",
        "ner_model_version",
        "pii_redaction_version",
    )
    return F.struct(*(F.lit(getattr(options.version, n)).alias(n) for n in names))


def _level() -> Column:
    """How far a message gets: the first stage that failed decides."""
    no_body = F.coalesce(F.col("body_text"), F.lit("")) == ""
    return (
        F.when(no_body & (F.col("merged_body") == ""), "minimal")
        .when(~F.is_valid_utf8("merged_body"), "no_canon")
        .when(F.col("ner_status") == "failed", "regex_only")
        .otherwise("full")
    )


def build_documents(
    messages: DataFrame,
    options: CleaningOptions,
    finder: Finder | DataFrame | None = None,
    safe: bool = False,
) -> DataFrame:
    """Clean every message. Rows stay rows: no shuffle, and nothing is lost.

    ``finder`` looks for names: a function of a text column, or a dictionary table ``(name, label)``
    of any size, which is joined (the only case with a shuffle).

    Messages that fail validation become error documents (``status`` = 'rejected') and skip the other
    stages; those whose raw bytes or HTML cannot be parsed, or on which the finder fails in the body or a
    header, are withheld ('quarantined'). ``pii_status`` is 'failed' where names could not be looked
    for, 'off' where the mode says so, else 'ok'. With ``safe``, messages that lose a stage are kept at
    a lower ``processing_level`` instead: without names, without canonical text, or with no body at
    all. Every level redacts. A column ``ordinal`` (``order.with_ordinal``) is handed through.
    """
    if safe:
        df = messages.withColumn("reject_reason", F.lit(None).cast("string"))
    else:
        df = _without_rejected_input(validate.with_reject_reason(messages))
    df = with_merged_body(with_bodies(df))
    df = canonical.canonicalize(
        df,
        "merged_body",
        "__canonical",
        "__sections",
        options.active_removal_patterns(),
        options if options.pii_mode is PiiMode.REDACT else None,
    )
    names, df = _with_names(df, options, finder)
    df = _with_level(df) if safe else df.withColumn("processing_level", F.lit("full"))
    df = _with_redacted_body(df, options, names)
    if names and options.pii_mode is PiiMode.REDACT:
        df = _with_headers_of(df, options, "__headers")
    else:
        df = with_redacted_headers(df, options, "__headers")
    failed = F.col("ner_status") == "failed"
    if "__headers_failed" in df.columns:
        failed = failed | F.col("__headers_failed")
    status = F.when(F.lit(options.pii_mode is PiiMode.DISABLED), "off").when(failed, "failed").otherwise("ok")
    df = df.withColumn("pii_status", status)
    if not safe:
        reason = F.when(F.col("pii_status") == "failed", F.lit(NAMES_FAILED))
        df = df.withColumn("reject_reason", F.coalesce("reject_reason", "parse_error", reason))
    return _assemble(df, options)


def _without_rejected_input(df: DataFrame) -> DataFrame:
    """Rejected messages have nothing for the later stages to work on."""
    inputs = [c for c in ("body_text", "body_html", "raw_bytes", "parsed", "headers") if c in df.columns]
    return df.withColumns({c: F.when(F.col("reject_reason").isNull(), F.col(c)) for c in inputs})


def _with_names(
    df: DataFrame, options: CleaningOptions, finder: Finder | DataFrame | None
) -> tuple[str | None, DataFrame]:
    """Add what is found in the body and, where they are redacted, in the header fields."""
    if finder is None or options.pii_mode is PiiMode.DISABLED:
        return None, df.withColumn("ner_status", F.lit("off"))
    texts = {"__found": "__canonical"}
    if options.pii_mode is PiiMode.REDACT:
        df = df.withColumns(header_values())
        texts |= {f"{c}_found": c for c in header_values()}
    df = nm.with_found(df, texts, finder)
    return "__found", df.withColumn(
        "ner_status", F.when(F.col("__found").isNull(), "failed").otherwise("ok")
    )


def _with_level(df: DataFrame) -> DataFrame:
    """Choose the level, and with it the text that is searched for personal data."""
    df = df.withColumn("processing_level", _level())
    full, minimal = F.col("processing_level") == "full", F.col("processing_level") == "minimal"
    # A message that came raw has its body only there.
    given = F.coalesce(F.when(F.col("body_text") != "", F.col("body_text")), F.col("merged_body"), F.lit(""))
    return df.withColumns(
        {
            "__canonical": F.when(full, F.col("__canonical"))
            .when(minimal, NO_BODY)
            .otherwise(given),
            "__sections": F.when(full, F.col("__sections")).otherwise(
                F.slice("__sections", 1, 0)
            ),
        }
    )


def _with_redacted_body(df: DataFrame, options: CleaningOptions, names: str | None) -> DataFrame:
    if options.pii_mode is PiiMode.DISABLED:
        return df.withColumns({"__body": F.col("__canonical"), "__hits": pii.no_hits()})
    found = None
    if names:
        found = f"CASE WHEN processing_level = 'full' THEN {names} END"
    df = pii.with_hits(df, "__canonical", options, "__hits", found)
    if options.pii_mode is PiiMode.DETECT_ONLY:
        return df.withColumn("__body", F.col("__canonical"))
    return df.withColumn("__body", pii.redact("__canonical", "__hits"))


def _assemble(df: DataFrame, options: CleaningOptions) -> DataFrame:
    fields = F.col("__headers")
    good = F.col("reject_reason").isNull()
    minimal = F.col("processing_level") == "minimal"
    reason = F.col("reject_reason")

    def given(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    def or_error(value: Column, error: Column) -> Column:
        return F.when(good, value).otherwise(error)

    no_headers = F.map_from_arrays(
        F.array(F.lit("from"), F.lit("subject")), F.array(F.lit("unknown"), F.lit("unknown"))
    )
    kept_headers = F.when(minimal & (F.coalesce(F.size(fields), F.lit(0)) <= 0), no_headers).otherwise(
        fields
    )
    sections = F.when(
        good,
        F.transform(
            F.col("__sections"),
            lambda s: F.struct(
                *(s[n].alias(n) for n in ("type", "span_start", "span_end", "content_preview", "confidence"))
            ),
        ),
    ).otherwise(
        F.array().cast(
            "array<struct<type:string,span_start:int,span_end:int,content_preview:string,"
            "confidence:double>>"
        )
    )
    df = df.withColumns(
        {
            "__headers": kept_headers,
            "__body": once(
                or_error(
                    F.col("__body"), F.concat(F.lit("[PREPROCESSING ERROR: "), reason, F.lit("]"))
                )
            ),
            "__hits": or_error(F.col("__hits"), pii.no_hits()),
        }
    )
    default_from = F.when(minimal, "unknown").otherwise(UNKNOWN_SENDER)
    default_subject = F.when(minimal, "unknown").otherwise("")
    empty = F.array().cast("array<string>")
    return df.select(
        *(given(c).alias(c) for c in ("uid", "uidvalidity", "mailbox", "message_id", "fetched_at")),
        given("size").cast("long").alias("size"),
        or_error(
            F.coalesce(F.try_element_at(fields, F.lit("from")), default_from), F.lit(ERROR_MARK)
        ).alias("from_addr_redacted"),
        or_error(hd.split_addresses(hd.header(fields, "to")), empty).alias("to_addrs_redacted"),
        or_error(
            F.coalesce(F.try_element_at(fields, F.lit("subject")), default_subject),
            F.lit(ERROR_MARK),
        ).alias("subject_canonical"),
        or_error(hd.header(fields, "date"), F.lit("")).alias("date_parsed"),
        or_error(
            fields, F.map_from_arrays(F.array(F.lit("preprocessing-error")), F.array(reason))
        ).alias("headers_canonical"),
        F.col("__body").alias("body_text_canonical"),
        F.lit("").alias("body_html_canonical"),
        or_error(F.sha2(F.col("__body"), 256), F.lit("")).alias("body_original_hash"),
        sections.alias("removed_sections"),
        pii.entities("__hits", options).alias("pii_entities"),
        _version(options).alias("pipeline_version"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias(
            "processing_timestamp"
        ),
        F.when(good, "ok")
        .when(_any(*(reason.startswith(s) for s in STAGES)), "quarantined")
        .otherwise("rejected")
        .alias("status"),
        reason.alias("error"),
        "pii_status",
        "processing_level",
        "body_source",
        F.sha2(F.col("merged_body"), 256).alias("merged_body_hash"),
        F.try_to_timestamp(given("fetched_at")).alias("fetched_ts"),
        *(["ordinal"] if "ordinal" in df.columns else []),
    )


def good_documents(documents: DataFrame) -> DataFrame:
    return documents.filter(F.col("status") == "ok")


def quarantine(documents: DataFrame) -> DataFrame:
    """Rows for manual review, with the class of their error."""
    return documents.filter(F.col("status") != "ok").withColumns(
        {
            "severity": validate.severity(F.col("error")),
            "retry": validate.may_retry(F.col("error"), F.lit(1)),
        }
    )
