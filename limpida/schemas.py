"""Schemas of the tables."""

from __future__ import annotations

from pyspark.sql import types as T

MESSAGES = T.StructType(
    [
        T.StructField("uid", T.StringType()),
        T.StructField("uidvalidity", T.StringType()),
        T.StructField("mailbox", T.StringType()),
        T.StructField("from_addr", T.StringType()),
        T.StructField("to_addrs", T.ArrayType(T.StringType())),
        T.StructField("subject", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("body_text", T.StringType()),
        T.StructField("body_html", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("message_id", T.StringType()),
        T.StructField("fetched_at", T.StringType()),
        T.StructField("raw_bytes", T.BinaryType()),
        T.StructField("body_truncated", T.BooleanType()),
    ]
)

# Newline JSON as ingestion delivers it. ``to`` is a string or an array; read as a string,
# an array arrives as its JSON text.
INGESTION = T.StructType(
    [
        T.StructField("uid", T.LongType()),
        T.StructField("uidvalidity", T.LongType()),
        T.StructField("mailbox", T.StringType()),
        T.StructField("from", T.StringType()),
        T.StructField("to", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("body_text", T.StringType()),
        T.StructField("body_html_preview", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("message_id", T.StringType()),
        T.StructField("fetched_at", T.StringType()),
    ]
)

REQUESTS = T.StructType(
    [
        T.StructField("message_id", T.StringType()),
        T.StructField("headers_raw", T.StringType()),
        T.StructField("body_text", T.StringType()),
        T.StructField("raw_bytes", T.StringType()),
    ]
)

DOCUMENT_COLUMNS = (
    "uid",
    "uidvalidity",
    "mailbox",
    "message_id",
    "fetched_at",
    "size",
    "from_addr_redacted",
    "to_addrs_redacted",
    "subject_canonical",
    "date_parsed",
    "headers_canonical",
    "body_text_canonical",
    "body_html_canonical",
    "body_original_hash",
    "removed_sections",
    "pii_entities",
    "pipeline_version",
    "processing_timestamp",
)
