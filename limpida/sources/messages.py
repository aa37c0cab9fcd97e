"""Readers: message files, ingestion JSON and request tables to the ``messages`` schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from limpida import schemas
from limpida.functions import headers as hd
from limpida.functions import mime

# What stands in for a missing field, and the cuts made upstream.
DEFAULT_MAILBOX = "INBOX"
DEFAULT_ADDRESS = "unknown@unknown.com"
DEFAULT_SUBJECT = "(no subject)"
DEFAULT_MESSAGE_ID = "<unknown>"
TEXT_CUT, HTML_CUT = 2000, 500


def read_message_files(spark: SparkSession, path: str, glob: str = "*.eml") -> DataFrame:
    """Messages from a folder of raw message files."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    return files_to_messages(files)


def files_to_messages(files: DataFrame) -> DataFrame:
    """Messages from ``(path, modificationTime, length, content)``, Spark's binary files.

    Parts stay in the row as ``parsed``, so that the cleaning job does not read the bytes again.
    """
    parts = F.col("__parsed.parts")
    plain = F.filter(parts, lambda p: p["content_type"] == "text/plain")
    whole = F.when(F.size(parts) == 1, parts).otherwise(plain)
    fields = F.col("__headers")
    return (
        hd.with_header_map(files, hd.header_block(F.col("content")), "__headers")
        .withColumn("__parsed", mime.parse_message(F.col("content")))
        .select(
            F.col("path").alias("uid"),
            F.lit("0").alias("uidvalidity"),
            F.lit("FILES").alias("mailbox"),
            hd.header(fields, "from", DEFAULT_ADDRESS).alias("from_addr"),
            hd.split_addresses(hd.header(fields, "to")).alias("to_addrs"),
            hd.header(fields, "subject", DEFAULT_SUBJECT).alias("subject"),
            hd.header(fields, "date").alias("date"),
            F.coalesce(F.get(whole, F.lit(0))["content"], F.lit("")).alias("body_text"),
            F.lit("").alias("body_html"),
            F.col("length").alias("size"),
            fields.alias("headers"),
            hd.header(fields, "message-id", DEFAULT_MESSAGE_ID).alias("message_id"),
            F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("fetched_at"),
            F.col("content").alias("raw_bytes"),
            F.lit(False).alias("body_truncated"),
            F.col("__parsed").alias("parsed"),
        )
    )


def read_ingestion(spark: SparkSession, path: str) -> DataFrame:
    """Messages from newline JSON; the schema is given, so no pass to infer it."""
    return ingestion_to_messages(spark.read.schema(schemas.INGESTION).json(path))


def _recipients(to: Column) -> Column:
    listed = F.from_json(to, "array<string>")
    given = F.when(F.ltrim(to).startswith("["), listed).otherwise(hd.split_addresses(to))
    return F.coalesce(given, F.array().cast("array<string>"))


def _lower_keys(headers: Column) -> Column:
    """Lower-case keys; of keys that become equal the last one wins."""
    entries = F.transform(
        F.map_entries(headers),
        lambda e: F.struct(F.lower(e["key"]).alias("name"), e["value"].alias("value")),
    )
    return F.coalesce(
        hd.fields_to_map(entries, duplicates="last"), F.create_map().cast("map<string,string>")
    )


def ingestion_to_messages(raw: DataFrame) -> DataFrame:
    """Rename, fill in and normalise ingestion rows."""
    text = F.coalesce("body_text", F.lit(""))
    markup = F.coalesce("body_html_preview", F.lit(""))
    return raw.select(
        F.coalesce(F.col("uid").cast("string"), F.lit("0")).alias("uid"),
        F.coalesce(F.col("uidvalidity").cast("string"), F.lit("0")).alias("uidvalidity"),
        F.coalesce("mailbox", F.lit(DEFAULT_MAILBOX)).alias("mailbox"),
        F.coalesce("from", F.lit(DEFAULT_ADDRESS)).alias("from_addr"),
        _recipients(F.col("to")).alias("to_addrs"),
        F.coalesce("subject", F.lit(DEFAULT_SUBJECT)).alias("subject"),
        F.coalesce("date", F.lit("")).alias("date"),
        text.alias("body_text"),
        markup.alias("body_html"),
        F.coalesce("size", F.lit(0)).cast("long").alias("size"),
        _lower_keys(F.col("headers")).alias("headers"),
        F.coalesce("message_id", F.lit("")).alias("message_id"),
        F.coalesce("fetched_at", F.lit("")).alias("fetched_at"),
        F.lit(None).cast("binary").alias("raw_bytes"),
        ((F.length(text) >= TEXT_CUT) | (F.length(markup) >= HTML_CUT)).alias("body_truncated"),
    )


def requests_to_messages(requests: DataFrame) -> DataFrame:
    """Messages from header text, body text and a base64 copy of the raw message.

    Of repeated header names the last wins. Characters outside the base64 alphabet are
    ignored; what still cannot be decoded gives no raw bytes.
    """
    fields = F.col("__headers")
    to = hd.split_addresses(hd.header(fields, "to"))
    alphabet_only = F.regexp_replace("raw_bytes", "[^A-Za-z0-9+/=]", "")
    no_headers = F.create_map().cast("map<string,string>")
    df = hd.with_header_map(requests, F.col("headers_raw"), "__headers", "last")
    return df.withColumn("__headers", F.coalesce("__headers", no_headers)).select(
        F.lit("api-request").alias("uid"),
        F.lit("1").alias("uidvalidity"),
        F.lit("API").alias("mailbox"),
        hd.header(fields, "from", DEFAULT_ADDRESS).alias("from_addr"),
        F.when(F.size(to) > 0, to).otherwise(F.array(F.lit(DEFAULT_ADDRESS))).alias("to_addrs"),
        hd.header(fields, "subject", DEFAULT_SUBJECT).alias("subject"),
        hd.header(fields, "date").alias("date"),
        "body_text",
        F.lit("").alias("body_html"),
        F.length("body_text").cast("long").alias("size"),
        fields.alias("headers"),
        "message_id",
        F.lit("").alias("fetched_at"),
        F.try_to_binary(alphabet_only, F.lit("base64")).alias("raw_bytes"),
        F.lit(False).alias("body_truncated"),
    )
