"""Mail tables derived from the ``documents`` table.

Every expression is SQL that Spark and other engines read alike, so a check in another
engine can start from the very same rows. All documents take part with their whole
texts; the remainder of ``doc_id`` only says which mail construct is put around a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limpida.functions.headers import split_addresses
from limpida.session import spread

NL = "chr(10)"

BODY_TEXT = f"""CASE CAST(doc_id % 8 AS INT)
  WHEN 0 THEN text
  WHEN 1 THEN 'Risposta' || {NL} || '> riga uno' || {NL} || '>> riga due' || {NL} || text
  WHEN 2 THEN text || {NL} || 'Il giorno 17 feb 2026 user@example.com ha scritto:' || {NL} || '> vecchio testo'
  WHEN 3 THEN 'Da: a@example.com' || {NL} || 'Oggetto: prova' || {NL} || text
  WHEN 4 THEN text || {NL} || 'Cordiali saluti,' || {NL} || '--' || {NL} || 'Mario'
  WHEN 5 THEN text || {NL} || 'CF: RSSMRA85M' || lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0') || 'H501Z'
       || {NL} || 'P.IVA: IT' || lpad(CAST(doc_id AS STRING), 11, '1')
       || {NL} || 'IBAN: IT60X' || lpad(CAST(doc_id AS STRING), 10, '0') || '000000123456'
       || {NL} || 'Tel: +39 333 ' || lpad(CAST(doc_id AS STRING), 7, '1')
       || {NL} || 'Fattura n. ' || lpad(CAST(doc_id AS STRING), 11, '2')
  WHEN 6 THEN text || {NL} || 'Questo messaggio puo contenere informazioni riservate e confidenziale.'
  ELSE 'a' || chr(13) || {NL} || 'b    c   ' || {NL} || {NL} || {NL} || {NL} || text
END"""

# Constructs that the bodies above lack, one per remainder.
MARKS = f"""CASE CAST(doc_id % 8 AS INT)
  WHEN 0 THEN 'On Mon, 1 Jan 2026 user' || CAST(doc_id AS STRING) || ' wrote:' || {NL} || text
  WHEN 1 THEN text || {NL} || '__________' || {NL} || 'ufficio'
  WHEN 2 THEN text || {NL} || 'Informativa privacy ai sensi del regolamento GDPR'
  WHEN 3 THEN text || {NL} || 'P. Rispetta l' || chr(39) || 'ambiente: non stampare questo messaggio'
  WHEN 4 THEN text || {NL} || 'Distinti saluti, ' || {NL} || 'Anna'
  WHEN 5 THEN 'intro' || {NL} || '---------- Forwarded message ----------' || {NL} || text
  WHEN 6 THEN 'intro' || {NL} || '----- Messaggio inoltrato -----' || {NL} || text
  ELSE 'RIF. 12 e Ordine num. ' || lpad(CAST(doc_id AS STRING), 11, '3') || {NL} || text
END"""

BODY_HTML = f"""CASE CAST(doc_id % 5 AS INT)
  WHEN 0 THEN '<div><p>' || replace(text, {NL}, '</p><p>') || '</p></div>'
  WHEN 1 THEN '<p>voce uno due tre quattro cinque sei sette otto nove dieci &amp; <a href="https://example.com/'
       || CAST(doc_id AS STRING) || '">pagina</a></p><p>' || replace(text, ' ', 'x ') || '</p>'
  ELSE ''
END"""

MESSAGE_ID = "'<' || CAST(doc_id AS STRING) || '@' || source || '>'"
SUBJECT = """'RE: Fw: ' || CASE WHEN doc_id % 2 = 0 THEN 'I: ' ELSE '' END
  || upper(source) || ' n. ' || CAST(doc_id AS STRING)"""
FROM_ADDR = "'user' || CAST(doc_id % 97 AS STRING) || '@' || source || '.example.com'"
TO_HEADER = "'Anna <anna' || CAST(doc_id % 13 AS STRING) || '@example.org>, ufficio@example.com'"
FETCHED_AT = """'2026-02-' || lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0') || 'T'
  || lpad(CAST(doc_id % 24 AS STRING), 2, '0') || ':' || lpad(CAST(doc_id % 60 AS STRING), 2, '0') || ':00Z'"""

COLUMNS = {
    "doc_id": "doc_id",
    "message_id": MESSAGE_ID,
    "subject": SUBJECT,
    "from_addr": FROM_ADDR,
    "to_header": TO_HEADER,
    "fetched_at": FETCHED_AT,
    "body_text": BODY_TEXT,
    "marked_text": MARKS,
    "body_html": BODY_HTML,
}


def sql(*columns: str) -> str:
    """SELECT of the given mail columns over ``documents``."""
    chosen = columns or tuple(COLUMNS)
    return "SELECT " + ", ".join(f"{COLUMNS[c]} AS {c}" for c in chosen) + " FROM documents"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of files.

    The last letter stands in brackets: only of a path with a wildcard do streams read a single file.
    """
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def mail(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The derived mail columns; those not asked for are never computed."""
    chosen = columns or tuple(COLUMNS)
    return table(spark, sf_dir, "documents").selectExpr(*(f"{COLUMNS[c]} AS {c}" for c in chosen))


def messages(spark: SparkSession, sf_dir: str, text: str = "body_text") -> DataFrame:
    """The derived mail as a ``messages`` table (without raw bytes)."""
    return messages_of(table(spark, sf_dir, "documents"), text)


def messages_of(documents: DataFrame, text: str = "body_text") -> DataFrame:
    """The same for a ``documents`` table or stream at hand."""
    rows = documents.selectExpr(*(f"{e} AS {c}" for c, e in COLUMNS.items()))
    return rows.select(
        "doc_id",
        F.col("doc_id").cast("string").alias("uid"),
        F.lit("1").alias("uidvalidity"),
        F.lit("INBOX").alias("mailbox"),
        "from_addr",
        split_addresses(F.col("to_header")).alias("to_addrs"),
        "subject",
        F.lit("Tue, 17 Feb 2026 10:00:00 +0000").alias("date"),
        F.col(text).alias("body_text"),
        "body_html",
        F.length(text).cast("long").alias("size"),
        F.map_from_arrays(
            F.array(*(F.lit(k) for k in ("from", "to", "subject", "date", "x-mailer"))),
            F.array(
                F.col("from_addr"),
                F.col("to_header"),
                F.col("subject"),
                F.lit("Tue, 17 Feb 2026 10:00:00 +0000"),
                F.lit("limpida"),
            ),
        ).alias("headers"),
        "message_id",
        "fetched_at",
        F.lit(False).alias("body_truncated"),
    )
