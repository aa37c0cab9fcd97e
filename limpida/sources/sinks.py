"""Writers and output shapes of the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limpida.plans.documents import good_documents, quarantine


def response(documents: DataFrame) -> DataFrame:
    """The short shape of a cleaned message."""
    return documents.select(
        "message_id",
        F.col("headers_canonical").alias("headers"),
        F.col("body_text_canonical").alias("body_text"),
        F.col("body_original_hash").alias("body_hash"),
        F.size("pii_entities").cast("long").alias("pii_redactions_count"),
        F.size("removed_sections").cast("long").alias("removed_sections_count"),
        F.concat_ws("|", "pipeline_version.*").alias("pipeline_version"),
        F.lit(0.0).alias("processing_time_ms"),
    )


def with_ingest_date(documents: DataFrame) -> DataFrame:
    return documents.withColumn("ingest_date", F.to_date("fetched_ts"))


def write_documents(
    documents: DataFrame,
    path: str,
    mode: str = "errorifexists",
    fmt: str = "parquet",
    files_per_day: int | None = None,
) -> None:
    """Write good documents and the quarantine, partitioned by day of ingestion.

    All rows are written once, with the status as the outer partition: splitting the
    DataFrame in two writes would clean every message twice.

    Without ``files_per_day`` every task writes a file for each day it holds, and nothing is
    shuffled: right for input that comes by day. With it the rows are shuffled first, so that a
    day and status has at most that many files; choose its rows divided by those of a good file.
    """
    dated = with_ingest_date(documents)
    if files_per_day is not None:
        part = F.pmod(F.xxhash64("message_id", "uid"), F.lit(files_per_day))
        dated = dated.repartition("status", "ingest_date", part)
    (
        dated.write.mode(mode)
        .partitionBy("status", "ingest_date")
        .format(fmt)
        .save(path)
    )


def read_documents(spark, path: str, fmt: str = "parquet") -> DataFrame:
    return good_documents(spark.read.format(fmt).load(path))


def read_quarantine(spark, path: str, fmt: str = "parquet") -> DataFrame:
    return quarantine(spark.read.format(fmt).load(path))


def as_json(documents: DataFrame) -> DataFrame:
    """Each document as one nested JSON text."""
    return documents.select("message_id", F.to_json(F.struct("*")).alias("document"))
