"""Replay of quarantined messages: retry what may succeed, count attempts, keep one row per message.

The documents table is its own ledger: it is partitioned by status, day and attempt. A replay reads
the messages that are quarantined and may be retried, cleans them again, and writes their rows as one
more attempt. Rows of earlier attempts stay as history; readers see the last one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from limpida.operators import validate
from limpida.session import stored
from limpida.sources.sinks import with_ingest_date

#: What identifies a message; compared null-safe.
KEYS = ("mailbox", "uidvalidity", "uid", "message_id")
MAX_ATTEMPTS = 3


def write_attempt(documents: DataFrame, path: str, attempt: int = 1) -> None:
    """Write the documents of an attempt; writing an attempt again replaces its partitions."""
    dated = with_ingest_date(documents).withColumn("attempt", F.lit(attempt))
    (
        dated.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("status", "ingest_date", "attempt")
        .parquet(path)
    )


def _same(a: str, b: str) -> Column:
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in KEYS))


def read_attempts(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The last row of each message, of attempts below ``before`` where that is given.

    Good rows are final, so only the few others are looked up among those of later attempts. Where
    a broken replay left rows of both kinds in one attempt, the good one counts.
    """
    rows = spark.read.parquet(path)
    if before is not None:
        rows = rows.where(F.col("attempt") < before)
    good = F.col("status") == "ok"
    later = rows.where(F.col("attempt") > 1).select(*KEYS, "attempt", "status").alias("later")
    newer = (F.col("later.attempt") > F.col("old.attempt")) | (
        (F.col("later.attempt") == F.col("old.attempt")) & (F.col("later.status") == "ok")
    )
    waiting = rows.where(~good).alias("old").join(later, _same("old", "later") & newer, "left_anti")
    return rows.where(good).unionByName(waiting)


def due(spark: SparkSession, path: str, attempt: int, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Keys of messages that attempt number ``attempt`` should work on."""
    rows = read_attempts(spark, path, attempt).where("status <> 'ok'")
    return rows.where(validate.may_retry(F.col("error"), F.col("attempt"), max_attempts)).select(*KEYS)


def replay(
    messages: DataFrame,
    path: str,
    build: Callable[[DataFrame], DataFrame],
    attempt: int,
    max_attempts: int = MAX_ATTEMPTS,
) -> None:
    """Clean again, by ``build``, those of ``messages`` that are due, as attempt number ``attempt``.

    The keys are written first, so what is read does not change under the write. A replay that broke
    off is run again with the same number: it finds the same messages and replaces its partitions.
    """
    keys = stored(due(messages.sparkSession, path, attempt, max_attempts).distinct(), "due")
    again = messages.alias("m").join(keys.alias("k"), _same("m", "k"), "left_semi")
    write_attempt(build(again), path, attempt)
