"""Structured Streaming jobs.

The operators of the batch jobs serve here unchanged; what follows adds event time. The
windowed functions take batch and streaming tables alike and give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from limpida.operators.names import Finder
from limpida.options import CleaningOptions
from limpida.plans.documents import build_documents
from limpida.session import remove_scratch, scratch_folders
from limpida.sources.sinks import with_ingest_date


def clean_stream(
    messages: DataFrame,
    options: CleaningOptions,
    path: str,
    checkpoint: str,
    finder: Finder | None = None,
    **trigger,
) -> StreamingQuery:
    """Clean messages as they arrive; good documents and the quarantine are partitions of
    one table, so each message is cleaned once and each file is committed once."""
    documents = with_ingest_date(build_documents(messages, options, finder))
    return (
        documents.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .partitionBy("status", "ingest_date")
        .trigger(**(trigger or {"processingTime": "1 minute"}))
        .start(path)
    )


def write_names(dictionary: DataFrame, path: str, version: int) -> None:
    """Store a version of a name dictionary; versions are never changed, only added."""
    dictionary.select("name", "label").write.parquet(f"{path}/version={version}")


def _version_of(spark: SparkSession, dictionary_path: str, path: str, batch: int) -> int:
    """The dictionary version of a batch: the latest when the batch first runs, and that one ever after."""
    kept = f"{path}/_versions/batch={batch}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{kept}/_SUCCESS")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        versions = spark.read.option("basePath", dictionary_path).parquet(dictionary_path).agg(F.max("version").cast("long").alias("version"))
        versions.write.mode("overwrite").parquet(kept)
    return spark.read.parquet(kept).first()["version"]


def clean_stream_with_names(
    messages: DataFrame,
    options: CleaningOptions,
    dictionary_path: str,
    path: str,
    checkpoint: str,
    **trigger,
) -> StreamingQuery:
    """``clean_stream`` with a name dictionary of any size (``write_names``), joined to each batch.

    A batch takes the latest version there is when it first runs and notes it, and it writes a folder
    of its own: a batch that runs again gives the same rows in the same place. A batch's scratch
    tables, which hold texts not yet redacted, are removed when its documents are written.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark, before = batch.sparkSession, set(scratch_folders())
        version = _version_of(spark, dictionary_path, path, number)
        names = spark.read.schema("name STRING, label STRING").parquet(f"{dictionary_path}/version={version}")
        documents = with_ingest_date(build_documents(batch, options, names))
        documents.write.mode("overwrite").partitionBy("status", "ingest_date").parquet(f"{path}/batch={number}")
        remove_scratch([p for p in scratch_folders() if p not in before])

    return (
        messages.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 minute"}))
        .start()
    )


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """The documents of all batches of ``clean_stream_with_names``."""
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*")


def error_rate(
    outcomes: DataFrame,
    ts: str = "ts",
    is_error: str = "is_error",
    threshold: float = 0.05,
    late: str = "10 minutes",
) -> DataFrame:
    """Share of errors over five minutes, every minute, where it exceeds a threshold."""
    return (
        outcomes.withWatermark(ts, late)
        .groupBy(F.window(ts, "5 minutes", "1 minute").alias("w"))
        .agg(F.count("*").alias("n"), F.count_if(F.col(is_error)).alias("n_errors"))
        .filter(F.col("n_errors") / F.col("n") > threshold)
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "n",
            "n_errors",
        )
    )


def slow_windows(
    outcomes: DataFrame,
    ts: str = "ts",
    duration: str = "duration",
    limit: float = 2.0,
    late: str = "10 minutes",
    accuracy: int = 10_000,
) -> DataFrame:
    """Five-minute windows whose 99th percentile of a duration exceeds a limit."""
    return (
        outcomes.withWatermark(ts, late)
        .groupBy(F.window(ts, "5 minutes").alias("w"))
        .agg(F.count("*").alias("n"), F.percentile_approx(duration, 0.99, accuracy).alias("p99"))
        .filter(F.col("p99") > limit)
        .select(
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "p99"
        )
    )


def hourly_counts(
    findings: DataFrame, ts: str = "ts", kind: str = "type", late: str = "10 minutes"
) -> DataFrame:
    """Findings per hour and type: the table that spikes are looked for in."""
    return (
        findings.withWatermark(ts, late)
        .groupBy(F.window(ts, "1 hour").alias("w"), kind)
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("hour"), kind, "n")
    )


_SPIKE_KEYS = "hour TIMESTAMP, type STRING"


def spikes(
    counts: DataFrame, of: DataFrame | None = None, kind: str = "type", factor: float = 2.0
) -> DataFrame:
    """Hours with more than ``factor`` times the findings of the same hour the day before.

    ``counts`` is a table of ``hourly_counts``: one row per hour and type, small whatever
    the number of messages. Hours without a day before have no yardstick and do not show.
    ``of`` are the counts to look for spikes in, by default all.
    """
    later = counts if of is None else of
    before = counts.select(
        (F.col("hour") + F.expr("INTERVAL 24 HOURS")).alias("hour"),
        kind,
        F.col("n").alias("n_day_before"),
    )
    return later.join(before, ["hour", kind]).filter(F.col("n") > factor * F.col("n_day_before"))


def spikes_in_stream(
    findings: DataFrame, ts: str = "ts", kind: str = "type", late: str = "10 minutes", factor: float = 2.0
) -> DataFrame:
    """``spikes`` of a stream of findings, with a day of hourly counts as its whole state.

    The closed hours are joined with those of the day before, stream with stream: the watermark
    drops an hour from the state once the same hour of the next day is over, and no older batch
    is read again.
    """

    def hours() -> DataFrame:
        counted = findings.withWatermark(ts, late).groupBy(F.window(ts, "1 hour").alias("w"), kind).agg(F.count("*").alias("n"))
        return counted.select(F.window_time("w").alias("at"), F.col("w.start").alias("hour"), F.col(kind).alias("type"), "n")

    day = F.expr("INTERVAL 24 HOURS")
    now, before = hours().alias("now"), hours().alias("before")
    due = F.col("before.at") + day
    same = (F.col("now.type") == F.col("before.type")) & (F.col("now.at") >= due) & (F.col("now.at") <= due)
    found = now.join(before, same).where(F.col("now.n") > factor * F.col("before.n"))
    return found.select("now.hour", F.col("now.type").alias(kind), "now.n", F.col("before.n").alias("n_day_before"))


def watch_spikes(
    counts: DataFrame, counts_path: str, spikes_path: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Compare the hours that a stream of ``hourly_counts`` closes with the stored ones.

    Each batch first stores its counts, then compares its own hours with everything stored; an
    hour closes after the one a day before it, so no spike is missed. A batch that is run again
    overwrites its own folder in both tables.
    """

    def handle(closed: DataFrame, batch: int) -> None:
        spark = closed.sparkSession
        closed.write.mode("overwrite").parquet(f"{counts_path}/batch={batch}")
        known = spark.read.schema(f"{_SPIKE_KEYS}, n BIGINT, batch BIGINT").option("basePath", counts_path).parquet(counts_path)
        found = spikes(known.drop("batch"), known.filter(F.col("batch") == batch).drop("batch"))
        found.write.mode("overwrite").parquet(f"{spikes_path}/batch={batch}")

    return (
        counts.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**trigger)
        .start()
    )


def read_spikes(spark: SparkSession, path: str) -> DataFrame:
    schema = f"{_SPIKE_KEYS}, n BIGINT, n_day_before BIGINT"
    return spark.read.schema(schema).parquet(f"{path}/batch=*")


def distinct_messages(
    stream: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour"
) -> DataFrame:
    """First arrival per key. State is kept for ``late`` only; copies that arrive later
    than that pass, rows behind the watermark are dropped."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Work off what is there, then read the result back."""
    spark: SparkSession = stream.sparkSession
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
