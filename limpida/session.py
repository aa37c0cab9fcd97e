"""Session helpers: a local session for tests, scratch folders, input parallelism."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("limpida")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ship_package(spark)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers, as ``--py-files`` would."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="limpida-code-")
        archive = shutil.make_archive(f"{folder}/limpida", "zip", root.parent, root.name)
        context.addPyFile(archive)
        _shipped.add(context.applicationId)
    return spark


#: Scratch folders of this process that still exist, with the session that made them.
_scratch: dict[str, SparkSession] = {}


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder for tables that cut lineage and for stream checkpoints.

    On a cluster it lies under the shared folder of ``spark.checkpoint.dir``; only where
    that is unset on one machine, as in tests, a temporary folder stands in. It lives until
    ``remove_scratch``, or the end of this process.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="limpida-")
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _scratch[path] = spark
    return path


def scratch_folders() -> list[str]:
    """Scratch folders that were not removed yet."""
    return list(_scratch)


def remove_scratch(paths: list[str] | None = None) -> None:
    """Remove scratch tables, by default all: call it when the results that read them are written.

    Folders are removed through Spark's file system, so any store it can write to will do.
    """
    for path in list(_scratch) if paths is None else paths:
        spark = _scratch.pop(path)
        context = spark.sparkContext
        if context._jsc is None or context._jsc.sc().isStopped():
            continue
        folder = context._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


@atexit.register
def _remove_at_exit() -> None:
    try:
        remove_scratch()
    except Exception:  # the JVM is gone: there is nothing left to remove it with
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared scratch folder and read it back: costly work is done
    once, and a lost executor costs a read, not a recomputation."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """Use all cores when a scan has fewer splits than there are cores.

    A few large files, or one row group, would otherwise keep most cores idle through
    the costly text expressions. Large inputs have many splits and stay as they are, so
    at scale no shuffle is added. Rows are dealt out in turn: no key can skew them.
    Only for what a reader gives: counting the splits of a plan with shuffles would run them.
    """
    if scan.isStreaming:
        return scan
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
