"""Keep one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from limpida.session import stored

#: Up to so many 8-byte values are sent to the tasks that need them; more meet the rows by a shuffled join.
BROADCAST_VALUES = 2_000_000


def _bounded(values: DataFrame) -> DataFrame:
    """A written column of values, sent whole where its count proves it small."""
    return F.broadcast(values) if values.count() <= BROADCAST_VALUES else values


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key by ``order``; of rows equal in both, any one. Null is a key like others.

    ``df`` is read several times: give a written table. Rows whose key comes once, told by counting 8-byte hashes,
    stay where they are. The others are written and numbered; only key, order and number are sorted and
    shuffled, thinned to one row per key and task before, so a key that holds a third of all rows
    sends one row per task. The numbers of first rows then pick the whole rows.
    """
    marked = df.withColumn("__key", F.xxhash64(*keys))
    repeated = marked.groupBy("__key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__key")
    repeated = _bounded(stored(repeated, "repeated_keys"))
    alone = marked.join(repeated, "__key", "left_anti").select(*df.columns)
    shared = marked.join(repeated, "__key", "left_semi").withColumn("__row", F.monotonically_increasing_id())
    shared = stored(shared.drop("__key"), "repeated_rows")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, "__row"))
    narrow = shared.select(*dict.fromkeys([*keys, *order]), "__row").withColumn("__rank", rank)
    first = _bounded(stored(narrow.where("__rank = 1").select("__row"), "first_rows"))
    return alone.unionByName(shared.join(first, "__row", "left_semi").select(*df.columns))


def deduplicate_documents(documents: DataFrame) -> DataFrame:
    """First message per digest of the cleaned body. Run it on documents read back from a
    table, so that cleaning is not part of the shuffle's lineage."""
    return keep_first(
        documents.filter(F.col("body_original_hash") != ""),
        ["body_original_hash"],
        ["fetched_at", "message_id", "mailbox", "uidvalidity", "uid"],
    )
