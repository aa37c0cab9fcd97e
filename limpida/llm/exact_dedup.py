"""Exact deduplication by Grace hashing (operator 2).

Texts are equal when they are identical after deleting blanks. Equal texts meet in one
partition by the leading bits of a content digest; that is the first level of partitioning, and
Spark does it. Inside a task, records go into an open-addressing table that compares complete
contents. A table over its memory budget is dealt out, with the rest of its input, to spill files
by further bits of the digest, and each file is worked off in the same way.

The table keeps one entry per distinct content, so copies never make it grow, and the same table
thins out copies before the shuffle: a content that a third of all rows share crosses it once per
map task. Rows are labelled afterwards by a join on the digest, which Spark splits where it is skewed.

Defined results: null text counts as empty; all texts without other characters than blanks are one
group. The row with the most code points in its original text stays, then the smallest ``doc_id``
(null ids last). Repeated rows count as copies. An empty table gives an empty result. Other columns
are not read. Spill files are private to a task and go with it: a retried task writes its own.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"

#: Content bytes that a task's table may hold before it is dealt out to spill files.
TABLE_BYTES = 48 << 20
FAN_OUT = 16
_ROWS_OUT = 2000

RECORD = "digest binary, content string, n_points int, keep_id long, group_size long"
_ARROW = pa.schema(
    [
        ("digest", pa.binary()),
        ("content", pa.string()),
        ("n_points", pa.int32()),
        ("keep_id", pa.int64()),
        ("group_size", pa.int64()),
    ]
)
_NO_ID = 1 << 63


class ContentTable:
    """Open addressing with linear probing; an entry is [digest, content, points, id, count]."""

    def __init__(self) -> None:
        self.slots = np.full(1 << 10, -1, np.int64)
        self.entries: list[list] = []
        self.bytes = 0

    def add(self, digest: bytes, content: str, points: int, keep: int | None, count: int) -> None:
        slots, entries = self.slots, self.entries
        mask = len(slots) - 1
        at = int.from_bytes(digest[-8:], "little") & mask
        while (found := slots[at]) >= 0:
            entry = entries[found]
            if entry[0] == digest and entry[1] == content:
                entry[4] += count
                if (points, -_NO_ID if keep is None else -keep) > (entry[2], -_NO_ID if entry[3] is None else -entry[3]):
                    entry[2], entry[3] = points, keep
                return
            at = (at + 1) & mask
        slots[at] = len(entries)
        entries.append([digest, content, points, keep, count])
        self.bytes += len(content) * 2 + 200
        if len(entries) * 2 > len(slots):
            self._grow()

    def _grow(self) -> None:
        mask = len(self.slots) * 2 - 1
        self.slots = np.full(mask + 1, -1, np.int64)
        for n, entry in enumerate(self.entries):
            at = int.from_bytes(entry[0][-8:], "little") & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = n

    def batches(self) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(self.entries), _ROWS_OUT):
            yield _batch(self.entries[lo : lo + _ROWS_OUT])


def _batch(entries: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*entries, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    for batch in batches:
        for lo in range(0, batch.num_rows, _ROWS_OUT):
            part = batch.slice(lo, _ROWS_OUT)
            yield from map(list, zip(*(part.column(f.name).to_pylist() for f in _ARROW), strict=True))


class _Files:
    """Spill files of one level; a record goes by the digest's byte of that level."""

    def __init__(self, folder: str, level: int) -> None:
        self.level = level
        self.paths = [Path(folder) / f"{n}.arrow" for n in range(FAN_OUT)]
        self.sinks = [pa.ipc.new_stream(str(p), _ARROW) for p in self.paths]
        self.held: list[list] = [[] for _ in self.paths]

    def add(self, row: list) -> None:
        n = row[0][self.level % 24] % FAN_OUT
        self.held[n].append(row)
        if len(self.held[n]) >= 256:
            self._flush(n)

    def _flush(self, n: int) -> None:
        if self.held[n]:
            self.sinks[n].write_batch(_batch(self.held[n]))
            self.held[n] = []

    def close(self) -> None:
        for n, sink in enumerate(self.sinks):
            self._flush(n)
            sink.close()


def grace(rows: Iterator[list], limit: int = TABLE_BYTES, level: int = 8) -> Iterator[pa.RecordBatch]:
    """One record per distinct content of ``rows``, in memory of about ``limit`` bytes.

    Levels start after the eight digest bytes that dealt the rows to this task.
    """
    table = ContentTable()
    for row in rows:
        table.add(*row)
        # A single content cannot be split further, however long it is.
        if table.bytes > limit and len(table.entries) > 1:
            break
    else:
        yield from table.batches()
        return
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        files = _Files(folder, level)
        for entry in table.entries:
            files.add(entry)
        del table
        for row in rows:
            files.add(row)
        files.close()
        for path in files.paths:
            with pa.ipc.open_stream(str(path)) as source:
                yield from grace(_rows(iter(source)), limit, level + 1)
            path.unlink()


def _grace_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return grace(_rows(batches))


def normalised(text):
    """The text without blanks; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def content_groups(docs: DataFrame) -> DataFrame:
    """One row per distinct content: digest, n_points, keep_id, group_size."""
    content = normalised(F.col("text"))
    records = docs.select(
        F.unhex(F.sha2(content, 256)).alias("digest"),
        content.alias("content"),
        F.coalesce(F.length("text"), F.lit(0)).alias("n_points"),
        F.col("doc_id").cast("long").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
    )
    thinned = records.mapInArrow(_grace_partition, RECORD)
    met = thinned.repartition(F.substring("digest", 1, 8))
    return met.mapInArrow(_grace_partition, RECORD).drop("content")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Every row with its group: doc_id, keep_id, group_size, kept, text_sha256."""
    digest = F.sha2(normalised(F.col("text")), 256)
    rows = docs.select("doc_id", digest.alias("text_sha256"))
    groups = content_groups(docs).select(
        F.lower(F.hex("digest")).alias("text_sha256"), "keep_id", "group_size"
    )
    return rows.join(groups, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns; of a row given several times, one.

    Id and digest deal the texts out once; the last step finds equal rows side by side.
    """
    id_key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))
    keep = content_groups(docs).select(F.coalesce("keep_id", F.lit(-1)).alias("__id"), F.lower(F.hex("digest")).alias("__digest"))
    keyed = docs.withColumns({"__id": id_key, "__digest": F.sha2(normalised(F.col("text")), 256)})
    return keyed.join(keep, ["__id", "__digest"], "left_semi").dropDuplicates(["__id", "__digest"]).select(*docs.columns)
