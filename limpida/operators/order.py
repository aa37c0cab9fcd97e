"""The place of each row in its batch, as a column that survives shuffles."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limpida.session import stored


def with_ordinal(df: DataFrame, order: list[str] | None = None, out: str = "ordinal") -> DataFrame:
    """Number rows from 0 without gaps: in order of the columns ``order``, or as a scan gives them.

    Two passes and no single task: rows are written with their partition and their place in it, then
    the rows of each partition are counted, and its place is the number of rows before it. Sorting is
    by ranges, so that a frequent value is split where later columns tell its rows apart. Only one
    count per partition comes to the driver. Nulls come first; of rows equal in all of ``order``
    any order may come out, but numbers stay without gaps or repeats.
    """
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The lower 33 bits number the rows of a partition, the upper ones the partitions.
    placed = stored(df.withColumn("__place", F.monotonically_increasing_id()), "places")
    part = F.shiftright("__place", 33)
    counts = sorted(placed.groupBy(part.alias("part")).count().collect())
    offsets = accumulate((r["count"] for r in counts), initial=0)
    rows = [(r["part"], before) for r, before in zip(counts, offsets, strict=False)]
    before = df.sparkSession.createDataFrame(rows, "__part LONG, __before LONG")
    inside = F.col("__place").bitwiseAND((1 << 33) - 1)
    joined = placed.withColumn("__part", part).join(F.broadcast(before), "__part")
    return joined.withColumn(out, F.col("__before") + inside).drop("__part", "__place", "__before")
