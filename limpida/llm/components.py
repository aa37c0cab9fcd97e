"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limpida.llm.tables import stored


def components(links: DataFrame) -> DataFrame:
    """Each node of ``links`` (a, b) with the least node it can reach: id, component.

    Every round moves links towards the least neighbour, first those to larger nodes, then those to
    smaller ones, until nothing changes; that takes about log n rounds. A node's links are only ever
    aggregated to their least end, never gathered, and the result of a round is a written table.
    """
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    before = None
    while True:
        both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("a", "b")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.toDF("a", "b")).distinct()
        edges = stored(small, "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.toDF("id", "component")
        before = now
