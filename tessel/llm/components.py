"""Connected components of a table of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize


def components(edges: DataFrame) -> DataFrame:
    """node and root, the least node of its component, for every node of ``edges`` (a, b: longs).

    Each round is two aggregations of minima and two joins, and is written to the shared folder; the rounds grow
    with the logarithm of the longest chain. Loops, repeated links and empty tables are allowed; links with a
    null end are dropped.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    nodes = materialize(e.distinct(), "links")
    e, before = nodes.where("a <> b"), None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        e = materialize(small, "stars")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    alone = nodes.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return alone.join(e.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
