"""Connected components of a table of links by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotweave.llm.shared import new_path, remove, written_at


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b): component is the least node that can be reached.

    Each step sends every neighbour to the least node of its neighbourhood, by sums per node that are combined before
    the shuffle; a hub's neighbours stay separate rows. Ends when a round of both steps changes nothing.
    """
    spark = links.sparkSession
    path = new_path(spark, "edges")
    edges = written_at(links.filter("a <> b").selectExpr("greatest(a, b) as a", "least(a, b) as b").distinct(), path)
    mark = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").selectExpr("b as a", "m as b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").filter("b <> m").selectExpr("b as a", "m as b").union(least.selectExpr("a", "m as b"))
                 .filter("a <> b").selectExpr("greatest(a, b) as a", "least(a, b) as b").distinct())
        before, path = path, new_path(spark, "edges")
        edges = written_at(small, path)
        remove(spark, before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.selectExpr("a as node", "b as component").union(edges.selectExpr("b as node", "b as component")).distinct()
        mark = now
