"""Connected components of a graph of links, by alternating large-star and small-star steps.

Both steps join each node to the least node that it can see; the links shrink to stars around the
least node of each component in a number of rounds that grows with the logarithm of the longest
path. Nothing but two numbers a round reaches the driver. The least neighbour is found with partial
aggregation; a node with very many links is split by Spark's skew join when it is joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import settle


def components(links: DataFrame) -> DataFrame:
    """(node, least): each node of `links` (columns a and b, long) and the least node of its component."""
    e = settle(_both(links.select("a", "b").where("a <> b")).where("a > b").distinct())
    before = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
        e = settle(_small_star(_large_star(e)))
    least = e.groupBy("a").agg(F.min("b").alias("least"))
    return least.select(F.col("a").alias("node"), "least").unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("least")).distinct())


def _both(e: DataFrame) -> DataFrame:
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(e: DataFrame) -> DataFrame:
    """Links every greater neighbour of a node to the least of the node and its neighbours."""
    both = _both(e)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "n")
    out = both.join(least, both["a"] == least["n"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Links a node and its lesser neighbours to the least of them."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    named = least.select(F.col("a").alias("n"), "m")
    out = e.join(named, e["a"] == named["n"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
