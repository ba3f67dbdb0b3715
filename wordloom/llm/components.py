"""Connected components of links by alternating large and small stars.

Each step replaces links by links to smaller nodes and keeps components; it
ends when nothing changes, after a number of steps that grows with the
logarithm of the longest path.  A step is a minimum per node (combined before
the shuffle, so a hot node costs a row per task) and a join; each step's links
are checkpointed in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import checkpointed


def connect(links: DataFrame) -> DataFrame:
    """node, comp (smallest node reachable) of every node of links (a, b)."""
    edges = checkpointed(_ordered(links.select("a", "b")))
    before = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("comp"))).distinct()
        before = mark
        edges = checkpointed(_small_star(_large_star(edges)))


def _ordered(links: DataFrame) -> DataFrame:
    return links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _ordered(moved.unionByName(least.withColumnRenamed("m", "b")))
