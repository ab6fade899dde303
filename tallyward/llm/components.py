"""Connected components of a link table, by alternating large-star and small-star steps over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.common import held


def _closest(pairs: DataFrame) -> DataFrame:
    """(a, least): the smallest of a node and its neighbours. Summed up in the map tasks, so a node of many links is no matter."""
    return pairs.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))


def _large_star(links: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the smallest of the node and its neighbours."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.join(_closest(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them; links lead from larger to smaller."""
    least = _closest(links)
    moved = links.join(least, "a").where("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select("a", F.col("least").alias("b"))).where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of a link table (a, b) with a > b: the smallest node that can be reached.

    Each round is written to the shared folder and read back. The rounds grow with the logarithm of the longest chain. The
    driver sees two numbers a round, never links.
    """
    current = held(links.distinct(), "links")
    state = None
    while True:
        current = held(_small_star(_large_star(current)), "links")
        summed = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(summed) == state:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = tuple(summed)
