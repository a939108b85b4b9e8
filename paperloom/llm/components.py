"""Connected components of a distributed list of links, by alternating large and small stars.

Every round is a few aggregations and equi-joins over the links, kept as a table in the shared folder; a node with very
many links is summed up before the shuffle and its join partition can be split. Rounds grow with the logarithm of the
longest path. No link is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``links``: columns a and b (any order, repeats and loops allowed). Returns node and root, its component's least
    node, for all nodes with links but the roots themselves."""
    e = scratch.keep(_tidy(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), f"{name}-0")
    mark, k = _mark(e), 0
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _tidy(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        k += 1
        e = scratch.keep(_tidy(small), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        now = _mark(e)
        if now == mark:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now


def _tidy(links: DataFrame) -> DataFrame:
    return links.filter("a != b").distinct()


def _mark(e: DataFrame):
    """Equal for equal sets of links."""
    return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
