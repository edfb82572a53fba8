"""Connected components of a distributed link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, join_counted, settle


def _rooted(links: DataFrame) -> DataFrame:
    """Each link from the larger to the smaller end, once."""
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """links: a, b (any orderable type, no nulls).  Returns node, root: root is the smallest node reachable.

    Alternates large-star and small-star steps until the links are stars.  Every step is a grouped minimum (combined
    before the shuffle) and a join by counts (a hot hub's links are joined where they lie), so no neighbour list is ever
    gathered.  The end is told by the number of links and two sums of their 64-bit hashes.
    """
    links = settle(_rooted(links), "links")
    state = None
    while True:
        n, mark = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")) * 2 + F.sum(F.xxhash64("b", "a").cast("decimal(20,0)"))).first()
        if not n or (n, mark) == state:
            break
        state = (n, mark)
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = settle(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"), "least")
        large = settle(_rooted(join_counted(both, least, ["a"], "n").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))), "large")
        low = settle(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "low")
        small = join_counted(large, low, ["a"], "n").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("l")).select("l.*")
        new = settle(_rooted(small), "links")
        for old in (links, least, large, low):
            forget(old)
        links = new
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
