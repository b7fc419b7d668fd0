"""Connected components of a link table, on Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finlake.session import stage_table


def _digest(edges: DataFrame) -> tuple[int, int | None]:
    """Number of distinct links and the xor of their hashes: equal when nothing changed."""
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1]


def components(links: DataFrame) -> DataFrame:
    """(``node``, ``root``) for every node of ``links`` (``a``, ``b``, longs); the root is the smallest node reachable.

    Two steps alternate: every node hands its larger neighbours to its smallest
    one, then its smaller neighbours. Links only ever move to smaller nodes and
    their number does not grow, so that a hub's links are spread by their other
    end after one round. Self links and repeated links do no harm.
    """
    edges = stage_table(links.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    now = _digest(edges)
    while True:
        # Larger neighbours to the smallest of the neighbourhood.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        # Smaller neighbours, and the node itself, to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        after = stage_table(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        edges, before, now = after, now, _digest(after)
        if now == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
