"""Connected components of links by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.storage import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node hands the smallest node of its neighbourhood to its larger (or other) neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.filter("v < u")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    moved = joined.filter("v > u" if large else "true").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter("u != v").distinct()


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """node, root for every node of ``links`` (u, v): root is the smallest node that it reaches.

    A round hands each node's smallest neighbour on, first to larger neighbours, then to all
    smaller ones; the number of rounds grows with the logarithm of a component's diameter. Each
    round is a stored table; it ends when a round changes nothing. Nulls must not occur.
    """
    edges = stage(links.select("u", "v").filter("u != v").distinct(), "links")
    print_of = None
    for _ in range(rounds):
        edges = stage(_star(_star(edges, True), False), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == print_of:
            break
        print_of = tuple(now)
    else:
        raise RuntimeError(f"no fixed point in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
