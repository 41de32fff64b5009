"""Connected components of a link table, by alternating star contraction.

Large-star links every larger neighbour of a node to the node's least neighbour,
small-star does the same for the smaller ones; repeated, every component becomes a star
around its least node. Both steps are an aggregate and a join, so a node with very many
links is summed map-side and its links can be split between tasks. The number of rounds
grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stayline.llm.common import keep


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    both = _both_ways(links)
    # Written first, so that the join deals out both sides itself and can split a hot node.
    least = keep(both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("m")
    ), "least")
    linked = both.where("b > a").join(least, F.col("a") == F.col("node"))
    return linked.select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """``links`` point from the larger to the smaller node."""
    least = keep(links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), "m"), "least")
    down = links.join(least, F.col("a") == F.col("node"))
    moved = down.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("node").alias("a"), F.col("m").alias("b")))


def _mark(links: DataFrame) -> tuple:
    """Count and order-free checksum of the links."""
    return tuple(links.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    ).first())


def component_roots(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long); root is the least node."""
    links = keep(links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _mark(links)
    while True:
        stars = keep(_large_star(links).distinct(), "links")
        links = keep(_small_star(stars).where("a <> b").distinct(), "links")
        previous, mark = mark, _mark(links)
        if mark == previous:
            break
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        roots.select("node", F.col("node").alias("root"))
    )
