"""Connected components of a link table, by alternating large-star and small-star steps.

Nothing is collected: a step is a grouped minimum (pre-aggregated before its shuffle) and an
equi-join back, which Spark splits where one node has very many links.  Each round is written to
the shared folder, so lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import release, stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) for every node in links; self-links count as nodes.

    Node ids may be of any ordered type; null ends are ignored.
    """
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    # every edge points from the larger node to the smaller one
    edges = stored(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = _mark(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where(F.col("u") != F.col("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        nodes = edges.where(F.col("u") == F.col("v"))
        step = stored(large.union(nodes).distinct(), "large-star")
        down = step.where(F.col("u") > F.col("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        turned = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        after = stored(turned.union(step.where(F.col("u") == F.col("v"))).distinct(), "small-star")
        new = _mark(after.where(F.col("u") != F.col("v")))
        release(edges)
        release(step)
        edges = after
        if new == mark:
            break
        mark = new
    real = edges.where(F.col("u") != F.col("v"))
    return real.union(edges.select(F.col("v").alias("u"), "v")).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def _mark(edges: DataFrame) -> tuple:
    """Tells two edge sets apart: their count and order-free digests of hashes that can't overflow."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(h.bitwiseAND(0xFFFFFF))).first())
