"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _fingerprint(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with a link; component is the smallest node.

    Each round joins every node's neighbours to its smallest one: first the larger
    neighbours, then the smaller. Minima are aggregated before they are shuffled, and a
    node with very many links is one side of a join that Spark can split (nothing is made
    distinct between the shuffle and the join, which would keep it whole). Rounds end when
    the links no longer change; their number grows as the logarithm of the longest path.
    Links to a null or to the node itself are none.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = stored(edges, "links")
    seen = _fingerprint(edges)
    while seen[0]:
        # Large star: with m the least of u and its neighbours, link each larger neighbour to m.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # Small star: link u and its smaller neighbours to the least of them.
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        linked = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = stored(linked.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = _fingerprint(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
