"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostsieve.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node it reaches) for each node of the edges (a long, b long).

    An edge is kept as its larger end u and its smaller end v. Large stars hang u on the smallest neighbour of v, small
    stars hang a node's smaller neighbours on the smallest of them; what stays is a star for each component, after a number
    of rounds that grows with the logarithm of the longest path. The smallest neighbour comes from an aggregation that
    combines before it shuffles, and is joined back, so that a hub is a skewed join key, which Spark splits. Each round
    ends in a written table; edges that are stars already take one. Self-links and repeated rows do no harm.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = fingerprint(edges)
    while True:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        large = edges.join(least.withColumnRenamed("u", "v"), "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        hung = [F.struct(F.col(c).alias("u"), F.col("m").alias("v")) for c in ("u", "v")]
        small = small.select(F.inline(F.array(*hung)))
        edges = stored(small.where("u <> v").distinct())
        now = fingerprint(edges)
        if now == before:
            break
        before = now
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(leaves.select(F.col("component").alias("node"), "component").distinct())


def fingerprint(edges: DataFrame) -> tuple:
    """Number and hash of the rows, whatever their order."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
