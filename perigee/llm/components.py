"""Connected components of a graph that no machine could hold, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perigee.llm.shared import materialize


def _with_min(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with m, the least of u and its neighbours; hot nodes combine before the shuffle."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of an edge list; root is the least node of the component.

    Each round joins every larger neighbour to the least neighbour, then every smaller neighbour; the edge list never
    grows beyond its first size, and rounds go with the logarithm of the diameter. They end when one changes no edge.
    Each ends in a reliable checkpoint, so a lost executor costs one round at most.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    e = materialize(e)
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_min(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _with_min(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v"))
        star = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        e = materialize(star.where("u != v").distinct())
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
