"""Connected components of an edge table by alternating large-star and small-star steps.

Every vertex ends linked to the smallest vertex of its component. Edges stay
a distributed table; each step's minima are a written table of their own, so
the join on a vertex with very many edges is one Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import staged

MAX_STEPS = 40


def _least(both: DataFrame) -> DataFrame:
    return staged(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "star-minima")


def components(edges: DataFrame) -> DataFrame:
    """``edges``: (a, b). Returns (vertex, component) for every vertex with an edge to another."""
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(MAX_STEPS):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = staged(large, "large-star")
        least = _least(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = staged(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "small-star")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    ends = now.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    return ends.union(now.select(F.col("v").alias("vertex"), F.col("v").alias("component"))).distinct()
