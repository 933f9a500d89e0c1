"""Connected components of a link table by alternating large and small stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut, drop


def _lowest(edges: DataFrame) -> DataFrame:
    """(u, v, m) with m the lowest of u and its neighbours; min is combined before the shuffle."""
    low = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(low, "u")


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` has columns a and b; returns (id, component) for every linked id, the lowest id naming a component."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")
    state = None
    while True:  # to the fixed point: stars that point at their lowest ids
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _lowest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _lowest(large)
        new = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "cc")
        drop(edges)
        edges = new
        now = edges.agg(F.count(F.lit(1)), *(F.sum(F.xxhash64(F.lit(k), "u", "v").cast("decimal(38,0)")) for k in (1, 2))).first()
        if now == state:
            break
        state = now
    pairs = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return pairs.unionByName(pairs.select(F.col("component").alias("id"), "component").distinct())
