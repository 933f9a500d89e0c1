"""One hop and walks of variable length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph, node_struct, rel_struct, union_all
from graphloom.storage import materialise

#: Walks up to this many hops are one lazy plan; longer ones stop when nothing new is found.
LAZY_HOPS = 4


def hop(df: DataFrame, ident: Column, rels: DataFrame, end: str, name: str) -> DataFrame:
    """``df`` joined to the relationships whose ``end`` (src or dst) is the node; the relationship becomes ``name``."""
    side = rels.select(F.col(end).alias("__end"), rel_struct(rels).alias(name))
    return df.withColumn("__node", ident).join(side, F.col("__node") == F.col("__end")).drop("__node", "__end")


def walk_ends(starts: DataFrame, rels: DataFrame, end: str, low: int, high: int | None) -> DataFrame:
    """(origin, rel): the distinct relationships that end a walk of ``low`` to ``high`` hops from each origin.

    Frontiers hold distinct (origin, node) pairs, so a walk's cost does not grow with the number of ways to a node.
    """
    other = "dst" if end == "src" else "src"
    low = max(1, low)
    edges = rels.select(F.col(end).alias("node"), F.col(other).alias("to"), rel_struct(rels).alias("rel"))
    frontier = starts.select("origin", F.col("origin").alias("node"))
    if high is not None and high <= LAZY_HOPS:
        found = []
        for depth in range(1, high + 1):
            step = frontier.join(edges, "node")
            if depth >= low:
                found.append(step.select("origin", "rel"))
            frontier = step.select("origin", F.col("to").alias("node")).distinct()
        return union_all(found).distinct() if found else edges.join(starts.limit(0), F.lit(False)).select("origin", "rel")
    ids = edges.select("node", "to", F.col("rel.id").alias("rel_id"))
    seen, depth = None, 1
    while high is None or depth <= high:
        step = frontier.join(ids, "node").select("origin", F.col("node").alias("near"), "to", "rel_id").distinct()
        if depth >= low:
            if seen is not None:  # a relationship found before has continued already
                step = step.join(seen, ["origin", "near", "to", "rel_id"], "left_anti")
            step = materialise(step)
            if step.isEmpty():
                break
            seen = step if seen is None else seen.unionByName(step)
        frontier = step.select("origin", F.col("to").alias("node")).distinct()
        depth += 1
    if seen is None:
        return edges.join(starts.limit(0), F.lit(False)).select("origin", "rel")
    key = edges.select(F.col("node").alias("near"), "to", F.col("rel.id").alias("rel_id"), "rel")
    return seen.join(key, ["near", "to", "rel_id"]).select("origin", "rel")


def variable(df: DataFrame, ident: Column, rels: DataFrame, end: str, low: int, high: int | None, name: str) -> DataFrame:
    starts = df.select(ident.alias("origin")).where("origin is not null").distinct()
    found = walk_ends(starts, rels, end, low, high).withColumnRenamed("rel", name)
    return df.withColumn("__node", ident).join(found, F.col("__node") == F.col("origin")).drop("__node", "origin")


def foreach(graph: PropertyGraph, df: DataFrame, ident: Column, direction: str, type_: str | None, low: int | None, high: int | None, at: int) -> DataFrame:
    rels = graph.rel_table(type_)
    rel, node = f"_{at}", f"_{at + 1}"

    def one(end: str) -> DataFrame:
        return hop(df, ident, rels, end, rel) if low is None and high is None else variable(df, ident, rels, end, low or 1, high, rel)

    if direction != "ALL":
        return one("src" if direction == "FROM" else "dst")
    parts = [(one("src"), "dst", 1), (one("dst"), "src", 0)]
    labels = {n for _, _, e in parts for n in (graph.end_labels(type_, e) or graph.labels(None))}
    nodes = graph.node_table(sorted(labels))
    both = union_all([d.withColumn("__other", F.col(rel).getField(k)) for d, k, _ in parts])
    return both.join(nodes.select(F.col("id").alias("__id"), node_struct(nodes).alias(node)), F.col("__other") == F.col("__id")).drop("__other", "__id")


def expand(graph: PropertyGraph, df: DataFrame, rel: str, direction: str, labels, types, at: int) -> DataFrame:
    """Append the node at the relationship's end; only tables that can hold it are read."""
    known = graph.end_labels(types, 1 if direction == "OUT" else 0) if types else None
    wanted = [n for n in graph.labels(labels) if known is None or n in known]
    nodes = graph.node_table(wanted)
    side = nodes.select(F.col("id").alias("__id"), node_struct(nodes).alias(f"_{at}"))
    return df.join(side, F.col(rel).getField("dst" if direction == "OUT" else "src") == F.col("__id")).drop("__id")
