"""Graphviz export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph


def dot_lines(graph: PropertyGraph) -> DataFrame:
    """One line for each node and relationship, without the enclosing braces; (part, value)."""
    nodes = graph.node_table().select(F.lit(0).alias("part"), F.format_string('  n%d [label="%s"];', "id", "label").alias("value"))
    rels = graph.rel_table().select(F.lit(1).alias("part"), F.format_string('  n%d -> n%d [label="%s"];', "src", "dst", "label").alias("value"))
    return nodes.unionByName(rels)


def write_dot(graph: PropertyGraph, path: str) -> None:
    """A folder of text parts that make one digraph when they are joined in the order of their names."""
    frame = graph.spark.createDataFrame([(-1, "digraph g {"), (2, "}")], "part int, value string")
    dot_lines(graph).unionByName(frame).repartitionByRange("part").sortWithinPartitions("part").select("value").write.mode("overwrite").text(path)
