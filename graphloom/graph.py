"""The property graph: one table for each node label and each relationship type.

A node table has ``id`` and typed property columns; a relationship table has ``id``, ``src``, ``dst`` and property columns.  Graphs are
immutable: an update returns a new graph whose tables are plans over the old ones.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.errors import UnknownId

REL_KEYS = ("id", "src", "dst")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


@dataclass(frozen=True)
class PropertyGraph:
    """``ends`` names, for each type, the labels of its two ends; a lookup of an end then reads no other label."""

    spark: SparkSession
    nodes: dict[str, DataFrame]
    rels: dict[str, DataFrame]
    ends: dict[str, tuple[str, str]] = field(default_factory=dict)
    indexes: frozenset[tuple[str, str]] = frozenset()

    def labels(self, labels: str | Iterable[str] | None) -> list[str]:
        if labels is None:
            return sorted(self.nodes)
        names = [labels] if isinstance(labels, str) else list(dict.fromkeys(labels))
        return [n for n in names if n in self.nodes]

    def types(self, types: str | Iterable[str] | None) -> list[str]:
        if not types:
            return sorted(self.rels)
        names = [types] if isinstance(types, str) else list(dict.fromkeys(types))
        return [n for n in (t.lstrip(":") for t in names) if n in self.rels]

    def node_table(self, labels: str | Iterable[str] | None = None) -> DataFrame:
        """id, label and all properties of the labels; no label reads all tables."""
        parts = [self.nodes[n].withColumn("label", F.lit(n)) for n in self.labels(labels)]
        return union_all(parts) if parts else self.spark.createDataFrame([], "id long, label string")

    def rel_table(self, types: str | Iterable[str] | None = None) -> DataFrame:
        """id, src, dst, label (the type) and all properties of the types; no type reads all tables."""
        parts = [self.rels[n].withColumn("label", F.lit(n)) for n in self.types(types)]
        return union_all(parts) if parts else self.spark.createDataFrame([], "id long, src long, dst long, label string")

    def end_labels(self, types: str | Iterable[str] | None, end: int) -> list[str] | None:
        """Labels that nodes at an end (0: source) of the types can have, or None if that is not known."""
        names = self.types(types)
        return sorted({self.ends[n][end] for n in names}) if names and all(n in self.ends for n in names) else None

    # lookups, statistics and the index catalog

    def node(self, node_id: int) -> dict:
        """Label and properties of one node."""
        row = self.node_table().where(F.col("id") == node_id).head()
        if row is None:
            raise UnknownId(f"no node {node_id}")
        return {k: v for k, v in row.asDict().items() if v is not None}

    def relationship(self, rel_id: int) -> dict:
        row = self.rel_table().where(F.col("id") == rel_id).head()
        if row is None:
            raise UnknownId(f"no relationship {rel_id}")
        return {k: v for k, v in row.asDict().items() if v is not None}

    def stats(self) -> DataFrame:
        """Kind, label and number of rows of each table."""
        parts = [t.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(kind).alias("kind"), F.lit(name).alias("label"), "rows") for kind, tables in (("node", self.nodes), ("relationship", self.rels)) for name, t in sorted(tables.items())]
        return union_all(parts)

    def nodes_with(self, key: str, predicate) -> DataFrame:
        """Nodes of any label that have the property and satisfy ``predicate(column)``."""
        having = [n for n in self.labels(None) if key in self.nodes[n].columns]
        return self.node_table(having).where(F.col(key).isNotNull() & predicate(F.col(key))) if having else self.node_table([])

    def create_index(self, label: str, key: str) -> "PropertyGraph":
        return replace(self, indexes=self.indexes | {(label, key)})

    def drop_index(self, label: str, key: str) -> "PropertyGraph":
        return replace(self, indexes=self.indexes - {(label, key)})

    def has_index(self, label: str, key: str) -> bool:
        return (label, key) in self.indexes

    def with_nodes(self, **tables: DataFrame) -> "PropertyGraph":
        return replace(self, nodes=self.nodes | tables)

    def with_rels(self, **tables: DataFrame) -> "PropertyGraph":
        return replace(self, rels=self.rels | tables)


def node_struct(table: DataFrame) -> Column:
    return F.struct("id", "label", *(c for c in table.columns if c not in ("id", "label")))


def rel_struct(table: DataFrame) -> Column:
    return F.struct("id", "label", "src", "dst", *(c for c in table.columns if c not in ("id", "label", "src", "dst")))


class Session:
    """A graph that changes by transactions: begin keeps a snapshot, commit publishes, abort forgets."""

    def __init__(self, graph: PropertyGraph):
        self.graph, self._kept = graph, []

    def begin(self) -> PropertyGraph:
        self._kept.append(self.graph)
        return self.graph

    def update(self, graph: PropertyGraph) -> None:
        self.graph = graph

    def commit(self) -> PropertyGraph:
        self._kept.pop()
        return self.graph

    def abort(self) -> PropertyGraph:
        self.graph = self._kept.pop()
        return self.graph

    def run(self, change) -> PropertyGraph:
        """Apply ``change(graph) -> graph`` as one transaction; an error leaves the graph as it was."""
        self.begin()
        try:
            self.update(change(self.graph))
        except BaseException:
            self.abort()
            raise
        return self.commit()
