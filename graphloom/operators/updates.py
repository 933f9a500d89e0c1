"""Updates as new snapshots of the graph.

``apply`` returns a graph whose changed tables are plans over the old ones.  New ids follow the largest id of their
kind; they are numbered by partition-wise counting, not in one task.
"""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.errors import OrphanedRelationship, QueryProcessingError
from graphloom.graph import REL_KEYS, PropertyGraph, union_all
from graphloom.operators.lower import Lowering
from graphloom.plans import logical as L
from graphloom.plans.parser import parse
from graphloom.storage import materialise


def _literal(value: Any) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _next_id(tables: dict[str, DataFrame]) -> int:
    top = union_all([t.select("id") for t in tables.values()]).agg(F.max("id")).first()[0] if tables else None
    return 0 if top is None else top + 1


def numbered(df: DataFrame, first: int, name: str) -> DataFrame:
    """``df`` computed once, with distinct ids from ``first`` on (gaps between partitions)."""
    return materialise(df.withColumn(name, F.monotonically_increasing_id() + first))


def created_nodes(low: Lowering, p: L.CreateNode) -> DataFrame:
    """The input with a new node for each row, or one node without input."""
    df = low.lower(p.child) if p.child else low.graph.spark.range(1)
    df = numbered(df, _next_id(low.graph.nodes), "__id")
    node = F.struct(F.col("__id").alias("id"), F.lit(p.label).alias("label"), *(_literal(v).alias(k) for k, v in p.props.items() if k != "id"), *([_literal(p.props["id"]).alias("own_id")] if "id" in p.props else []))
    return df.select(node.alias("_0")) if p.child is None else df.withColumn(f"_{len(df.columns) - 1}", node).drop("__id")


def created_rels(low: Lowering, p: L.CreateRel) -> DataFrame:
    df = low.lower(p.child)
    env = low.env(df)
    n = len(df.columns)
    src, dst = env.ident(p.src), env.ident(p.dst)
    df = numbered(df, _next_id(low.graph.rels), "__id")
    rel = F.struct(F.col("__id").alias("id"), F.lit(p.type).alias("label"), src.alias("src"), dst.alias("dst"), *(_literal(v).alias(k) for k, v in p.props.items()))
    return df.withColumn(f"_{n}", rel).drop("__id")


def _unpacked(df: DataFrame, at: str) -> DataFrame:
    return df.select(f"{at}.*").drop("label")


def _added(tables: dict[str, DataFrame], name: str, new: DataFrame) -> dict[str, DataFrame]:
    return tables | {name: tables[name].unionByName(new, allowMissingColumns=True) if name in tables else new}


def add_nodes(graph: PropertyGraph, label: str, rows: DataFrame) -> PropertyGraph:
    """``rows`` has id and properties."""
    return replace(graph, nodes=_added(graph.nodes, label, rows))


def add_rels(graph: PropertyGraph, type_: str, rows: DataFrame) -> PropertyGraph:
    return replace(graph, rels=_added(graph.rels, type_, rows), ends={k: v for k, v in graph.ends.items() if k != type_})


def _merged(table: DataFrame, ids: DataFrame, props: dict[str, Any]) -> DataFrame:
    hit = F.col("__hit").isNotNull()
    kinds = {f.name: f.dataType for f in table.schema.fields}
    out = table.join(ids.select(F.col("id").alias("__id"), F.lit(True).alias("__hit")).distinct(), table["id"] == F.col("__id"), "left")
    for k, v in props.items():
        old = F.col(k) if k in kinds else F.lit(None)
        new = _literal(v).cast(kinds[k]) if k in kinds else _literal(v)
        out = out.withColumn(k, F.when(hit, new).otherwise(old))
    return out.drop("__id", "__hit")


def update_nodes(graph: PropertyGraph, ids: DataFrame, props: dict[str, Any], labels=None) -> PropertyGraph:
    """Merge ``props`` into the nodes whose id is in ``ids`` (column id)."""
    return replace(graph, nodes=graph.nodes | {n: _merged(graph.nodes[n], ids, props) for n in graph.labels(labels)})


def update_rels(graph: PropertyGraph, ids: DataFrame, props: dict[str, Any], types=None, new_type: str | None = None) -> PropertyGraph:
    names = graph.types(types)
    graph = replace(graph, rels=graph.rels | {n: _merged(graph.rels[n], ids, props) for n in names})
    for n in [n for n in names if new_type and n != new_type]:
        moved = graph.rels[n].join(ids.select("id").distinct(), "id", "left_semi")
        graph = add_rels(replace(graph, rels=graph.rels | {n: graph.rels[n].join(ids.select("id").distinct(), "id", "left_anti")}), new_type, moved)
    return graph


def relabel(graph: PropertyGraph, ids: DataFrame, label: str, props: dict[str, Any] | None = None) -> PropertyGraph:
    """Move nodes to another label; relationships keep their ends, whose labels are then no longer known."""
    graph = update_nodes(graph, ids, props) if props else graph
    ids = ids.select("id").distinct()
    for n in [n for n in graph.labels(None) if n != label]:
        moved = graph.nodes[n].join(ids, "id", "left_semi")
        graph = add_nodes(replace(graph, nodes=graph.nodes | {n: graph.nodes[n].join(ids, "id", "left_anti")}), label, moved)
    return replace(graph, ends={})


def attached(graph: PropertyGraph, ids: DataFrame) -> DataFrame:
    rels = graph.rel_table().select("id", "src", "dst")
    return rels.join(ids.select(F.col("id").alias("src")).distinct(), "src", "left_semi").unionByName(rels.join(ids.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select("id", "src", "dst"))


def remove_nodes(graph: PropertyGraph, ids: DataFrame, detach: bool = False) -> PropertyGraph:
    """Without ``detach`` the whole update fails if a relationship hangs on any of the nodes."""
    ids = ids.select("id").distinct()
    rels = graph.rels
    if detach:
        by = lambda k: ids.select(F.col("id").alias(k))
        rels = {n: t.join(by("src"), "src", "left_anti").join(by("dst"), "dst", "left_anti").select(*t.columns) for n, t in rels.items()}
    elif not attached(graph, ids).isEmpty():
        raise OrphanedRelationship("a node still has relationships")
    return replace(graph, nodes={n: t.join(ids, "id", "left_anti").select(*t.columns) for n, t in graph.nodes.items()}, rels=rels)


def remove_rels(graph: PropertyGraph, keys: DataFrame, types=None) -> PropertyGraph:
    """``keys`` has id, or src and dst, or all three: what it has must match."""
    on = [k for k in REL_KEYS if k in keys.columns]
    keys = keys.select(*on).distinct()
    return replace(graph, rels=graph.rels | {n: graph.rels[n].join(keys, on, "left_anti").select(*graph.rels[n].columns) for n in graph.types(types)})


def created(graph: PropertyGraph, plan: L.Plan | str, params: dict[str, Any] | None = None) -> tuple[PropertyGraph, DataFrame]:
    """The graph after a plan that creates, and the ids (column id) of what it created: their only sure names."""
    plan = parse(plan) if isinstance(plan, str) else plan
    low = Lowering(graph, params or {})
    if not isinstance(plan, (L.CreateNode, L.CreateRel)):
        raise QueryProcessingError(f"{type(plan).__name__} creates nothing")
    rows = created_nodes(low, plan) if isinstance(plan, L.CreateNode) else created_rels(low, plan)
    rows = _unpacked(rows, rows.columns[-1])
    return add_nodes(graph, plan.label, rows) if isinstance(plan, L.CreateNode) else add_rels(graph, plan.type, rows), rows.select("id")


def apply(graph: PropertyGraph, plan: L.Plan | str, params: dict[str, Any] | None = None) -> PropertyGraph:
    """The graph after an update plan."""
    plan = parse(plan) if isinstance(plan, str) else plan
    if isinstance(plan, (L.CreateNode, L.CreateRel)):
        return created(graph, plan, params)[0]
    low = Lowering(graph, params or {})
    if not isinstance(plan, (L.UpdateNode, L.Remove)):
        raise QueryProcessingError(f"{type(plan).__name__} changes nothing")
    df = low.lower(plan.child)
    env = low.env(df)
    kind = df.schema.fields[env.index(plan.pos)].dataType
    if not isinstance(kind, T.StructType):
        raise QueryProcessingError("only nodes and relationships can be changed")
    ids = df.select(env.ident(plan.pos).alias("id"))
    if isinstance(plan, L.UpdateNode):
        return update_nodes(graph, ids, plan.props)
    if plan.what == "rel":
        b = env.binding(plan.pos)
        return remove_rels(graph, df.select(b.getField("id").alias("id"), b.getField("src").alias("src"), b.getField("dst").alias("dst")))
    return remove_nodes(graph, ids, plan.what == "detach")
