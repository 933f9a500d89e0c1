"""Logical plans to DataFrames.  Binding i is column ``_i``: a struct for a node or relationship, else a value."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.errors import QueryProcessingError, UnknownIndex
from graphloom.functions import registry
from graphloom.graph import PropertyGraph, node_struct, rel_struct, union_all
from graphloom.operators import algorithms, traverse  # noqa: F401  (algorithms register themselves)
from graphloom.plans import logical as L
from graphloom.plans.expr import Env, Var
from graphloom.plans.parser import parse


def run(graph: PropertyGraph, plan: L.Plan | str, params: dict[str, Any] | None = None) -> DataFrame:
    """The result of a plan or query text, one column for each binding."""
    return Lowering(graph, params or {}).lower(parse(plan) if isinstance(plan, str) else plan)


class Lowering:
    def __init__(self, graph: PropertyGraph, params: dict[str, Any]):
        self.graph, self.params = graph, params

    def env(self, df: DataFrame) -> Env:
        return Env(df.schema, self.params)

    def lower(self, plan: L.Plan) -> DataFrame:
        return getattr(self, f"do_{type(plan).__name__.lower()}")(plan)

    def column(self, env: Env, e) -> Column:
        return e(env) if callable(e) else env.column(e)

    # scans

    def nodes(self, labels) -> DataFrame:
        table = self.graph.node_table(labels)
        return table.select(node_struct(table).alias("_0"))

    def do_nodescan(self, p: L.NodeScan) -> DataFrame:
        df = self.nodes(p.labels)
        return df.where(F.col("_0.id").between(*p.ids)) if p.ids else df

    def do_indexscan(self, p: L.IndexScan) -> DataFrame:
        for label in p.labels:
            if not self.graph.has_index(label, p.key):
                raise UnknownIndex(f"{label}.{p.key}")
        hits = [self.nodes([label]).where(F.col("_0").getField(p.key) == F.lit(p.value)) for label in p.labels]
        if len(hits) == 1:
            return hits[0].limit(1) if p.unique else hits[0]
        # the first label with a hit wins
        ranked = union_all([h.withColumn("__rank", F.lit(i)) for i, h in enumerate(self._padded(p.labels, hits))])
        return ranked.orderBy("__rank").limit(1).drop("__rank")

    def _padded(self, labels, hits: list[DataFrame]) -> list[DataFrame]:
        """Structs of different labels with one set of fields."""
        full = self.graph.node_table(labels).schema
        names = ["id", "label", *(f.name for f in full.fields if f.name not in ("id", "label"))]
        kinds = {f.name: f.dataType for f in full.fields}
        return [h.select(F.struct(*((F.col("_0").getField(n) if n in h.schema["_0"].dataType.names else F.lit(None).cast(kinds[n])).alias(n) for n in names)).alias("_0")) for h in hits]

    def do_relscan(self, p: L.RelScan) -> DataFrame:
        table = self.graph.rel_table(p.types)
        return table.select(rel_struct(table).alias("_0"))

    # traversal

    def do_foreach(self, p: L.Foreach) -> DataFrame:
        df = self.lower(p.child)
        env = self.env(df)
        if not env.is_struct(p.pos) or env.is_rel(p.pos):
            raise QueryProcessingError("relationships are followed from a node")
        return traverse.foreach(self.graph, df, env.ident(p.pos), p.direction, p.type, p.low, p.high, len(df.columns))

    def do_expand(self, p: L.Expand) -> DataFrame:
        df = self.lower(p.child)
        if not self.env(df).is_rel(-1):
            raise QueryProcessingError("Expand needs a relationship as the last binding")
        types = p.child.type if isinstance(p.child, L.Foreach) else None
        return traverse.expand(self.graph, df, df.columns[-1], p.direction, p.labels, types, len(df.columns))

    def do_haslabel(self, p: L.HasLabel) -> DataFrame:
        df = self.lower(p.child)
        return df.where(self.env(df).prop(p.pos, "label").isin(*p.labels))

    # filters, projection, order

    def do_filter(self, p: L.Filter) -> DataFrame:
        df = self.lower(p.child)
        return df.where(self.column(self.env(df), p.expr))

    def do_project(self, p: L.Project) -> DataFrame:
        df = self.lower(p.child)
        env = self.env(df)
        return df.select(*(self.column(env, e).alias(f"_{i}") for i, e in enumerate(p.items)))

    def do_limit(self, p: L.Limit) -> DataFrame:
        return self.lower(p.child).limit(p.n)

    def do_distinct(self, p: L.Distinct) -> DataFrame:
        return self.lower(p.child).distinct()

    def do_sort(self, p: L.Sort) -> DataFrame:
        df = self.lower(p.child)
        env = self.env(df)
        keys = [env.operand(e) if isinstance(e, Var) and e.key is None else self.column(env, e) for e, _ in p.keys]
        return df.orderBy(*(k.desc() if down else k.asc() for k, (_, down) in zip(keys, p.keys)))

    def do_union(self, p: L.Union) -> DataFrame:
        parts = [self.lower(c) for c in p.children]
        if len({len(x.columns) for x in parts}) > 1:
            raise QueryProcessingError("the inputs of Union differ in their number of bindings")
        return union_all(self._aligned(parts))

    def _aligned(self, parts: list[DataFrame]) -> list[DataFrame]:
        """Struct bindings get the fields of all inputs."""
        for i in range(len(parts[0].columns)):
            kinds = [x.schema.fields[i].dataType for x in parts]
            if all(isinstance(k, T.StructType) for k in kinds) and len({tuple(k.names) for k in kinds}) > 1:
                fields = {f.name: f.dataType for k in kinds for f in k.fields}
                col = F.col(f"_{i}")
                parts = [
                    x.withColumn(f"_{i}", F.struct(*((col.getField(n) if n in k.names else F.lit(None)).cast(t).alias(n) for n, t in fields.items())))
                    for x, k in zip(parts, kinds)
                ]
        return parts

    # joins

    def do_join(self, p: L.Join) -> DataFrame:
        left, right = self.lower(p.left), self.lower(p.right)
        n = len(left.columns)
        right = right.toDF(*(f"_{n + i}" for i in range(len(right.columns))))
        if p.how == "cross":
            return left.crossJoin(right)
        env = Env(T.StructType(left.schema.fields + right.schema.fields), self.params)
        if isinstance(p.cond, tuple) and p.cond[0] == "connected":
            _, i, j, type_ = p.cond
            links = self.graph.rel_table(type_).select(F.col("src").alias("__src"), F.col("dst").alias("__dst")).distinct()
            right = right.join(links, env.ident(n + j) == F.col("__dst"))
            return left.join(right, env.ident(i) == F.col("__src"), "left").drop("__src", "__dst")
        cond = env.ident(p.cond[1]) == env.ident(n + p.cond[2]) if isinstance(p.cond, tuple) else self.column(env, p.cond)
        return left.join(right.hint(p.hint) if p.hint else right, cond, p.how)

    # aggregation

    def agg(self, env: Env, func: str, arg) -> Column:
        """count counts rows; sum and avg read a missing value as 0; min and max skip it."""
        if func in ("count", "pcount"):
            return F.count(F.lit(1))
        x = self.column(env, arg)
        if func == "sum":
            return F.sum(F.coalesce(x, F.lit(0)))
        if func == "avg":
            return F.avg(F.coalesce(x, F.lit(0)).cast("double"))
        return {"min": F.min, "max": F.max}[func](x)

    def do_aggregate(self, p: L.Aggregate) -> DataFrame:
        df = self.lower(p.child)
        env = self.env(df)
        out = df.agg(*(self.agg(env, f, a).alias(f"_{i}") for i, (f, a) in enumerate(p.aggs)))
        return out.select(*(F.when(F.lit(f == "pcount"), F.lit(100.0)).otherwise(F.col(f"_{i}")).alias(f"_{i}") if f == "pcount" else f"_{i}" for i, (f, _) in enumerate(p.aggs)))

    def do_groupby(self, p: L.GroupBy) -> DataFrame:
        df = self.lower(p.child)
        env = self.env(df)
        n = len(p.keys)
        keys = [(env.operand(k) if isinstance(k, Var) and k.key is None else self.column(env, k)).alias(f"_{i}") for i, k in enumerate(p.keys)]
        out = df.groupBy(*keys).agg(*(self.agg(env, f, a).alias(f"_{n + i}") for i, (f, a) in enumerate(p.aggs)))
        shares = [n + i for i, (f, _) in enumerate(p.aggs) if f == "pcount"]
        if shares:
            total = F.broadcast(out.agg(F.sum(f"_{shares[0]}").alias("__total")))  # one row
            out = out.crossJoin(total)
            out = out.select(*((F.col(c) * 100.0 / F.col("__total")).alias(c) if c in {f"_{i}" for i in shares} else c for c in out.columns if c != "__total"))
        return out

    # algorithms and updates

    def do_algorithm(self, p: L.Algorithm) -> DataFrame:
        df = self.lower(p.child)
        return registry.algorithm(p.name, p.mode)(self.graph, df, self.env(df), *p.args)

    def do_createnode(self, p: L.CreateNode) -> DataFrame:
        from graphloom.operators.updates import created_nodes

        return created_nodes(self, p)

    def do_createrel(self, p: L.CreateRel) -> DataFrame:
        from graphloom.operators.updates import created_rels

        return created_rels(self, p)

    def do_updatenode(self, p: L.UpdateNode) -> DataFrame:
        df = self.lower(p.child)
        col, kind = self.env(df).binding(p.pos), df.schema.fields[self.env(df).index(p.pos)].dataType
        fields = [F.lit(p.props[n]).alias(n) if n in p.props else col.getField(n).alias(n) for n in kind.names]
        return df.withColumn(f"_{self.env(df).index(p.pos)}", F.struct(*fields, *(F.lit(v).alias(k) for k, v in p.props.items() if k not in kind.names)))

    def do_remove(self, p: L.Remove) -> DataFrame:
        """The input with the removed binding as null."""
        df = self.lower(p.child)
        at = f"_{self.env(df).index(p.pos)}"
        return df.withColumn(at, F.lit(None).cast(df.schema[at].dataType))
