"""The fluent front end; each call returns a new query over the same graph."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame

from graphloom.graph import PropertyGraph
from graphloom.plans import logical as L
from graphloom.plans.expr import Env, Lit, Op, Var


def _labels(labels: str | Iterable[str] | None):
    return None if labels is None else (labels,) if isinstance(labels, str) else tuple(labels)


def var(index: int, key: str | None = None, type: str | None = None) -> Var:
    return Var(index, key, type)


class Query:
    def __init__(self, graph: PropertyGraph, plan: L.Plan | None = None):
        self.graph, self.plan = graph, plan

    def _to(self, plan: L.Plan) -> "Query":
        return Query(self.graph, plan)

    # sources

    def all_nodes(self, labels=None, ids: tuple[int, int] | None = None) -> "Query":
        """``ids`` keeps a range of ids, both ends included."""
        return self._to(L.NodeScan(_labels(labels), ids))

    def nodes_where(self, labels, key: str, predicate: Callable[[Column], Column]) -> "Query":
        return self.all_nodes(labels).property(key, predicate)

    def nodes_where_indexed(self, labels, key: str, value, unique: bool = False) -> "Query":
        return self._to(L.IndexScan(_labels(labels), key, value, unique))

    def relationships_by_label(self, types=None) -> "Query":
        return self._to(L.RelScan(_labels(types)))

    # traversal

    def _foreach(self, direction, type, hops, pos):
        low, high = hops or (None, None)
        return self._to(L.Foreach(self.plan, direction, type, low, high, pos))

    def from_relationships(self, type: str | None = None, hops: tuple[int, int | None] | None = None, pos: int = -1) -> "Query":
        return self._foreach("FROM", type, hops, pos)

    def to_relationships(self, type: str | None = None, hops: tuple[int, int | None] | None = None, pos: int = -1) -> "Query":
        return self._foreach("TO", type, hops, pos)

    def all_relationships(self, type: str | None = None, hops: tuple[int, int | None] | None = None, pos: int = -1) -> "Query":
        return self._foreach("ALL", type, hops, pos)

    def to_node(self, labels=None) -> "Query":
        return self._to(L.Expand(self.plan, "OUT", _labels(labels)))

    def from_node(self, labels=None) -> "Query":
        return self._to(L.Expand(self.plan, "IN", _labels(labels)))

    def has_label(self, labels, pos: int = -1) -> "Query":
        return self._to(L.HasLabel(self.plan, _labels(labels), pos))

    # filters and projection

    def filter(self, expr) -> "Query":
        return self._to(L.Filter(self.plan, expr))

    def where_qr_tuple(self, predicate: Callable[[Env], Column]) -> "Query":
        """``predicate`` gets the environment: ``env.prop(i, key)``, ``env.binding(i)``, ``env.ident(i)``."""
        return self.filter(predicate)

    def property(self, key: str, predicate: Callable[[Column], Column], pos: int = -1) -> "Query":
        return self.filter(lambda env: env.prop(pos, key).isNotNull() & predicate(env.prop(pos, key)))

    def project(self, *items) -> "Query":
        """Expressions, or functions from the environment to a column."""
        return self._to(L.Project(self.plan, items))

    # joins and sets

    def cross_join(self, other: "Query") -> "Query":
        """The other side's bindings come first."""
        return self._to(L.Join(other.plan, self.plan, "cross"))

    def _node_join(self, positions, other):
        left, right = positions
        return self._to(L.Join(self.plan, other.plan, "inner", ("ids", left, right)))

    def nested_loop_join(self, positions: tuple[int, int], other: "Query") -> "Query":
        return self._node_join(positions, other)

    def hash_join(self, positions: tuple[int, int], other: "Query") -> "Query":
        return self._node_join(positions, other)

    def left_outer_join(self, other: "Query", predicate) -> "Query":
        """``predicate``: an expression over both sides' bindings, or a function from the environment to a column."""
        return self._to(L.Join(self.plan, other.plan, "left", predicate))

    def left_outer_connected(self, other: "Query", type: str, left: int, right: int) -> "Query":
        """Left outer join on a relationship of ``type`` from the left side's node to the right side's."""
        return self._to(L.Join(self.plan, other.plan, "left", ("connected", left, right, type)))

    def union_all(self, *others: "Query") -> "Query":
        return self._to(L.Union((self.plan, *(q.plan for q in others))))

    # order, limits, groups

    def orderby(self, *keys) -> "Query":
        """Expressions, or (expression, descending)."""
        return self._to(L.Sort(self.plan, tuple(k if isinstance(k, tuple) else (k, False) for k in keys)))

    def limit(self, n: int) -> "Query":
        return self._to(L.Limit(self.plan, n))

    def distinct(self) -> "Query":
        return self._to(L.Distinct(self.plan))

    def aggr(self, *aggs) -> "Query":
        return self._to(L.Aggregate(self.plan, aggs))

    def count(self) -> "Query":
        return self.aggr(("count", None))

    def groupby(self, keys, aggs) -> "Query":
        return self._to(L.GroupBy(self.plan, tuple(keys), tuple(aggs)))

    # updates and algorithms

    def create(self, label: str, **props) -> "Query":
        return self._to(L.CreateNode(label, props, self.plan))

    def create_rship(self, ends: tuple[int, int], type: str, **props) -> "Query":
        return self._to(L.CreateRel(self.plan, *ends, type, props))

    def update(self, pos: int, **props) -> "Query":
        return self._to(L.UpdateNode(self.plan, pos, props))

    def delete_node(self, pos: int = -1) -> "Query":
        return self._to(L.Remove(self.plan, "node", pos))

    def delete_detach(self, pos: int = -1) -> "Query":
        return self._to(L.Remove(self.plan, "detach", pos))

    def delete_rship(self, pos: int = -1) -> "Query":
        return self._to(L.Remove(self.plan, "rel", pos))

    def algorithm(self, name: str, mode: str = "TUPLE", *args) -> "Query":
        return self._to(L.Algorithm(self.plan, name, mode, args))

    # results

    def df(self, **params) -> DataFrame:
        from graphloom.operators.lower import run

        return run(self.graph, self.plan, params)

    def update_graph(self, **params) -> PropertyGraph:
        from graphloom.operators.updates import apply

        return apply(self.graph, self.plan, params)

    def explain(self, mode: str = "formatted") -> str:
        print(text := L.describe(self.plan))
        self.df().explain(mode)
        return text


def equals(index: int, key: str, value) -> Op:
    return Op("==", (Var(index, key), Lit(value)))
