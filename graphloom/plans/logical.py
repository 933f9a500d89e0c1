"""Logical operators.  Each names its input plans first; ``lower`` in operators turns a tree into a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Plan:
    pass


@dataclass(frozen=True)
class NodeScan(Plan):
    labels: tuple[str, ...] | None = None
    ids: tuple[int, int] | None = None


@dataclass(frozen=True)
class IndexScan(Plan):
    labels: tuple[str, ...]
    key: str
    value: Any
    unique: bool = False


@dataclass(frozen=True)
class RelScan(Plan):
    types: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Foreach(Plan):
    """``low``/``high`` make it a walk of variable length; high None is unbounded."""

    child: Plan
    direction: str
    type: str | None
    low: int | None = None
    high: int | None = None
    pos: int = -1


@dataclass(frozen=True)
class Expand(Plan):
    child: Plan
    direction: str
    labels: tuple[str, ...] | None = None


@dataclass(frozen=True)
class HasLabel(Plan):
    child: Plan
    labels: tuple[str, ...]
    pos: int = -1


@dataclass(frozen=True)
class Filter(Plan):
    """``expr`` is an expression, or a function from the environment to a column."""

    child: Plan
    expr: Any


@dataclass(frozen=True)
class Project(Plan):
    child: Plan
    items: tuple


@dataclass(frozen=True)
class Limit(Plan):
    child: Plan
    n: int


@dataclass(frozen=True)
class Distinct(Plan):
    child: Plan


@dataclass(frozen=True)
class Sort(Plan):
    """``keys``: (expression, descending)."""

    child: Plan
    keys: tuple


@dataclass(frozen=True)
class Union(Plan):
    children: tuple[Plan, ...]


@dataclass(frozen=True)
class Join(Plan):
    """``how``: cross, inner or left.  ``cond`` counts the right side's bindings after the left side's."""

    left: Plan
    right: Plan
    how: str
    cond: Any = None
    hint: str | None = None


@dataclass(frozen=True)
class Aggregate(Plan):
    """``aggs``: (function, Var or None)."""

    child: Plan
    aggs: tuple


@dataclass(frozen=True)
class GroupBy(Plan):
    child: Plan
    keys: tuple
    aggs: tuple


@dataclass(frozen=True)
class CreateNode(Plan):
    label: str
    props: dict = field(hash=False)
    child: Plan | None = None


@dataclass(frozen=True)
class CreateRel(Plan):
    child: Plan
    src: int
    dst: int
    type: str
    props: dict = field(hash=False)


@dataclass(frozen=True)
class UpdateNode(Plan):
    child: Plan
    pos: int
    props: dict = field(hash=False)


@dataclass(frozen=True)
class Remove(Plan):
    """``what``: node, detach or rel."""

    child: Plan
    what: str
    pos: int = -1


@dataclass(frozen=True)
class Algorithm(Plan):
    child: Plan
    name: str
    mode: str
    args: tuple = ()


def children(plan: Plan) -> list[Plan]:
    if isinstance(plan, Union):
        return list(plan.children)
    return [p for p in (getattr(plan, n, None) for n in ("child", "left", "right")) if isinstance(p, Plan)]


def describe(plan: Plan, depth: int = 0) -> str:
    """The operator tree, one line each."""
    own = {k: v for k, v in vars(plan).items() if not isinstance(v, Plan) and k != "children" and v is not None}
    line = "  " * depth + type(plan).__name__ + "(" + ", ".join(f"{k}={v}" for k, v in own.items()) + ")"
    return "\n".join([line, *(describe(c, depth + 1) for c in children(plan))])
