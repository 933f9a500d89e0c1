"""Expressions over bindings and their translation to columns."""

from __future__ import annotations

import datetime
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.errors import QueryProcessingError
from graphloom.functions import registry

#: Declared types of the query language.
TYPES = {"int": "int", "uint64": "bigint", "double": "double", "string": "string", "datetime": "timestamp_ntz"}


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Var:
    """``$i`` or ``$i.key``; -1 is the last binding."""

    index: int
    key: str | None = None
    type: str | None = None


@dataclass(frozen=True)
class Param:
    """A named value that is filled in when the query runs."""

    name: str


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Call:
    """``pb::name(...)`` or ``udf::name(...)``."""

    space: str
    name: str
    args: tuple


BINARY = {
    "||": lambda a, b: a | b, "&&": lambda a, b: a & b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b, "%": lambda a, b: a % b,
}


class Env:
    """Bindings of a plan: their columns and Spark types."""

    def __init__(self, schema: T.StructType, params: dict[str, Any] | None = None):
        self.types = [f.dataType for f in schema.fields]
        self.params = params or {}

    def index(self, i: int) -> int:
        j = i if i >= 0 else len(self.types) + i
        if not 0 <= j < len(self.types):
            raise QueryProcessingError(f"${i} is not bound; there are {len(self.types)} bindings")
        return j

    def is_struct(self, i: int) -> bool:
        return isinstance(self.types[self.index(i)], T.StructType)

    def is_rel(self, i: int) -> bool:
        return self.is_struct(i) and "src" in self.types[self.index(i)].names

    def binding(self, i: int) -> Column:
        return F.col(f"_{self.index(i)}")

    def prop(self, i: int, key: str) -> Column:
        """A property, or null where no table of the binding has it."""
        j = self.index(i)
        if not self.is_struct(j):
            raise QueryProcessingError(f"${j} is a value and has no property {key}")
        return F.col(f"_{j}").getField(key) if key in self.types[j].names else F.lit(None)

    def ident(self, i: int) -> Column:
        return self.prop(i, "id") if self.is_struct(i) else self.binding(i)

    def column(self, e) -> Column:
        if isinstance(e, Lit):
            return F.lit(e.value).cast("timestamp_ntz") if isinstance(e.value, datetime.datetime) else F.lit(e.value)
        if isinstance(e, Param):
            if e.name not in self.params:
                raise QueryProcessingError(f"no value for parameter {e.name}")
            return F.lit(self.params[e.name])
        if isinstance(e, Var):
            return self.value(e)
        if isinstance(e, Op):
            if e.op == "!":
                return ~self.column(e.args[0])
            return BINARY[e.op](*map(self.operand, e.args))
        if isinstance(e, Call):
            return registry.call(e.space, e.name, [self.argument(a) for a in e.args])
        raise QueryProcessingError(f"not an expression: {e}")

    def operand(self, e) -> Column:
        """Nodes and relationships compare by identity."""
        return self.ident(e.index) if isinstance(e, Var) and e.key is None else self.column(e)

    def argument(self, e) -> Column:
        if isinstance(e, Var) and e.key is None and self.is_struct(e.index):
            return self.binding(e.index)
        return self.column(e)

    def value(self, e: Var) -> Column:
        """A binding or property, cast to its declared type; what does not fit becomes null."""
        col = self.binding(e.index) if e.key is None else self.prop(e.index, e.key)
        if e.type in (None, "qresult"):
            return col
        if e.type not in TYPES:
            raise QueryProcessingError(f"unknown type {e.type}")
        if e.key is None and self.is_struct(e.index):
            return col
        return col.try_cast(TYPES[e.type]) if e.type != "datetime" else col.cast(TYPES[e.type])
