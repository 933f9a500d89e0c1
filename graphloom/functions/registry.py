"""Functions that queries call by name, and algorithms that they name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column

from graphloom.errors import UdfNotFound
from graphloom.functions.builtins import BUILTINS
from graphloom.functions.stringify import stringify

_UDFS: dict[str, Callable[..., Column]] = {}
_ALGORITHMS: dict[tuple[str, str], Callable] = {}


def register_udf(name: str, fn: Callable[..., Column]) -> None:
    """``fn`` takes and returns columns: a built-in expression or a pandas UDF."""
    _UDFS[name] = fn


def load_library(module) -> None:
    """Register every public callable of a module."""
    for name in dir(module):
        if not name.startswith("_") and callable(getattr(module, name)):
            register_udf(name, getattr(module, name))


def call(space: str, name: str, args: list[Column]) -> Column:
    if space == "pb":
        if name == "string_rep":
            return stringify(*args)
        if name in BUILTINS:
            return BUILTINS[name](*args)
    elif name in _UDFS:
        return _UDFS[name](*args)
    raise UdfNotFound(f"{space}::{name}")


def register_algorithm(name: str, mode: str, fn: Callable) -> None:
    """``fn(graph, df, env, *args) -> df``; mode is TUPLE (keeps the input's columns) or SET."""
    _ALGORITHMS[name, mode] = fn


def algorithm(name: str, mode: str) -> Callable:
    if (name, mode) not in _ALGORITHMS:
        raise UdfNotFound(f"algorithm {name} in mode {mode}")
    return _ALGORITHMS[name, mode]
