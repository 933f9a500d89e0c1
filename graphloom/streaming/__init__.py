"""Row-wise operators over a stream of relationships or nodes.

The engine's operators that need no state (filter, projection, one-hop expansion to stored nodes) run unchanged on a
streaming table; a graph whose table for one label or type is a stream gives streaming results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from graphloom.graph import PropertyGraph


def with_stream(graph: PropertyGraph, type_: str, stream: DataFrame) -> PropertyGraph:
    """``graph`` in which relationships of ``type_`` arrive from a stream with the table's columns."""
    return graph.with_rels(**{type_: stream})
