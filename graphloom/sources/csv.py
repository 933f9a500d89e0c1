"""CSV importers: nodes and relationships in the two layouts that are common for graphs.

All columns are read as text.  Typed importers look at the first non-empty value of each column and cast by it; a value
that does not fit becomes null.  Empty cells are null.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.errors import QueryProcessingError
from graphloom.graph import PropertyGraph
from graphloom.operators.updates import add_nodes, add_rels

#: First match decides; whole numbers with leading zeros stay text, years lie in 1970 to 2099.
KINDS = (
    ("int", r"^(-?[1-9][0-9]*|0)$"), ("double", r"^-?[0-9]+\.[0-9]+$"), ("date", r"^(19[7-9][0-9]|20[0-9][0-9])-[01][0-9]-[0-3][0-9]$"),
    ("datetime", r"^(19[7-9][0-9]|20[0-9][0-9])-[01][0-9]-[0-3][0-9]T[0-2][0-9]:[0-5][0-9]:[0-5][0-9]\.[0-9]{3}\+[0-9]{4}$"),
)
LONG_COLUMNS = {"id", "phone"}


def read_text(spark: SparkSession, path: str, sep: str) -> DataFrame:
    return spark.read.csv(path, header=True, sep=sep, quote='"', escape='"', inferSchema=False, encoding="UTF-8")


def typed(df: DataFrame, skip: set[str] = frozenset()) -> DataFrame:
    """Columns cast by the kind of their first non-empty value (one aggregation over all columns)."""
    names = [c for c in df.columns if c not in skip]
    if not names:
        return df
    # the first value by file order: offsets of partitions rise with the file
    first = df.withColumn("__n", F.monotonically_increasing_id()).agg(*(F.min_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`") != "", F.col("__n"))).alias(c) for c in names)).first()
    out = df
    for c in names:
        value = first[c] or ""
        kind = next((k for k, p in KINDS if re.match(p, value)), "string")
        col = F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`"))
        if c in LONG_COLUMNS and kind == "int":
            col = col.try_cast("bigint")
        elif kind in ("int", "double"):
            col = col.try_cast("bigint" if kind == "int" and abs(int(value)) > 2**31 - 1 else kind)
        elif kind == "date":
            col = F.try_to_timestamp(col, F.lit("yyyy-MM-dd")).cast("timestamp_ntz")
        elif kind == "datetime":  # the zone is cut off
            col = F.try_to_timestamp(F.substring(col, 1, 23), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS")).cast("timestamp_ntz")
        out = out.withColumn(c, col)
    return out


def node_ids(label: str, key: DataFrame | str):
    """A stable id from label and key, so that relationships find their ends without a map in memory."""
    return F.xxhash64(F.lit(label), F.col(f"`{key}`").cast("string"))


def import_nodes(graph: PropertyGraph, label: str, path: str, sep: str = "|", strict: bool = True) -> PropertyGraph:
    """One header line; the column ``id`` is the key; ``strict`` infers types, else all properties stay text."""
    raw = read_text(graph.spark, path, sep)
    if "id" not in raw.columns:
        raise QueryProcessingError(f"{path} has no column id")
    props = typed(raw) if strict else raw.select(*(F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`")).cast("bigint" if c == "id" else "string").alias(c) for c in raw.columns))
    out = props.withColumnRenamed("id", "own_id")
    return add_nodes(graph, label, out.select(node_ids(label, "own_id").alias("id"), *out.columns))


def import_relationships(graph: PropertyGraph, path: str, sep: str = "|", strict: bool = True) -> PropertyGraph:
    """The file name says src_TYPE_dst; the first two columns are the ends; rows with an unknown end are left out."""
    src, type_, dst = os.path.basename(path).split(".")[0].split("_")[:3]
    labels = [x[:1].upper() + x[1:] for x in (src, dst)]
    raw = read_text(graph.spark, path, sep)
    raw = raw.toDF("__a", "__b", *raw.columns[2:])
    props = typed(raw, {"__a", "__b"}) if strict else raw
    return add_rels(graph, type_, _linked(graph, props, labels, [c for c in props.columns if c not in ("__a", "__b")]))


def _linked(graph: PropertyGraph, df: DataFrame, labels: list[str], props: list[str]) -> DataFrame:
    ends = [graph.nodes[n].select(F.col("id").alias(k)) for n, k in zip(labels, ("src", "dst"))]
    named = df.select(node_ids(labels[0], "__a").alias("src"), node_ids(labels[1], "__b").alias("dst"), *props)
    # by source last: rows lie as a hop from their sources needs them
    return named.join(ends[1], "dst", "left_semi").join(ends[0], "src", "left_semi").select(F.xxhash64("src", "dst", *props).alias("id"), "src", "dst", *props)


def import_neo_nodes(graph: PropertyGraph, label: str, path: str, sep: str = ",") -> PropertyGraph:
    """A header with one ``name:ID`` column, whose values are the keys that relationships use."""
    raw = read_text(graph.spark, path, sep)
    key = next((c for c in raw.columns if c.endswith(":ID")), None)
    if key is None:
        raise QueryProcessingError(f"{path} has no :ID column")
    plain = raw.toDF(*(c.split(":")[0] or "key" for c in raw.columns))
    name = key.split(":")[0] or "key"
    ids = plain.withColumn("__id", F.xxhash64(F.col(f"`{name}`")))
    out = typed(ids, {"__id"})
    out = out.withColumnRenamed("id", "own_id") if "id" in out.columns else out
    return add_nodes(graph, label, out.select(F.col("__id").alias("id"), *(c for c in out.columns if c != "__id")))


def import_neo_relationships(graph: PropertyGraph, path: str, type_: str | None = None, sep: str = ",") -> PropertyGraph:
    """``:START_ID,:END_ID`` and ``:TYPE`` unless the caller names the type; rows with an unknown end are left out."""
    raw = read_text(graph.spark, path, sep)
    props = [c for c in raw.columns if not c.startswith(":")]
    ids = graph.node_table().select("id")
    if type_ is None and ":TYPE" not in raw.columns:
        raise QueryProcessingError(f"{path} has no :TYPE column")
    named = raw.select(F.xxhash64(F.col("`:START_ID`")).alias("src"), F.xxhash64(F.col("`:END_ID`")).alias("dst"), (F.lit(type_) if type_ else F.col("`:TYPE`")).alias("__type"), *props)
    named = typed(named, {"src", "dst", "__type"})

    def linked(rows: DataFrame) -> DataFrame:  # by source last: rows lie as a hop from their sources needs them
        return rows.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").join(ids.withColumnRenamed("id", "src"), "src", "left_semi")

    types = [type_] if type_ else _linked_types(named, ids, linked)
    named = linked(named)
    for t in types:
        graph = add_rels(graph, t, named.where(F.col("__type") == t).select(F.xxhash64("src", "dst", *props).alias("id"), "src", "dst", *props))
    return graph


def _linked_types(named: DataFrame, ids: DataFrame, linked) -> list[str]:
    """Types with a row whose ends are both known (a schema's worth of names).

    Two rows of each type are tried first, against nodes that stay where they are; only types that fail take the join of
    all their rows.
    """
    tries = named.groupBy("__type").agg(F.array(F.min(F.struct("src", "dst")), F.max(F.struct("src", "dst"))).alias("rows"))
    tries = [(r["__type"], e.src, e.dst) for r in tries.collect() for e in r["rows"] if e is not None]
    ends = sorted({x for _, src, dst in tries for x in (src, dst)})
    known = {r.id for r in ids.join(F.broadcast(named.sparkSession.createDataFrame([(x,) for x in ends], "id long")), "id", "left_semi").distinct().collect()}
    names = {t for t, src, dst in tries if src in known and dst in known}
    rest = sorted({t for t, _, _ in tries if t is not None} - names)
    return sorted(names | ({r[0] for r in linked(named.where(F.col("__type").isin(rest))).select("__type").distinct().collect()} if rest else set()))
