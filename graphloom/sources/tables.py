"""The star-schema tables as a property graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph

CODE = 1_000_000_000_000
CODES = {"Region": 1, "Nation": 2, "Customer": 3, "Supplier": 4, "Part": 5, "Order": 6, "Event": 7, "Message": 8}


def node_id(label: str, key: Column) -> Column:
    return F.lit(CODES[label] * CODE) + key.cast("long")


def _rel(df: DataFrame, src: Column, dst: Column, **props: Column) -> DataFrame:
    named = [v.alias(k) for k, v in props.items()]
    # a hash of the content names a relationship without a shuffle
    return df.select(F.xxhash64(src, dst, *props.values()).alias("id"), src.alias("src"), dst.alias("dst"), *named)


def from_tables(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    c = F.col

    def nodes(label, table, key, **props):
        return t(table).select(node_id(label, c(key)).alias("id"), c(key).cast("long").alias("key"), *(c(v).alias(k) for k, v in props.items()))

    message_key = c("conv_id") * 1000 + c("turn")
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    follow = t("events").select("event_id", "ts", F.lead("event_id").over(by_user).alias("next"), F.lead("ts").over(by_user).alias("next_ts")).where("next is not null")
    people = t("customer").select(c("c_custkey").alias("k"))
    # the number of customers is read from one aggregate row, joined to each customer
    ring = people.crossJoin(F.broadcast(people.agg(F.count(F.lit(1)).alias("n")))).select("k", F.explode(F.array((7 * c("k") + 1) % c("n"), (13 * c("k") + 3) % c("n"))).alias("to"))
    gap = (F.unix_micros(c("next_ts").cast("timestamp")) - F.unix_micros(c("ts").cast("timestamp"))) / 1e6
    order, part, supplier = node_id("Order", c("l_orderkey")), node_id("Part", c("l_partkey")), node_id("Supplier", c("l_suppkey"))
    line = {"quantity": "l_quantity", "extendedprice": "l_extendedprice", "discount": "l_discount", "tax": "l_tax", "returnflag": "l_returnflag", "linestatus": "l_linestatus", "shipdate": "l_shipdate", "linenumber": "l_linenumber"}
    return PropertyGraph(
        spark,
        {
            "Region": nodes("Region", "region", "r_regionkey", name="r_name"),
            "Nation": nodes("Nation", "nation", "n_nationkey", name="n_name"),
            "Customer": nodes("Customer", "customer", "c_custkey", name="c_name", acctbal="c_acctbal", mktsegment="c_mktsegment"),
            "Supplier": nodes("Supplier", "supplier", "s_suppkey", name="s_name", acctbal="s_acctbal"),
            "Part": nodes("Part", "part", "p_partkey", name="p_name", brand="p_brand", type="p_type", size="p_size", retailprice="p_retailprice"),
            "Order": nodes("Order", "orders", "o_orderkey", status="o_orderstatus", totalprice="o_totalprice", orderdate="o_orderdate", priority="o_orderpriority"),
            "Event": nodes("Event", "events", "event_id", ts="ts", event_type="event_type", value="value"),
            "Message": t("conversations").select(node_id("Message", message_key).alias("id"), message_key.alias("key"), "conv_id", "turn", "role", "text"),
        },
        {
            "isPartOf": _rel(t("nation"), node_id("Nation", c("n_nationkey")), node_id("Region", c("n_regionkey"))),
            "livesIn": _rel(t("customer"), node_id("Customer", c("c_custkey")), node_id("Nation", c("c_nationkey"))),
            "basedIn": _rel(t("supplier"), node_id("Supplier", c("s_suppkey")), node_id("Nation", c("s_nationkey"))),
            "placedBy": _rel(t("orders"), node_id("Order", c("o_orderkey")), node_id("Customer", c("o_custkey")), orderdate=c("o_orderdate")),
            "contains": _rel(t("lineitem"), order, part, **{k: c(v) for k, v in line.items()}),
            "suppliedBy": _rel(t("lineitem"), order, supplier, quantity=c("l_quantity"), extendedprice=c("l_extendedprice"), linenumber=c("l_linenumber")),
            "performedBy": _rel(t("events"), node_id("Event", c("event_id")), node_id("Customer", c("user_id"))),
            "nextEvent": _rel(follow, node_id("Event", c("event_id")), node_id("Event", c("next")), gap=gap),
            "replyOf": _rel(t("conversations").where("turn > 0"), node_id("Message", message_key), node_id("Message", message_key - 1)),
            "knows": _rel(ring, node_id("Customer", c("k")), node_id("Customer", c("to")), weight=((c("k") * 37) % 100 + 1).cast("double")),
        },
        {
            "isPartOf": ("Nation", "Region"), "livesIn": ("Customer", "Nation"), "basedIn": ("Supplier", "Nation"), "placedBy": ("Order", "Customer"), "contains": ("Order", "Part"),
            "suppliedBy": ("Order", "Supplier"), "performedBy": ("Event", "Customer"), "nextEvent": ("Event", "Event"), "replyOf": ("Message", "Message"), "knows": ("Customer", "Customer"),
        },
    )


def from_rows(spark: SparkSession, nodes: dict[str, tuple[str, list]], rels: dict[str, tuple[str, list]]) -> PropertyGraph:
    """A small graph from literal rows: label or type to (schema, rows); schemas start with id, or id, src, dst."""
    return PropertyGraph(spark, {k: spark.createDataFrame(r, s) for k, (s, r) in nodes.items()}, {k: spark.createDataFrame(r, s) for k, (s, r) in rels.items()})


def save(graph: PropertyGraph, path: str) -> None:
    """Write each table as Parquet under ``path``."""
    for kind, tables in (("nodes", graph.nodes), ("rels", graph.rels)):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{path}/{kind}={name}")


def open_saved(spark: SparkSession, path: str, labels: list[str], types: list[str]) -> PropertyGraph:
    return PropertyGraph(spark, {n: spark.read.parquet(f"{path}/nodes={n}") for n in labels}, {n: spark.read.parquet(f"{path}/rels={n}") for n in types})
