"""Registered queries of the graph engine, one or more for each operator, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import builtins as B
from graphloom.functions.registry import register_udf
from graphloom.functions.stringify import stringified
from graphloom.graph import PropertyGraph
from graphloom.operators import algorithms as A
from graphloom.operators import updates as U
from graphloom.operators.lower import run
from graphloom.plans.builder import Query, equals, var
from graphloom.plans.expr import Op, Var
from graphloom.sources.tables import CODE, CODES, from_tables

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

#: How the graph's ids and derived tables look in SQL.
KNOWS = """knows AS (SELECT c_custkey AS s, (7 * c_custkey + 1) % n AS d, CAST((c_custkey * 37) % 100 + 1 AS DOUBLE) AS w FROM customer, (SELECT count(*) AS n FROM customer)
  UNION ALL SELECT c_custkey, (13 * c_custkey + 3) % n, CAST((c_custkey * 37) % 100 + 1 AS DOUBLE) FROM customer, (SELECT count(*) AS n FROM customer))"""


def text(name: str, query: str, columns: str, sql: str | None = None) -> None:
    """A query of the text language; ``columns`` names its bindings."""
    _QUERIES[name] = lambda spark, d: run(from_tables(spark, d), query).toDF(*columns.split())
    if sql:
        _SQL[name] = sql


def built(sql: str | None = None, columns: str | None = None):
    """A query from a function of the graph that returns a builder query or a DataFrame."""

    def register(fn: Callable[[PropertyGraph], Query | DataFrame]):
        def go(spark: SparkSession, d: str) -> DataFrame:
            out = fn(from_tables(spark, d))
            out = out.df() if isinstance(out, Query) else out
            return out.toDF(*columns.split()) if columns else out

        _QUERIES[fn.__name__] = go
        if sql:
            _SQL[fn.__name__] = sql
        return fn

    return register


def key_of(col):
    """The table key of a node id."""
    return F.pmod(col, F.lit(CODE))


def cid(key: int) -> int:
    return CODES["Customer"] * CODE + key


PATH3 = "Match((o:Order)-[:placedBy]->(c:Customer)-[:livesIn]->(n:Nation)-[:isPartOf]->(r:Region))"
FLAGSHIP = f"Sort([$1:double DESC], GroupBy([$6.name:string], [sum($0.totalprice:double), count($0.key:int)], Filter($0.status == 'F', {PATH3})))"
PATH3_SQL = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return run(from_tables(spark, d), FLAGSHIP).select(F.col("_0").alias("region"), F.round("_1", 2).alias("revenue"), F.col("_2").alias("orders"))


_QUERIES["flagship"] = flagship
_SQL["flagship"] = f"SELECT r_name AS region, round(sum(o_totalprice), 2) AS revenue, count(*) AS orders FROM {PATH3_SQL} WHERE o_orderstatus = 'F' GROUP BY 1"

# scans

ALL_LABELS = {"Region": "region", "Nation": "nation", "Customer": "customer", "Supplier": "supplier", "Part": "part", "Order": "orders", "Event": "events", "Message": "conversations"}
text("node_scan_all", "GroupBy([$0:string], [count($0:string)], Project([pb::label($0:qresult)], NodeScan()))", "label n", " UNION ALL ".join(f"SELECT '{n}' AS label, count(*) AS n FROM {t}" for n, t in ALL_LABELS.items()))
text("node_scan_label", "Project([$0.key:uint64, $0.name:string, $0.size:int], NodeScan('Part'))", "key name size", "SELECT p_partkey AS key, p_name AS name, p_size AS size FROM part")
text("node_scan_labels", "Project([pb::label($0:qresult), $0.key:uint64, $0.name:string], NodeScan(['Customer', 'Supplier']))", "label key name", "SELECT 'Customer' AS label, c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT 'Supplier', s_suppkey, s_name FROM supplier")


@built("SELECT c_custkey AS key FROM customer WHERE c_custkey BETWEEN 100 AND 299", "key")
def node_scan_range(g):
    return Query(g).all_nodes("Customer", (cid(100), cid(299))).project(var(0, "key"))


@built("SELECT c_custkey AS key, c_acctbal AS acctbal FROM customer WHERE c_acctbal > 5000", "key acctbal")
def nodes_where(g):
    return Query(g).nodes_where("Customer", "acctbal", lambda c: c > 5000).project(var(0, "key"), var(0, "acctbal"))


@built("SELECT c_custkey AS key FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000", "key")
def nodes_where_multi(g):
    return Query(g).nodes_where(["Customer", "Supplier"], "acctbal", lambda c: c > 5000).project(var(0, "key"))


@built("SELECT c_custkey AS key, c_name AS name FROM customer WHERE c_custkey = 42", "key name")
def index_scan(g):
    return run(g.create_index("Customer", "key"), "Project([$0.key:uint64, $0.name:string], IndexScan('Customer', 'key', 42))")


@built("SELECT 'Supplier' AS label, s_name AS name FROM supplier WHERE s_suppkey = 7", "label name")
def index_scan_multi(g):
    g = g.create_index("Supplier", "key").create_index("Customer", "key")
    return Query(g).nodes_where_indexed(["Supplier", "Customer"], "key", 7).project(lambda e: e.prop(0, "label"), var(0, "name"))


@built("SELECT n_nationkey AS nation, n_regionkey AS region FROM nation", "nation region")
def rship_scan_type(g):
    return Query(g).relationships_by_label("isPartOf").project(lambda e: key_of(e.prop(0, "src")).cast("int"), lambda e: key_of(e.prop(0, "dst")).cast("int"))


@built("SELECT 'Customer' AS label, count(*) AS n FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'Supplier', count(*) FROM supplier WHERE s_acctbal < 0", "label n")
def property_scan(g):
    return g.nodes_with("acctbal", lambda c: c < 0).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# traversal

text("foreach_from", "Project([$0.key:uint64, $1.quantity:double], ForeachRelationship(FROM, 'contains', Filter($0.key < 50, NodeScan('Order'))))", "okey quantity", "SELECT o_orderkey AS okey, l_quantity AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey < 50")
text("foreach_to", "GroupBy([$0.key:uint64], [count($1.id:uint64)], ForeachRelationship(TO, 'placedBy', NodeScan('Customer')))", "ckey n", "SELECT o_custkey AS ckey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
text("foreach_all", "Project([$0.key:uint64, $2.key:uint64, $1.weight:double], ForeachRelationship(ALL, ':knows', Filter($0.key < 100, NodeScan('Customer'))))", "a b weight", f"WITH {KNOWS} SELECT s AS a, d AS b, w AS weight FROM knows WHERE s < 100 UNION ALL SELECT d, s, w FROM knows WHERE d < 100")
text("expand_out", "Project([$0.key:uint64, $2.name:string], Expand(OUT, 'Nation', ForeachRelationship(FROM, 'livesIn', NodeScan('Customer'))))", "ckey nation", "SELECT c_custkey AS ckey, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
text("expand_in", "Project([$0.name:string, $2.key:uint64], Expand(IN, 'Supplier', ForeachRelationship(TO, 'basedIn', NodeScan('Nation'))))", "nation skey", "SELECT n_name AS nation, s_suppkey AS skey FROM supplier JOIN nation ON s_nationkey = n_nationkey")
text("has_label", "GroupBy([$0:string], [count($0:string)], Project([pb::label($0:qresult)], Filter(pb::has_label($0:qresult, 'Part'), NodeScan(['Part', 'Supplier']))))", "label n", "SELECT 'Part' AS label, count(*) AS n FROM part")


@built("SELECT n_name AS nation, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) JOIN nation ON k = n_nationkey GROUP BY 1", "nation n")
def expand_multi(g):
    out = Query(g).all_nodes("Nation").to_relationships("livesIn").from_node(["Customer", "Supplier"])
    other = Query(g).all_nodes("Nation").to_relationships("basedIn").from_node(["Customer", "Supplier"])
    return out.union_all(other).has_label(["Customer", "Supplier"]).groupby([var(0, "name")], [("count", None)])


def walks(low: int, high: int, start: str, forward: bool) -> str:
    s, d = ("s", "d") if forward else ("d", "s")
    return f"""w(o, es, ed, node, hop) AS (SELECT {s}, s, d, {d}, 1 FROM knows WHERE {s} {start} UNION SELECT w.o, k.s, k.d, k.{d}, w.hop + 1 FROM w JOIN knows k ON k.{s} = w.node WHERE w.hop < {high}),
    r AS (SELECT DISTINCT o, es, ed FROM w WHERE hop >= {low})"""


text("var_from_2_3", "Project([$0.key:uint64, $2.key:uint64], Expand(OUT, 'Customer', ForeachRelationship(FROM, 'knows', 2, 3, Filter($0.key < 20, NodeScan('Customer')))))", "origin node", f"WITH RECURSIVE {KNOWS}, {walks(2, 3, '< 20', True)} SELECT o AS origin, ed AS node FROM r")
text("var_to_1_3", "Project([$0.key:uint64, $2.key:uint64], Expand(IN, 'Customer', ForeachRelationship(TO, 'knows', 1, 3, Filter($0.key < 20, NodeScan('Customer')))))", "origin node", f"WITH RECURSIVE {KNOWS}, {walks(1, 3, '< 20', False)} SELECT o AS origin, es AS node FROM r")
text("var_all_1_2", "Project([$0.key:uint64, $2.key:uint64], ForeachRelationship(ALL, 'knows', 1, 2, Filter($0.key < 20, NodeScan('Customer'))))", "origin node",
     f"WITH RECURSIVE {KNOWS}, {walks(1, 2, '< 20', True)}, {walks(1, 2, '< 20', False).replace('w(', 'v(').replace('w.', 'v.').replace('FROM w', 'FROM v').replace('r AS', 'q AS')} SELECT o AS origin, ed AS node FROM r UNION ALL SELECT o, es FROM q")
text("var_unbounded", "Project([$0.key:uint64, $2.key:uint64], Match((m:Message)-[:replyOf*1..]->(n:Message)))", "origin node",
     "SELECT a.conv_id * 1000 + a.turn AS origin, b.conv_id * 1000 + b.turn AS node FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn < a.turn")
text("match_1hop", "Project([$0.name:string, $2.name:string], Match((n:Nation)-[:isPartOf]->(r:Region)))", "nation region", "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
text("match_3hop", f"GroupBy([$6.name:string, $0.priority:string], [count($0.key:int)], {PATH3})", "region priority n", f"SELECT r_name AS region, o_orderpriority AS priority, count(*) AS n FROM {PATH3_SQL} GROUP BY 1, 2")
text("match_reverse", "GroupBy([$0.name:string], [count($2.key:int)], Match((n:Nation)<-[:livesIn]-(c:Customer)))", "nation n", "SELECT n_name AS nation, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
text("match_undirected", "Project([$0.key:uint64, $2.key:uint64], Match((a:Customer {key: 5})-[:knows]-(b:Customer)))", "a b", f"WITH {KNOWS} SELECT s AS a, d AS b FROM knows WHERE s = 5 UNION ALL SELECT d, s FROM knows WHERE d = 5")
text("match_props", "Project([$0.key:uint64, $2.name:string], Match((c:Customer {mktsegment: 'BUILDING'})-[:livesIn]->(n:Nation {key: 7})))", "ckey nation", "SELECT c_custkey AS ckey, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' AND n_nationkey = 7")

# filters

for _name, _op, _sql in (("eq", "==", "="), ("ne", "!=", "<>"), ("lt", "<", "<"), ("le", "<=", "<="), ("gt", ">", ">"), ("ge", ">=", ">=")):
    text(f"filter_cmp_{_name}", f"Project([$0.key:uint64], Filter($0.size {_op} 25, NodeScan('Part')))", "key", f"SELECT p_partkey AS key FROM part WHERE p_size {_sql} 25")
text("filter_and_or_not", "Project([$0.key:uint64], Filter($0.size > 40 && !($0.brand == 'Brand#11') || $0.key < 10, NodeScan('Part')))", "key", "SELECT p_partkey AS key FROM part WHERE p_size > 40 AND NOT p_brand = 'Brand#11' OR p_partkey < 10")
text("filter_arith", "Project([$0.key:uint64], Filter(($0.key * 3 + $0.size) % 7 == 2 && $0.retailprice / 2 - 10 > 400, NodeScan('Part')))", "key", "SELECT p_partkey AS key FROM part WHERE (p_partkey * 3 + p_size) % 7 = 2 AND p_retailprice / 2 - 10 > 400")
text("filter_rship_prop", "Aggregate([count($0.key:int)], Filter($1.discount >= 0.05 && $1.returnflag == 'R', ForeachRelationship(FROM, 'contains', NodeScan('Order'))))", "n", "SELECT count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_discount >= 0.05 AND l_returnflag = 'R'")
text("filter_node_identity", "Project([$0.key:uint64, $1.key:uint64], Filter($0 == $1, CrossJoin(Filter($0.key < 30, NodeScan('Customer')), Filter($0.key > 20, NodeScan('Customer')))))", "a b", "SELECT c_custkey AS a, c_custkey AS b FROM customer WHERE c_custkey > 20 AND c_custkey < 30")
text("filter_missing_prop", "GroupBy([$0:string], [count($0:string)], Project([pb::label($0:qresult)], Filter($0.mktsegment == 'BUILDING' || $0.key == 3, NodeScan(['Customer', 'Supplier']))))", "label n", "SELECT 'Customer' AS label, count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' OR c_custkey = 3 UNION ALL SELECT 'Supplier', count(*) FROM supplier WHERE s_suppkey = 3")


@built("SELECT o_orderkey AS key FROM orders WHERE o_totalprice > 100000 AND o_orderdate >= TIMESTAMP '1997-01-01'", "key")
def filter_params(g):
    import datetime

    from graphloom.plans.expr import Lit, Param

    cond = Op("&&", (Op(">", (Var(0, "totalprice"), Param("least"))), Op(">=", (Var(0, "orderdate"), Lit(datetime.datetime(1997, 1, 1))))))
    return Query(g).all_nodes("Order").filter(cond).project(var(0, "key")).df(least=100000.0)


@built("SELECT o_orderkey AS key FROM orders WHERE year(o_orderdate) = 1995", "key")
def filter_udf(g):
    register_udf("year", F.year)
    return run(g, "Project([$0.key:uint64], Filter(udf::year($0.orderdate:datetime) == 1995, NodeScan('Order')))")


@built("SELECT s_suppkey AS key FROM supplier WHERE s_acctbal > s_suppkey * 50", "key")
def where_tuple(g):
    return Query(g).all_nodes("Supplier").where_qr_tuple(lambda e: e.prop(0, "acctbal") > e.prop(0, "key") * 50).project(var(0, "key"))


# projection and functions

text("project_types", "Project([$0.key:uint64, $0.size:int, $0.retailprice:double, $0.name:string, $0.name:int], NodeScan('Part'))", "k i d s bad", "SELECT p_partkey AS k, p_size AS i, p_retailprice AS d, p_name AS s, TRY_CAST(p_name AS INT) AS bad FROM part")
text("project_datetime", "Project([$0.key:uint64, $0.orderdate:datetime], NodeScan('Order'))", "key at", "SELECT o_orderkey AS key, o_orderdate AS at FROM orders")
text("project_label", "Project([pb::label($0:qresult), pb::label($1:qresult)], ForeachRelationship(FROM, 'isPartOf', NodeScan('Nation')))", "node rel", "SELECT 'Nation' AS node, 'isPartOf' AS rel FROM nation")
text("project_forward", "Project([$0:string, $1:int], Project([$0.name:string, $0.size:int], NodeScan('Part')))", "name size", "SELECT p_name AS name, p_size AS size FROM part")


@built("SELECT p_partkey AS key, strftime(to_timestamp(p_partkey * 100000) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, strftime(to_timestamp(p_partkey * 100000) AT TIME ZONE 'UTC', '%Y-%b-%d %H:%M:%S') AS at FROM part", "key day at")
def project_datestring(g):
    seconds = lambda e: e.prop(0, "key") * 100000
    return Query(g).all_nodes("Part").project(var(0, "key"), lambda e: B.int_to_datestring(seconds(e)), lambda e: B.int_to_dtimestring(seconds(e)))


@built("SELECT p_partkey AS key, p_size * 2 AS twice FROM part", "key twice")
def project_udf(g):
    register_udf("twice", lambda c: c * 2)
    return run(g, "Project([$0.key:uint64, udf::twice($0.size:int)], NodeScan('Part'))")


text("builtin_year_month_date", "Project([$0.key:uint64, pb::pr_year($0.orderdate:datetime), pb::pr_month($0.orderdate:datetime), pb::pr_date($0.orderdate:datetime)], NodeScan('Order'))", "key y m d", "SELECT o_orderkey AS key, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders")
text("builtin_to_int", "Project([$0.key:uint64, pb::to_int($0.key:string)], NodeScan('Supplier'))", "key n", "SELECT s_suppkey AS key, CAST(s_suppkey AS INT) AS n FROM supplier")
text("builtin_has_property", "Project([pb::label($0:qresult), $0.key:uint64], Filter(pb::has_property($0.mktsegment:string), NodeScan(['Customer', 'Supplier'])))", "label key", "SELECT 'Customer' AS label, c_custkey AS key FROM customer")
text("builtin_is_null", "GroupBy([$0:string], [count($0:string)], Project([pb::label($0:qresult)], Filter(pb::is_null($0.brand:string), NodeScan(['Part', 'Nation']))))", "label n", "SELECT 'Nation' AS label, count(*) AS n FROM nation")


@built("SELECT o_orderkey AS key, CAST(epoch(CAST(o_orderdate AS DATE)) AS BIGINT) AS day, CAST(epoch(date_trunc('second', o_orderdate)) AS BIGINT) AS at FROM orders", "key day at")
def builtin_epoch(g):
    at = lambda e: e.prop(0, "orderdate")
    return Query(g).all_nodes("Order").project(var(0, "key"), lambda e: B.datestring_to_int(B.pr_date(at(e))), lambda e: B.dtimestring_to_int(F.date_format(at(e), B.DATETIME)))


@built("SELECT c_custkey AS key, CASE WHEN c_acctbal < 0 THEN 'owes' ELSE c_mktsegment END AS state FROM customer", "key state")
def builtin_case(g):
    return Query(g).all_nodes("Customer").project(var(0, "key"), lambda e: B.choose(e.prop(0, "acctbal") < 0, F.lit("owes"), e.prop(0, "mktsegment")))


@built("SELECT 'Region[' || (1000000000000 + r_regionkey) || ']{key: ' || r_regionkey || ', name: \"' || r_name || '\"}' AS node, printf('%.6f', r_regionkey / 3.0) AS third FROM region", "node third")
def stringify_nodes(g):
    return stringified(Query(g).all_nodes("Region").project(lambda e: e.binding(0), lambda e: e.prop(0, "key") / 3.0).df())


# joins

text("cross_join", "Project([$0.name:string, $1.name:string], CrossJoin(NodeScan('Region'), NodeScan('Nation')))", "region nation", "SELECT r_name AS region, n_name AS nation FROM region, nation")
text("hash_join_text", "Project([$0.key:uint64, $1.key:uint64], HashJoin($0.acctbal < $1.acctbal && $0.key == $1.key, NodeScan('Supplier'), NodeScan('Customer')))", "s c", "SELECT s_suppkey AS s, c_custkey AS c FROM supplier JOIN customer ON s_suppkey = c_custkey AND s_acctbal < c_acctbal")
text("left_outer_join", "Project([$0.key:uint64, $1.name:string], LeftOuterJoin($0.key == $1.key, NodeScan('Nation'), Filter($0.key < 3, NodeScan('Region'))))", "nation region", "SELECT CAST(n_nationkey AS BIGINT) AS nation, r_name AS region FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON n_nationkey = r_regionkey")
text("theta_join", "Project([$0.key:uint64, $1.key:uint64], Filter($0.key > $1.key && $0.key < $1.key + 3, CrossJoin(NodeScan('Nation'), NodeScan('Region'))))", "a b", "SELECT CAST(n_nationkey AS BIGINT) AS a, CAST(r_regionkey AS BIGINT) AS b FROM nation, region WHERE n_nationkey > r_regionkey AND n_nationkey < r_regionkey + 3")

_SHARED_NATION = "SELECT c_custkey AS c, s_suppkey AS s FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_custkey < 200"


def _customers_and_suppliers(g):
    left = Query(g).all_nodes("Customer").filter(lambda e: e.prop(0, "key") < 200).from_relationships("livesIn").to_node("Nation")
    return left, Query(g).all_nodes("Supplier").from_relationships("basedIn").to_node("Nation")


@built(_SHARED_NATION, "c s")
def nested_loop_join(g):
    left, right = _customers_and_suppliers(g)
    return left.nested_loop_join((2, 2), right).project(var(0, "key"), var(3, "key"))


@built(_SHARED_NATION, "c s")
def hash_join(g):
    left, right = _customers_and_suppliers(g)
    return left.hash_join((2, 2), right).project(var(0, "key"), var(3, "key"))


@built("SELECT n_name AS nation, r_name AS region FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_name < 'B'", "nation region")
def left_outer_connected(g):
    some = Query(g).all_nodes("Region").property("name", lambda c: c < "B")
    return Query(g).all_nodes("Nation").left_outer_connected(some, "isPartOf", 0, 0).project(var(0, "name"), var(1, "name"))


@built("SELECT CAST(r_regionkey AS BIGINT) AS r, CAST(n_nationkey AS BIGINT) AS n FROM region LEFT JOIN nation ON n_nationkey BETWEEN r_regionkey * 6 AND r_regionkey * 6 + 2", "r n")
def left_outer_theta(g):
    return Query(g).all_nodes("Region").left_outer_join(Query(g).all_nodes("Nation"), lambda e: e.prop(1, "key").between(e.prop(0, "key") * 6, e.prop(0, "key") * 6 + 2)).project(var(0, "key"), var(1, "key"))


# aggregation


def rounded(fn):
    """Doubles to two digits, the same on both sides."""
    go = _QUERIES[fn]
    _QUERIES[fn] = lambda spark, d: (lambda df: df.select(*(F.round(c, 2).alias(c) if t == "double" else c for c, t in df.dtypes)))(go(spark, d))


text("aggregate_all", "Aggregate([count($0.key:int), sum($0.size:int), avg($0.retailprice:double), min($0.name:string), max($0.retailprice:double)], NodeScan('Part'))", "n s a lo hi", "SELECT count(*) AS n, CAST(sum(p_size) AS BIGINT) AS s, round(avg(p_retailprice), 2) AS a, min(p_name) AS lo, round(max(p_retailprice), 2) AS hi FROM part")
rounded("aggregate_all")
text("aggregate_missing_zero", "Aggregate([count($0.size:int), sum($0.size:int), avg($0.size:int), min($0.size:int)], NodeScan(['Part', 'Nation']))", "n s a lo", "SELECT count(*) AS n, CAST(sum(coalesce(x, 0)) AS BIGINT) AS s, round(avg(coalesce(x, 0)), 2) AS a, min(x) AS lo FROM (SELECT p_size AS x FROM part UNION ALL SELECT NULL FROM nation)")
rounded("aggregate_missing_zero")
text("aggregate_empty", "Aggregate([count($0.size:int), sum($0.size:int), min($0.size:int), max($0.name:string)], Filter($0.key < 0, NodeScan('Part')))", "n s lo hi", "SELECT count(*) AS n, CAST(sum(p_size) AS BIGINT) AS s, min(p_size) AS lo, max(p_name) AS hi FROM part WHERE p_partkey < 0")
text("group_by_prop", "GroupBy([$0.brand:string], [count($0.key:int), avg($0.retailprice:double), sum($0.size:int), min($0.size:int), max($0.size:int)], NodeScan('Part'))", "brand n a s lo hi", "SELECT p_brand AS brand, count(*) AS n, round(avg(p_retailprice), 2) AS a, CAST(sum(p_size) AS BIGINT) AS s, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY 1")
rounded("group_by_prop")
text("group_by_pos", "GroupBy([$0:string], [count($1:int), sum($1:int)], Project([$0.brand:string, $0.size:int], NodeScan('Part')))", "brand n s", "SELECT p_brand AS brand, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS s FROM part GROUP BY 1")
text("group_by_multi", "GroupBy([$1.returnflag:string, $1.linestatus:string], [sum($1.quantity:double), count($0.key:int)], ForeachRelationship(FROM, 'contains', NodeScan('Order')))", "flag status q n", "SELECT l_returnflag AS flag, l_linestatus AS status, round(sum(l_quantity), 2) AS q, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")
rounded("group_by_multi")
text("group_by_datetime", "GroupBy([$0.orderdate:datetime], [count($0.key:int)], NodeScan('Order'))", "at n", "SELECT o_orderdate AS at, count(*) AS n FROM orders GROUP BY 1")
text("count", "Aggregate([count($0.key:int)], NodeScan('Event'))", "n", "SELECT count(*) AS n FROM events")
text("group_having", "Filter($1 > 3, GroupBy([$0.size:int], [count($0.key:int)], NodeScan('Part')))", "size n", "SELECT p_size AS size, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 3")


@built("SELECT n_nationkey AS nation, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1", "nation n")
def group_by_node(g):
    out = Query(g).all_nodes("Customer").from_relationships("livesIn").to_node("Nation").groupby([var(2)], [("count", None)]).df()
    return out.select(key_of(F.col("_0")).cast("int"), "_1")


text("group_pcount", "GroupBy([$0.event_type:string], [pcount($0.key:int), count($0.key:int)], NodeScan('Event'))", "type pct n", "SELECT event_type AS type, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS pct, count(*) AS n FROM events GROUP BY 1")
rounded("group_pcount")

# order, limits, sets

text("sort_multi", "Sort([$0:string ASC, $1:uint64 DESC], Project([$0.mktsegment:string, $0.key:uint64], NodeScan('Customer')))", "segment key", "SELECT c_mktsegment AS segment, c_custkey AS key FROM customer ORDER BY 1, 2 DESC")
text("top_k", "Limit(10, Sort([$0:double DESC, $1:uint64 ASC], Project([$0.totalprice:double, $0.key:uint64], NodeScan('Order'))))", "price key", "SELECT o_totalprice AS price, o_orderkey AS key FROM orders ORDER BY 1 DESC, 2 LIMIT 10")
text("limit_n", "Aggregate([count($0:int)], Limit(37, Project([$0.key:int], NodeScan('Order'))))", "n", "SELECT 37::BIGINT AS n")
text("distinct", "Distinct(Project([$0.brand:string, $0.size:int], NodeScan('Part')))", "brand size", "SELECT DISTINCT p_brand AS brand, p_size AS size FROM part")
text("union_all", "Union(Project([$0.name:string], NodeScan('Nation')), Project([$0.name:string], NodeScan('Region')))", "name", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
text("union_set", "Distinct(Union(Project([$0.key:uint64], NodeScan('Nation')), Project([$0.key:uint64], NodeScan('Region'))))", "key", "SELECT CAST(n_nationkey AS BIGINT) AS key FROM nation UNION SELECT r_regionkey FROM region")


@built("SELECT p_partkey AS key FROM part WHERE p_partkey IN (1, 2, 3, 4)", "key")
def union_nary(g):
    one = lambda k: Query(g).all_nodes("Part").filter(equals(0, "key", k)).project(var(0, "key"))
    return one(1).union_all(one(2), one(3), one(4))


# updates: what a query over the new snapshot gives


@built("SELECT c_custkey AS key, c_name AS name FROM customer WHERE c_custkey < 5 UNION ALL SELECT 12345, 'Rocky'", "key name")
def create_node(g):
    """A larger table has a customer of that key too; the created node is read by its id."""
    g, new = U.created(g, "Create((n:Customer { key: 12345, name: 'Rocky' }))")
    return run(g, "Project([$0.key:uint64, $0.name:string], Filter($0.key < 5 || $0.id == ?new, NodeScan('Customer')))", {"new": new.first().id})


@built("SELECT c_custkey AS c, r_name AS region FROM customer, region WHERE c_custkey < 4 AND r_regionkey = 2", "c region")
def create_rship(g):
    g = U.apply(g, "Create(($0)-[r:likes { since: 2020 }]->($1), CrossJoin(Filter($0.key < 4, NodeScan('Customer')), Filter($0.key == 2, NodeScan('Region'))))")
    return run(g, "Project([$0.key:uint64, $2.name:string], Filter($1.since == 2020, Match((c:Customer)-[:likes]->(r:Region))))")


@built("SELECT p_partkey AS key, CASE WHEN p_size > 45 THEN 0 ELSE p_size END AS size FROM part", "key size")
def update_node(g):
    g = Query(g).all_nodes("Part").property("size", lambda c: c > 45).update(0, size=0).update_graph()
    return Query(g).all_nodes("Part").project(var(0, "key"), var(0, "size"))


@built("SELECT o_orderkey AS okey, CASE WHEN o_orderkey < 10 THEN TIMESTAMP '2000-01-01' ELSE o_orderdate END AS at FROM orders", "okey at")
def update_rship(g):
    ids = g.rel_table("placedBy").where(key_of(F.col("src")) < 10).select("id")
    g = U.update_rels(g, ids, {"orderdate": F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")}, "placedBy")
    return Query(g).relationships_by_label("placedBy").project(lambda e: key_of(e.prop(0, "src")), var(0, "orderdate"))


@built("SELECT CASE WHEN s_acctbal < 0 THEN 'Debtor' ELSE 'Supplier' END AS label, count(*) AS n FROM supplier GROUP BY 1", "label n")
def relabel_node(g):
    g = U.relabel(g, g.node_table("Supplier").where("acctbal < 0").select("id"), "Debtor")
    return g.node_table(["Supplier", "Debtor"]).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@built("SELECT count(*) - 1 AS n FROM (SELECT p_partkey FROM part UNION ALL SELECT -1)", "n")
def remove_node(g):
    """A larger table has a part of that key, with relationships; only the node that was created goes."""
    g, new = U.created(g, "Create((n:Part { key: 999999 }))")
    g = U.apply(g, "RemoveNode(Filter($0.id == ?new, NodeScan('Part')))", {"new": new.first().id})
    return run(g, "Aggregate([count($0.key:int)], NodeScan('Part'))")


@built(f"WITH {KNOWS} SELECT (SELECT count(*) FROM customer WHERE c_custkey >= 10) AS nodes, (SELECT count(*) FROM knows WHERE s >= 10 AND d >= 10) AS rels, (SELECT count(*) FROM orders WHERE o_custkey >= 10) AS placed", "nodes rels placed")
def detach_node(g):
    g = U.apply(g, "DetachNode(Filter($0.key < 10, NodeScan('Customer')))")
    n = lambda t: t.agg(F.count(F.lit(1)).alias("n"))
    return n(g.nodes["Customer"]).crossJoin(n(g.rels["knows"])).crossJoin(n(g.rels["placedBy"]))  # one row each


@built("SELECT count(*) AS n FROM lineitem WHERE NOT (l_returnflag = 'R' AND l_quantity > 30)", "n")
def remove_rship(g):
    g = U.apply(g, "RemoveRelationship(Filter($1.returnflag == 'R' && $1.quantity > 30, ForeachRelationship(FROM, 'contains', NodeScan('Order'))))")
    return g.rels["contains"].agg(F.count(F.lit(1)).alias("n"))


@built(f"WITH {KNOWS} SELECT count(*) AS n FROM knows WHERE NOT (s = 3 AND d = 22)", "n")
def remove_rship_ends(g):
    keys = g.spark.createDataFrame([(cid(3), cid(22))], "src long, dst long")
    return U.remove_rels(g, keys, "knows").rels["knows"].agg(F.count(F.lit(1)).alias("n"))


# algorithms

DEGREES = "SELECT c_custkey AS key, coalesce(i.n, 0) + coalesce(p.n, 0) + coalesce(e.n, 0) AS in_degree, coalesce(o.n, 0) + 1 AS out_degree FROM customer LEFT JOIN (SELECT d, count(*) AS n FROM knows GROUP BY 1) i ON i.d = c_custkey LEFT JOIN (SELECT s, count(*) AS n FROM knows GROUP BY 1) o ON o.s = c_custkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) p ON p.o_custkey = c_custkey LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) e ON e.user_id = c_custkey"
text("num_links", "Project([$0.key:uint64, $1:uint64, $2:uint64], Algorithm([NumLinks, TUPLE], NodeScan('Customer')))", "key in_degree out_degree", f"WITH {KNOWS} {DEGREES}")
text("arg_min_neighbour", "Project([$0.key:uint64, $1.key:uint64], Algorithm([ArgMinNeighbour, TUPLE, 'placedBy', 'Order', 'totalprice'], NodeScan('Customer')))", "ckey okey", "SELECT o_custkey AS ckey, arg_min(o_orderkey, o_totalprice) AS okey FROM orders GROUP BY 1")

#: Levels of all customers from customer 0, by breadth-first rounds that stop when nothing new is found, and the smallest of the shortest paths.
LEVELS = f"""WITH RECURSIVE {KNOWS}, e AS (SELECT DISTINCT s, d FROM knows),
  walk(node, hop) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT d, hop + 1 FROM walk JOIN e ON s = node WHERE hop < 60),
  lv AS (SELECT node, min(hop) AS level FROM walk GROUP BY 1)"""
FIRST_PATHS = f"""{LEVELS}, p(node, path, level) AS (SELECT CAST(0 AS BIGINT), [CAST(0 AS BIGINT)], 0
  UNION ALL SELECT e.d, min(list_append(p.path, e.d)), min(p.level + 1) FROM p JOIN e ON e.s = p.node JOIN lv ON lv.node = e.d AND lv.level = p.level + 1 GROUP BY e.d)"""
EVERY_PATH = f"""{LEVELS}, p(node, path, level) AS (SELECT CAST(0 AS BIGINT), [CAST(0 AS BIGINT)], 0
  UNION ALL SELECT e.d, list_append(p.path, e.d), p.level + 1 FROM p JOIN e ON e.s = p.node JOIN lv ON lv.node = e.d AND lv.level = p.level + 1)"""
AS_TEXT = "array_to_string(path, '-')"
TARGETS = (1, 3, 8, 22, 25, 57, 60)


@built(f"{LEVELS} SELECT node AS key, CAST(level AS INT) AS level FROM lv", "key level")
def bfs_levels(g):
    return A.bfs(g, cid(0), "knows").select(key_of(F.col("id")), "level")


text("bfs_text", "Project([$1:uint64, $2:int], Algorithm([BFS, TUPLE, 'knows'], Filter($0.key == 0, NodeScan('Customer'))))", "id level", f"{LEVELS} SELECT 3000000000000 + node AS id, CAST(level AS INT) AS level FROM lv")


def _path_text(col):
    return F.array_join(F.transform(col, key_of), "-")


@built(f"{FIRST_PATHS} SELECT node AS key, {AS_TEXT} AS path FROM p", "key path")
def path_bfs(g):
    return A.path_bfs(g, cid(0), "knows").select(key_of(F.col("id")), _path_text(F.col("path")))


def _targets(g, keys):
    return g.spark.createDataFrame([(cid(0), cid(k)) for k in keys], "src long, dst long")


@built(f"{EVERY_PATH} SELECT node AS key, CAST(level AS BIGINT) AS hops, {AS_TEXT} AS path FROM p WHERE node IN {TARGETS}", "key hops path")
def all_shortest_paths(g):
    return A.shortest_paths(g, _targets(g, TARGETS), "knows", all_paths=True).select(key_of(F.col("dst")), "hops", _path_text(F.col("path")))


@built(f"{FIRST_PATHS} SELECT node AS key, CAST(level AS BIGINT) AS hops, {AS_TEXT} AS path FROM p WHERE node IN {TARGETS}", "key hops path")
def shortest_path(g):
    return A.shortest_paths(g, _targets(g, TARGETS), "knows").select(key_of(F.col("dst")), "hops", _path_text(F.col("path")))


@built("SELECT n_name AS nation, r_name AS region, '2' || lpad(CAST(n_nationkey AS VARCHAR), 12, '0') || '-1' || lpad(CAST(r_regionkey AS VARCHAR), 12, '0') AS path FROM nation JOIN region ON n_regionkey = r_regionkey", "nation region path")
def shortest_path_text(g):
    out = run(g, "Algorithm([ShortestPath, TUPLE, 'isPartOf', 0, 0], CrossJoin(NodeScan('Nation'), NodeScan('Region')))")
    return out.select("_0.name", "_1.name", F.array_join("_2", "-"))


#: The lightest walk of each number of hops to each customer; the lightest of all is a simple path, as weights are positive.
WEIGHTED = f"""WITH RECURSIVE {KNOWS}, e AS (SELECT s, d, min(w) AS w FROM knows GROUP BY 1, 2),
  r(node, best, hop) AS (SELECT CAST(0 AS BIGINT), {{'w': CAST(0 AS DOUBLE), 'path': [CAST(0 AS BIGINT)]}}, 0
  UNION ALL SELECT e.d, min({{'w': r.best.w + e.w, 'path': list_append(r.best.path, e.d)}}), min(r.hop + 1) FROM r JOIN e ON e.s = r.node WHERE r.hop < 60 GROUP BY e.d),
  f AS (SELECT node, min({{'w': best.w, 'hop': hop, 'path': best.path}}) AS b FROM r GROUP BY 1)"""


@built(f"{WEIGHTED} SELECT node AS key, CAST(b.hop AS BIGINT) AS hops, array_to_string(b.path, '-') AS path, b.w AS weight FROM f WHERE node IN {TARGETS}", "key hops path weight")
def weighted_shortest(g):
    return A.weighted_shortest_paths(g, _targets(g, TARGETS), "knows").select(key_of(F.col("dst")), "hops", _path_text(F.col("path")), "weight")


@built(f"{WEIGHTED} SELECT node AS key, b.w AS weight FROM f WHERE node IN {TARGETS}", "key weight")
def all_weighted_shortest(g):
    """Every lightest path is found; how many a target has is not in its SQL twin, tests hold them against brute force."""
    return A.weighted_shortest_paths(g, _targets(g, TARGETS), "knows", all_paths=True).groupBy("dst").agg(F.min("weight").alias("weight")).select(key_of(F.col("dst")), "weight")


text("weighted_text", "Project([$0.key:uint64, $1.key:uint64, $2:double], Algorithm([WeightedShortestPathWeight, TUPLE, 'knows', 'weight'], CrossJoin(Filter($0.key == 0, NodeScan('Customer')), Filter($0.key == 22 || $0.key == 57, NodeScan('Customer')))))", "a b weight", f"{WEIGHTED} SELECT 0 AS a, node AS b, b.w AS weight FROM f WHERE node IN (22, 57)")


@built(None, "key rank path weight")
def k_shortest(g):
    """No SQL: simple paths of the whole graph are too many to list; tests hold it against brute force."""
    return A.k_shortest_paths(g, _targets(g, TARGETS), 3, "knows").select(key_of(F.col("dst")), "rank", _path_text(F.col("path")), "weight")


@built(f"WITH {KNOWS} SELECT s AS key, CAST(count(*) AS INT) AS degree, string_agg(CAST(d AS VARCHAR) || ':' || CAST(CAST(w AS INT) AS VARCHAR), ',' ORDER BY d) AS neighbours FROM knows GROUP BY 1", "key degree neighbours")
def csr_rows(g):
    return A.csr_rows(g, "knows", "weight").select(key_of(F.col("id")), "degree", F.array_join(F.transform("neighbours", lambda n: F.concat_ws(":", key_of(n["node"]), n["weight"].cast("int"))), ","))


@built(f"WITH {KNOWS} SELECT s AS key, CAST(sum(count(*)) OVER (ORDER BY s) - count(*) AS BIGINT) AS row_offset FROM knows GROUP BY 1", "key row_offset")
def csr_arrays(g):
    return A.csr_arrays(g, "knows").select(key_of(F.col("id")), "row_offset")


def _pagerank_sql(rounds: int) -> str:
    steps = "".join(f", r{i + 1} AS (SELECT c_custkey AS v, 0.15 / n + 0.85 * coalesce(x, 0) AS rank FROM customer CROSS JOIN (SELECT count(*) AS n FROM customer) LEFT JOIN (SELECT d, sum(rank / 2) AS x FROM knows JOIN r{i} ON s = v GROUP BY d) ON d = c_custkey)" for i in range(rounds))
    return f"WITH {KNOWS}, r0 AS (SELECT c_custkey AS v, 1.0 / n AS rank FROM customer CROSS JOIN (SELECT count(*) AS n FROM customer)){steps} SELECT v AS key, round(rank * 1e6, 3) AS ppm FROM r{rounds}"


@built(_pagerank_sql(5), "key ppm")
def pagerank(g):
    return A.pagerank(g, "knows", iterations=5).select(key_of(F.col("id")), F.round(F.col("rank") * 1e6, 3))


@built("SELECT conv_id * 1000 + turn AS key, conv_id * 1000 AS component FROM conversations", "key component")
def connected_components(g):
    return A.connected_components(g, "replyOf").select(key_of(F.col("id")), key_of(F.col("component")))


@built("SELECT conv_id * 1000 + turn AS key, conv_id * 1000 AS component FROM conversations", "key component")
def components_set_text(g):
    """A SET algorithm by the text language; its result has the nodes that the input names."""
    return run(g, "Algorithm([ConnectedComponents, SET, 'replyOf'], NodeScan('Message'))").select(key_of(F.col("_0")), key_of(F.col("_1")))


@built("SELECT c_custkey AS ckey, arg_min(event_id, (ts, event_id)) AS tkey FROM events JOIN customer ON user_id = c_custkey WHERE ts IS NOT NULL GROUP BY 1", "ckey tkey")
def oldest_tweet(g):
    """Events as tweets of their customers, each with a time of creation."""
    g = g.with_nodes(Tweet=g.nodes["Event"].withColumnRenamed("ts", "created_at"))
    return run(g, "Project([$0.key:uint64, $1.key:uint64], Algorithm([OldestTweet, TUPLE], NodeScan('Customer')))")


@built("SELECT s_suppkey AS skey, count(*) AS n FROM supplier JOIN (SELECT s_suppkey AS k FROM supplier UNION ALL SELECT l_suppkey FROM lineitem) ON k = s_suppkey GROUP BY 1", "skey n")
def foreach_any_type(g):
    """A hop over relationships of every type, in both directions."""
    q = Query(g).all_nodes("Supplier")
    return q.all_relationships().df().groupBy(F.col("_0.key")).agg(F.count(F.lit(1)).alias("n"))


@built("SELECT p_partkey AS key, count(*) AS n FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_size = 7 GROUP BY 1", "key n")
def match_indexed(g):
    """A pattern whose first node has an indexed property; the index is a filter that reaches the scan."""
    return run(g.create_index("Part", "size"), "GroupBy([$0.key:uint64], [count($1.linenumber:int)], Match((p:Part { size: 7 })<-[:contains]-(o:Order)))")


@built(f"WITH {KNOWS} SELECT a.s AS key, count(*) AS n FROM knows a JOIN knows b ON b.s = a.d AND b.d = a.s GROUP BY 1", "key n")
def match_cycle(g):
    """A name that a pattern repeats is one node."""
    return run(g, "GroupBy([$0.key:uint64], [count($2.key:uint64)], Match((a:Customer)-[:knows]->(b:Customer)-[:knows]->(a:Customer)))")


# importers: tables written as CSV and read back


def _as_csv(df, name, sep):
    from graphloom.storage import shared_path

    path = f"{shared_path(df.sparkSession, 'csv')}/{name}.csv"
    df.write.csv(path, header=True, sep=sep, quote='"', escape='"')
    return path


def _empty(g):
    return PropertyGraph(g.spark, {}, {})


def _ldbc(g, strict):
    from graphloom.sources import csv

    customers = _as_csv(g.nodes["Customer"].select(F.col("key").alias("id"), "name", "acctbal", "mktsegment"), "customer", "|")
    nations = _as_csv(g.nodes["Nation"].select(F.col("key").alias("id"), "name"), "nation", "|")
    lives = g.rels["livesIn"].select(key_of(F.col("src")).alias("Customer.id"), key_of(F.col("dst")).alias("Nation.id"), (key_of(F.col("src")) % 10 + 1).alias("years"))
    out = csv.import_nodes(csv.import_nodes(_empty(g), "Customer", customers, strict=strict), "Nation", nations, strict=strict)
    return csv.import_relationships(out, _as_csv(lives, "customer_livesIn_nation", "|"), strict=strict)


LIVES = "SELECT c_custkey AS ckey, c_name AS name, {} AS acctbal, {} AS years, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey"
READ_LIVES = "Match((c:Customer)-[:livesIn]->(n:Nation))"


def _lives(g):
    return run(g, READ_LIVES).select("_0.own_id", "_0.name", "_0.acctbal", "_1.years", "_2.name")


@built(LIVES.format("CAST(c_acctbal AS DOUBLE)", "CAST(c_custkey % 10 + 1 AS INT)"), "ckey name acctbal years nation")
def import_typed(g):
    return _lives(_ldbc(g, True))


@built(LIVES.format("CAST(CAST(c_acctbal AS DOUBLE) AS VARCHAR)", "CAST(c_custkey % 10 + 1 AS VARCHAR)"), "ckey name acctbal years nation")
def import_untyped(g):
    """All properties stay text; amounts are compared as numbers read from it."""
    return _lives(_ldbc(g, False)).withColumn("acctbal", F.col("acctbal").cast("double").cast("string"))


@built("SELECT p_name AS part, p_size AS size, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_partkey, p_name, p_size", "part size n lines")
def import_neo(g):
    from graphloom.sources import csv

    parts = _as_csv(g.nodes["Part"].select(F.concat(F.lit("p"), "key").alias("part:ID"), "name", "size"), "parts", ",")
    orders = _as_csv(g.nodes["Order"].select(F.concat(F.lit("o"), "key").alias("order:ID"), "status"), "orders", ",")
    lines = _as_csv(g.rels["contains"].select(F.concat(F.lit("o"), key_of(F.col("src"))).alias(":START_ID"), F.concat(F.lit("p"), key_of(F.col("dst"))).alias(":END_ID"), F.lit("CONTAINS").alias(":TYPE"), "linenumber"), "lines", ",")
    out = csv.import_neo_relationships(csv.import_neo_nodes(csv.import_neo_nodes(_empty(g), "Part", parts), "Order", orders), lines)
    return run(out, "Match((o:Order)-[:CONTAINS]->(p:Part))").groupBy("_2.part", "_2.name", "_2.size").agg(F.count(F.lit(1)).alias("n"), F.sum("_1.linenumber").alias("lines")).select("name", "size", "n", "lines")


@built("SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey", "nation region")
def import_rows(g):
    """Nodes and relationships added by the program."""
    out = U.add_nodes(U.add_nodes(_empty(g), "Nation", g.nodes["Nation"]), "Region", g.nodes["Region"])
    return run(U.add_rels(out, "isPartOf", g.rels["isPartOf"]), "Match((n:Nation)-[:isPartOf]->(r:Region))").select("_0.name", "_2.name")


# output


@built(" UNION ALL ".join(f"SELECT 'node' AS kind, '{n}' AS label, count(*) AS rows FROM {t}" for n, t in ALL_LABELS.items()) + " UNION ALL SELECT 'relationship', 'isPartOf', count(*) FROM nation UNION ALL SELECT 'relationship', 'contains', count(*) FROM lineitem", "kind label rows")
def graph_stats(g):
    return g.stats().where("kind = 'node' or label in ('isPartOf', 'contains')")


@built("SELECT '  n' || (2000000000000 + n_nationkey) || ' [label=\"Nation\"];' AS line FROM nation UNION ALL SELECT '  n' || (1000000000000 + r_regionkey) || ' [label=\"Region\"];' FROM region UNION ALL SELECT '  n' || (2000000000000 + n_nationkey) || ' -> n' || (1000000000000 + n_regionkey) || ' [label=\"isPartOf\"];' FROM nation", "line")
def dot_export(g):
    from graphloom.sources.dot import dot_lines

    part = PropertyGraph(g.spark, {k: g.nodes[k] for k in ("Nation", "Region")}, {"isPartOf": g.rels["isPartOf"]})
    return dot_lines(part).select("value")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
