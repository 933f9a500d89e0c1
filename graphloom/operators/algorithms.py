"""Graph algorithms as iterative DataFrame jobs.

Frontiers and distances are tables; lineage is cut each round in shared storage; no graph is collected.  Ties between
paths go to the lexicographically smallest path of ids, so results do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.registry import register_algorithm
from graphloom.graph import PropertyGraph, node_struct, union_all
from graphloom.plans.expr import Env
from graphloom.storage import materialise


#: Frontier rows that may be broadcast; their number is counted first, and a row holds ids and at most a path.
BROADCAST_ROWS = 20_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """A table of so many rows, to be sent to the edges rather than the edges to it if it is small.

    A larger one is never sent: bytes in a shuffle say little of what paths take in the driver's memory.
    """
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


def distinct_edges(graph: PropertyGraph, type_=None, undirected: bool = False) -> DataFrame:
    """(node, to) computed once: rounds read it, none derives it again."""
    return materialise(edge_list(graph, type_, undirected).select(F.col("src").alias("node"), F.col("dst").alias("to")).distinct())


def edge_list(graph: PropertyGraph, type_=None, undirected: bool = False, weight: str | None = None) -> DataFrame:
    """(src, dst, w); a missing weight is 0."""
    rels = graph.rel_table(type_)
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight and weight in rels.columns else F.lit(0.0)
    edges = rels.select("src", "dst", w.alias("w"))
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")) if undirected else edges


def degrees(graph: PropertyGraph, nodes: DataFrame | None = None, type_=None) -> DataFrame:
    """(id, in_degree, out_degree) of each node."""
    nodes = graph.node_table().select("id") if nodes is None else nodes
    rels = graph.rel_table(type_)
    # both ends in one aggregation: a node meets one shuffle, not two
    ends = rels.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    counts = ends.groupBy("e.id").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))
    return nodes.join(counts, "id", "left").na.fill(0, ["in_degree", "out_degree"])


def bfs(graph: PropertyGraph, start: int | list[int], type_=None, undirected: bool = False, max_depth: int | None = None) -> DataFrame:
    """(start, id, level) of every node within reach of each start."""
    starts = [start] if isinstance(start, int) else list(start)
    return bfs_from(graph, graph.spark.createDataFrame([(s,) for s in starts], "start long"), type_, undirected, max_depth)


def bfs_from(graph: PropertyGraph, starts: DataFrame, type_=None, undirected: bool = False, max_depth: int | None = None) -> DataFrame:
    """The same for a table of starts."""
    edges = distinct_edges(graph, type_, undirected).toDF("id", "dst")
    seen = frontier = starts.select("start", F.col("start").alias("id"), F.lit(0).alias("level")).distinct()
    depth, rows = 0, frontier.count()
    while rows and (max_depth is None or depth < max_depth):
        depth += 1
        step = edges.join(small(frontier, rows), "id").select("start", F.col("dst").alias("id")).distinct()
        frontier = materialise(step.join(seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("level", F.lit(depth)))
        rows = frontier.count()
        seen = seen.unionByName(frontier)
    return seen


def path_bfs(graph: PropertyGraph, start: int, type_=None, undirected: bool = False, max_depth: int | None = None) -> DataFrame:
    """(id, path) with one shortest path to each node within reach."""
    edges = distinct_edges(graph, type_, undirected).toDF("id", "dst")
    seen = frontier = graph.spark.createDataFrame([(start, [start])], "id long, path array<long>")
    depth, rows = 0, 1
    while rows and (max_depth is None or depth < max_depth):
        depth += 1
        step = edges.join(small(frontier, rows), "id").select(F.col("dst").alias("id"), F.array_append("path", F.col("dst")).alias("path"))
        frontier = materialise(step.join(seen.select("id"), "id", "left_anti").groupBy("id").agg(F.min("path").alias("path")))
        rows = frontier.count()
        seen = seen.unionByName(frontier)
    return seen


def shortest_paths(graph: PropertyGraph, pairs: DataFrame, type_=None, undirected: bool = False, all_paths: bool = False, max_depth: int | None = None) -> DataFrame:
    """(src, dst, path, hops) for the distinct (src, dst) of ``pairs`` that a path connects; equal ends have none.

    All pairs go forward together: a frontier row is (src, node) with its smallest path, or all its paths.  A source
    leaves as soon as all its targets are met.
    """
    pairs = materialise(pairs.select("src", "dst").where("src <> dst").distinct())
    edges = distinct_edges(graph, type_, undirected)
    frontier = pairs.select("src", F.col("src").alias("node"), F.array("src").alias("path")).distinct()
    seen, found, left = frontier.select("src", "node"), [], pairs
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(left.select("src").distinct(), "src", "left_semi").join(edges, "node").select("src", F.col("to").alias("node"), F.array_append("path", F.col("to")).alias("path"))
        step = step.join(seen, ["src", "node"], "left_anti")
        frontier = materialise(step if all_paths else step.groupBy("src", "node").agg(F.min("path").alias("path")))
        if frontier.isEmpty():
            break
        hit = frontier.join(left.withColumnRenamed("dst", "node"), ["src", "node"]).select("src", F.col("node").alias("dst"), "path", F.lit(depth).cast("long").alias("hops"))
        found.append(hit)
        left = materialise(left.join(frontier.select("src", F.col("node").alias("dst")).distinct(), ["src", "dst"], "left_anti"))
        if left.isEmpty():
            break
        seen = seen.unionByName(frontier.select("src", "node").distinct())
    return union_all(found) if found else graph.spark.createDataFrame([], "src long, dst long, path array<long>, hops long")


#: Labels of a root that one round follows, however far they are; of more, the nearer half.
ROUND_ROWS = 1_000
#: A side with so many times the other's open labels waits.
LOPSIDED = 8
#: Sums of the same weights in another order differ by less.
EPS = 1e-9


def lightest_edges(graph: PropertyGraph, type_, undirected: bool, weight: str) -> DataFrame:
    """(node, to, w): the lightest of parallel edges, computed once."""
    return materialise(edge_list(graph, type_, undirected, weight).groupBy(F.col("src").alias("node"), F.col("dst").alias("to")).agg(F.min("w").alias("w")))


class Balls:
    """Distances around both ends of pairs, found from both ends at once and the nearest first.

    ``labels`` has (side, root, node, dist, open): side 0 goes forward from sources, side 1 back from targets; what is
    open has not been followed yet.  No distance below the lowest open one of its root can get lower.  A pair is settled
    when the lowest open distances of its two ends exceed its bound together: then each node of each path within the
    bound has a label of at least one side, and the far parts of the graph were never met.
    """

    def __init__(self, edges: DataFrame, pairs: DataFrame):
        self.edges, self.back = edges, edges.select(F.col("to").alias("node"), F.col("node").alias("to"), "w")
        self.labels = materialise(self._ends(pairs).select("side", "root", F.col("root").alias("node"), F.lit(0.0).alias("dist"), F.lit(True).alias("open")))

    @staticmethod
    def _ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.lit(0).alias("side"), F.col("src").alias("root")).unionByName(pairs.select(F.lit(1).alias("side"), F.col("dst").alias("root"))).distinct()

    def _side(self, side: int, root: str, dist: str) -> DataFrame:
        return self.labels.where(F.col("side") == side).select(F.col("root").alias(root), "node", F.col("dist").alias(dist), "open")

    def grow(self, pairs: DataFrame, k: int = 1) -> DataFrame:
        """Follows labels until each of ``pairs`` (src, dst, least) is settled; the connected ones as (src, dst, bound, ahead_low, back_low, ended).

        The bound is the ``k``-th weight of walks that differ in weight, ``least`` at least.  A pair has ended if one of its
        sides has nothing left to follow: all paths are within reach then.
        """
        while True:
            near = self._side(0, "src", "f").join(self._side(1, "dst", "b"), "node").join(pairs.select("src", "dst"), ["src", "dst"]).groupBy("src", "dst", F.round(F.col("f") + F.col("b"), 6).alias("about")).agg(F.min(F.col("f") + F.col("b")).alias("weight"))
            turn = Window.partitionBy("src", "dst").orderBy("about")
            near = near.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= k).groupBy("src", "dst").agg(F.min("weight").alias("weight"), F.max(F.when(F.col("turn") == k, F.col("weight"))).alias("kth"))
            low = self.labels.where("open").groupBy("side", "root").agg(F.min("dist").alias("low"))
            state = pairs.join(near, ["src", "dst"], "left")
            for side, root, name in ((0, "src", "ahead_low"), (1, "dst", "back_low")):
                state = state.join(low.where(F.col("side") == side).select(F.col("root").alias(root), F.col("low").alias(name)), root, "left")
            ended = F.col("ahead_low").isNull() | F.col("back_low").isNull()
            bound = F.greatest("kth", "least") * (1 + EPS)
            settled = ended | (F.col("kth").isNotNull() & (F.col("ahead_low") + F.col("back_low") > bound))
            state = materialise(state.select("src", "dst", "weight", "ahead_low", "back_low", bound.alias("bound"), ended.alias("ended"), settled.alias("settled")))
            left = state.where("not settled")
            if left.isEmpty():
                return state.where("weight is not null").select("src", "dst", "bound", "ahead_low", "back_low", "ended")
            self._follow(left)

    def _follow(self, pairs: DataFrame) -> None:
        """One round of the roots of ``pairs``."""
        roots = self.labels.where("open").join(self._ends(pairs), ["side", "root"], "left_semi")
        roots = materialise(roots.groupBy("side", "root").agg(F.percentile_approx("dist", F.lit(0.5), F.lit(1000)).alias("mid"), F.count(F.lit(1)).alias("n")))
        sums = {r["side"]: r for r in roots.groupBy("side").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("roots")).collect()}  # two rows
        turn = [s for s, r in sums.items() if 1 - s not in sums or r["n"] <= LOPSIDED * sums[1 - s]["n"]]
        roots = small(roots.where(F.col("side").isin(turn)), sum(r["roots"] for r in sums.values()))
        goes = (F.col("n") <= ROUND_ROWS) | (F.col("dist") <= F.col("mid"))
        marked = self.labels.join(roots, ["side", "root"], "left").withColumn("go", F.col("open") & F.coalesce(goes, F.lit(False)))
        go = small(marked.where("go").select("side", "root", "node", "dist"), sum(sums[s]["n"] for s in turn))
        edges = self.edges.select(F.lit(0).alias("side"), "node", "to", "w").unionByName(self.back.select(F.lit(1).alias("side"), "node", "to", "w"))
        step = go.join(edges, ["side", "node"]).groupBy("side", "root", F.col("to").alias("node")).agg(F.min(F.col("dist") + F.col("w")).alias("dist"))
        both = marked.select("side", "root", "node", "dist", (F.col("open") & ~F.col("go")).alias("open")).unionByName(step.withColumn("open", F.lit(True)))
        # of equal distances the one that was followed stays
        self.labels = materialise(both.groupBy("side", "root", "node").agg(F.min(F.struct("dist", "open")).alias("b")).select("side", "root", "node", "b.dist", "b.open"))

    def steps(self, state: DataFrame) -> DataFrame:
        """(src, dst, node, to, w, ahead, bound): the edges that paths within the bounds of ``state`` may take, ``ahead`` the distance from ``to`` to dst.

        The distances to targets go on from the labels of side 1, now for each pair alone and only where the way from
        the source and the way ahead fit the bound together.
        """
        bounds, behind = state.select("src", "dst", "bound", "ahead_low"), self._side(0, "src", "f").drop("open")

        def fitting(rows: DataFrame) -> DataFrame:
            way = F.when(F.col("ahead_low").isNull(), F.col("f")).otherwise(F.least("f", "ahead_low"))  # no label: at least the lowest open one
            return rows.join(behind, ["src", "node"], "left").where(F.col("dist") + way <= F.col("bound")).select("src", "dst", "bound", "ahead_low", "node", "dist", "open")

        rows = materialise(fitting(bounds.join(self._side(1, "dst", "dist"), "dst")))
        while n := rows.where("open").count():
            step = small(rows.where("open").drop("open"), n).join(self.back, "node").groupBy("src", "dst", "bound", "ahead_low", F.col("to").alias("node")).agg(F.min(F.col("dist") + F.col("w")).alias("dist"))
            both = rows.withColumn("open", F.lit(False)).unionByName(fitting(step.withColumn("open", F.lit(True))))
            rows = materialise(both.groupBy("src", "dst", "bound", "ahead_low", "node").agg(F.min(F.struct("dist", "open")).alias("b")).select("src", "dst", "bound", "ahead_low", "node", "b.dist", "b.open"))
        ends = rows.select("src", "dst", F.col("node").alias("to"), F.col("dist").alias("ahead"), "bound")
        return materialise(small(rows.select("src", "dst", "node"), rows.count()).join(self.edges, "node").join(ends, ["src", "dst", "to"]).select("src", "dst", "node", "to", "w", "ahead", "bound"))


def extended(go: DataFrame, rows: int, steps: DataFrame) -> DataFrame:
    """Each of ``rows`` simple paths of ``go`` one edge longer, if it can still meet its pair's bound."""
    step = small(go, rows).join(steps, ["src", "dst", "node"]).where(~F.array_contains("path", F.col("to"))).where(F.col("dist") + F.col("w") + F.col("ahead") <= F.col("bound"))
    return step.select("src", "dst", F.col("to").alias("node"), (F.col("dist") + F.col("w")).alias("dist"), F.array_append("path", F.col("to")).alias("path"), "ahead")


def weighted_shortest_paths(graph: PropertyGraph, pairs: DataFrame, type_=None, weight: str = "weight", undirected: bool = False, all_paths: bool = False) -> DataFrame:
    """(src, dst, path, hops, weight) by relaxation to a fixed point; weights are not negative, a missing one is 0.

    Weights are found first, from both ends and without paths; paths are made over edges of lightest paths only.
    """
    pairs = materialise(pairs.select("src", "dst").where("src <> dst").distinct())
    balls = Balls(lightest_edges(graph, type_, undirected, weight), pairs)
    state = balls.grow(pairs.withColumn("least", F.lit(0.0)))
    steps = balls.steps(state)
    best = F.struct("dist", F.size("path").alias("n"), "path", "open")
    known = state.select("src", "dst", F.col("src").alias("node"), F.lit(0.0).alias("dist"), F.array("src").alias("path"), F.lit(True).alias("open"))
    while n := known.where("open").count():
        step = extended(known.where("open"), n, steps).select("src", "dst", "node", "dist", "path", F.lit(True).alias("open"))
        both = known.withColumn("open", F.lit(False)).unionByName(step)
        if all_paths:  # every path that is no worse than the best known one
            known = both.withColumn("low", F.min("dist").over(Window.partitionBy("src", "dst", "node"))).where("dist = low").drop("low")
        else:
            known = both.groupBy("src", "dst", "node").agg(F.min(best).alias("b")).select("src", "dst", "node", "b.dist", "b.path", "b.open")
        known = materialise(known)
    return known.where("node = dst").select("src", "dst", "path", (F.size("path") - 1).cast("long").alias("hops"), F.col("dist").alias("weight"))


#: Partial paths of a pair that a round extends, for each answer that is asked for.
BEAM = 4


def k_shortest_paths(graph: PropertyGraph, pairs: DataFrame, k: int, type_=None, weight: str = "weight", undirected: bool = False) -> DataFrame:
    """(src, dst, rank, path, hops, weight): the ``k`` lightest simple paths of each pair.

    Answers are sought within a bound, the ``k``-th weight of a pair's walks.  Pairs that have fewer than ``k`` simple paths
    there go on with a bound half as large again, until they have them or a side has nothing left to follow.
    """
    pairs = materialise(pairs.select("src", "dst").where("src <> dst").distinct())
    balls = Balls(lightest_edges(graph, type_, undirected, weight), pairs)
    todo, found = pairs.withColumn("least", F.lit(0.0)), []
    while True:
        state = balls.grow(todo, k).withColumn("bound", F.when(F.col("ended"), F.lit(float("inf"))).otherwise(F.col("bound")))
        answers = _lightest_within(balls.steps(state), state, k)
        short = state.where("not ended").join(answers.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")), ["src", "dst"], "left").where(F.coalesce("n", F.lit(0)) < k)
        todo = materialise(short.select("src", "dst", (1.5 * (F.col("ahead_low") + F.col("back_low"))).alias("least")))
        found.append(answers.join(todo, ["src", "dst"], "left_anti"))
        if todo.isEmpty():
            break
    order = Window.partitionBy("src", "dst").orderBy("weight", F.size("path"), "path")
    return union_all(found).withColumn("rank", F.row_number().over(order)).select("src", "dst", "rank", "path", (F.size("path") - 1).cast("long").alias("hops"), "weight")


def _lightest_within(steps: DataFrame, state: DataFrame, k: int) -> DataFrame:
    """(src, dst, path, weight): at most ``k`` answers of each pair, no heavier than its bound.

    A partial simple path's own bound is its weight and the distance from its end to the target: no answer that begins
    with it is lighter.  Each round extends the partial paths of lowest bound only, ``BEAM * k`` of a pair and their
    ties; a pair is done when its k answers are no heavier than any bound.
    """
    partial = state.select("src", "dst", F.col("src").alias("node"), F.lit(0.0).alias("dist"), F.array("src").alias("path"), F.lit(0.0).alias("bound"))
    order = Window.partitionBy("src", "dst").orderBy("weight", F.size("path"), "path")
    by_bound = Window.partitionBy("src", "dst").orderBy("bound")
    answers = steps.sparkSession.createDataFrame([], "src long, dst long, path array<long>, weight double")
    while n := partial.count():
        ranked = partial.withColumn("turn", F.rank().over(by_bound) <= BEAM * k)
        step = materialise(extended(ranked.where("turn").drop("turn", "bound"), n, steps).withColumn("bound", F.col("dist") + F.col("ahead")).drop("ahead"))
        hits = step.where("node = dst").select("src", "dst", "path", F.col("dist").alias("weight"))
        answers = materialise(answers.unionByName(hits).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"))
        full = answers.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("worst")).where(F.col("n") >= k)
        left = ranked.where("not turn").drop("turn").unionByName(step.where("node <> dst"))
        # a partial path as heavy as the worst answer may still give an answer that comes before it among equals
        partial = materialise(left.join(full, ["src", "dst"], "left").where(F.col("worst").isNull() | (F.col("bound") <= F.col("worst") * (1 + EPS))).drop("n", "worst"))
    return answers


def csr_rows(graph: PropertyGraph, type_=None, weight: str | None = None, undirected: bool = False) -> DataFrame:
    """(id, degree, neighbours): outgoing neighbours with weights, ordered by id, of each node."""
    edges = edge_list(graph, type_, undirected, weight)
    lists = edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.col("dst").alias("node"), F.col("w").alias("weight")))).alias("neighbours"))
    ends = graph.end_labels(type_, 0)
    nodes = graph.node_table(None if ends is None or undirected else ends).select("id")
    return nodes.join(lists, "id", "left").select("id", F.coalesce(F.size("neighbours"), F.lit(0)).alias("degree"), "neighbours")


def csr_arrays(graph: PropertyGraph, type_=None, weight: str | None = None) -> DataFrame:
    """(id, row_offset, degree): where each node's edges begin in an edge array ordered by (source, target).

    Nodes are dealt into ranges of ids by sampled bounds, whatever the ids look like.  Offsets are running sums within
    ranges plus the sums of the ranges before; only range sums meet in one task.
    """
    rows = csr_rows(graph, type_, weight).select("id", "degree").repartitionByRange("id").withColumn("range", F.spark_partition_id())
    rows = materialise(rows)
    before = rows.groupBy("range").agg(F.sum("degree").alias("n")).select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("base"))
    within = F.sum("degree").over(Window.partitionBy("range").orderBy("id")) - F.col("degree")
    return rows.withColumn("within", within).join(before, "range").select("id", (F.col("base") + F.col("within")).alias("row_offset"), "degree")


def pagerank(graph: PropertyGraph, type_=None, iterations: int = 10, damping: float = 0.85, labels=None) -> DataFrame:
    """(id, rank) by power iteration; the rank of nodes without outgoing edges is spread over all nodes."""
    ends = graph.end_labels(type_, 0)
    nodes = materialise(graph.node_table(labels or ends).select("id"))
    n = nodes.count()
    edges = edge_list(graph, type_).select("src", "dst")
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    links = materialise(edges.join(out, "src"))
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    sinks = materialise(nodes.join(out, nodes["id"] == out["src"], "left_anti"))
    for _ in range(iterations):
        given = links.join(ranks, links["src"] == ranks["id"]).groupBy("dst").agg(F.sum(F.col("rank") / F.col("out")).alias("in_rank"))
        lost = F.broadcast(ranks.join(sinks, "id", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost")))  # one row
        ranks = nodes.join(given, nodes["id"] == given["dst"], "left").crossJoin(lost).select("id", ((1 - damping) / n + damping * (F.coalesce("in_rank", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))
        ranks = materialise(ranks)
    return ranks


def connected_components(graph: PropertyGraph, type_=None, labels=None) -> DataFrame:
    """(id, component): the smallest id of each weakly connected component, by large and small stars."""
    ends = graph.end_labels(type_, 0)
    nodes = graph.node_table(labels or (sorted({*ends, *graph.end_labels(type_, 1)}) if ends else None)).select("id")
    raw = edge_list(graph, type_)
    edges = materialise(raw.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct())
    state = None

    def lowest(e: DataFrame) -> DataFrame:
        low = e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return e.join(low, "u")

    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = lowest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = lowest(large)
        edges = materialise(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("u", "v"), 24))).first()
        if now == state:
            break
        state = now
    return nodes.join(edges, nodes["id"] == edges["u"], "left").select("id", F.coalesce("v", "id").alias("component"))


# algorithms by name


def _next(df: DataFrame) -> int:
    return len(df.columns)


def _num_links(graph: PropertyGraph, df: DataFrame, env: Env, type_=None) -> DataFrame:
    n = _next(df)
    ids = df.select(env.ident(-1).alias("id")).distinct()
    found = degrees(graph, ids, type_).select(F.col("id").alias("__id"), F.col("in_degree").alias(f"_{n}"), F.col("out_degree").alias(f"_{n + 1}"))
    return df.join(found, env.ident(-1) == F.col("__id")).drop("__id")


def arg_min_neighbour(graph: PropertyGraph, df: DataFrame, env: Env, type_=None, label: str | None = None, prop: str = "created_at") -> DataFrame:
    """Appends the source, of the given label, of an incoming relationship with the smallest property; none drops the row."""
    n = _next(df)
    sources = graph.node_table(label)
    if prop not in sources.columns:
        return df.withColumn(f"_{n}", F.lit(None).cast("long")).limit(0)
    rels = graph.rel_table(type_).select(F.col("src").alias("__src"), F.col("dst").alias("__dst"))
    best = rels.join(sources, F.col("__src") == F.col("id")).where(F.col(prop).isNotNull()).groupBy("__dst").agg(F.min_by(node_struct(sources), F.struct(F.col(prop), F.col("id"))).alias(f"_{n}"))
    return df.join(best, env.ident(-1) == F.col("__dst")).drop("__dst")


def _pairs(df: DataFrame, env: Env, i: int = -2, j: int = -1) -> DataFrame:
    return df.select(env.ident(i).alias("src"), env.ident(j).alias("dst"))


def with_paths(df: DataFrame, a: Column, b: Column, found: DataFrame, value: str) -> DataFrame:
    n = _next(df)
    side = found.select(F.col("src").alias("__a"), F.col("dst").alias("__b"), F.col(value).alias(f"_{n}"))
    return df.join(side, (a == F.col("__a")) & (b == F.col("__b"))).drop("__a", "__b")


def _shortest(graph, df, env, type_=None, both=0, all_=0):
    return with_paths(df, env.ident(-2), env.ident(-1), shortest_paths(graph, _pairs(df, env), type_, bool(both), bool(all_)), "path")


def _weighted(graph, df, env, type_=None, weight="weight", both=0, all_=0):
    return with_paths(df, env.ident(-2), env.ident(-1), weighted_shortest_paths(graph, _pairs(df, env), type_, weight, bool(both), bool(all_)), "path")


def _weight_only(graph, df, env, type_=None, weight="weight", both=0):
    return with_paths(df, env.ident(-2), env.ident(-1), weighted_shortest_paths(graph, _pairs(df, env), type_, weight, bool(both)), "weight")


def _k_shortest(graph, df, env, k=2, type_=None, weight="weight", both=0):
    return with_paths(df, env.ident(-2), env.ident(-1), k_shortest_paths(graph, _pairs(df, env), k, type_, weight, bool(both)), "weight")


def _csr(graph, df, env, type_=None, weight=None, both=0):
    n = _next(df)
    rows = csr_rows(graph, type_, weight, bool(both)).toDF("__id", f"_{n}", f"_{n + 1}")
    return df.join(rows, env.ident(-1) == F.col("__id")).drop("__id")


def _bfs(graph, df, env, type_=None, both=0, max_depth=None):
    """Each input node is a start; appends (node id, level) rows."""
    n = _next(df)
    seen = bfs_from(graph, df.select(env.ident(-1).alias("start")), type_, bool(both), max_depth)
    side = seen.toDF("__start", f"_{n}", f"_{n + 1}")
    return df.join(side, env.ident(-1) == F.col("__start")).drop("__start")


def _as_set(fn):
    def run(graph, df, env, *args):
        kind = df.schema.fields[-1].dataType
        ids = df.select(env.ident(-1).alias("id")).distinct() if isinstance(kind, T.StructType) else None
        out = fn(graph, *args)
        out = out if ids is None else out.join(ids, "id", "left_semi")
        return out.toDF(*(f"_{i}" for i in range(len(out.columns))))

    return run


for _name, _fn in {"NumLinks": _num_links, "ArgMinNeighbour": arg_min_neighbour, "ShortestPath": _shortest, "WeightedShortestPath": _weighted, "WeightedShortestPathWeight": _weight_only, "KShortestPath": _k_shortest, "CSR": _csr, "BFS": _bfs}.items():
    register_algorithm(_name, "TUPLE", _fn)
register_algorithm("OldestTweet", "TUPLE", lambda graph, df, env: arg_min_neighbour(graph, df, env, None, "Tweet", "created_at"))
for _name, _fn in {"PageRank": pagerank, "ConnectedComponents": connected_components}.items():
    register_algorithm(_name, "SET", _as_set(_fn))
