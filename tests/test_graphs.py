"""Random small graphs against plain Python that lists all walks and simple paths."""

import random
from itertools import product

import pytest

from graphloom.operators import algorithms as A
from graphloom.operators.lower import run
from graphloom.plans.builder import Query, var
from graphloom.sources.tables import from_rows

STOPS, KINDS = 9, ("road", "rail")


@pytest.fixture(scope="module")
def links():
    """(id, kind, src, dst, cost): some double, some loops; stop 8 has no way out and none in."""
    r = random.Random(19)
    return [(i, r.choice(KINDS), r.randrange(STOPS - 1), r.randrange(STOPS - 1), float(r.randint(1, 6))) for i in range(20)]


@pytest.fixture(scope="module")
def graph(spark, links):
    rels = {k: ("id long, src long, dst long, cost double", [(i, a, b, c) for i, kind, a, b, c in links if kind == k]) for k in KINDS}
    return from_rows(spark, {"Stop": ("id long, name string, zone int", [(i, f"stop {i}", i % 3) for i in range(STOPS)])}, rels)


def arrows(links, kind, both):
    found = [(a, b, c) for _, k, a, b, c in links if kind in (None, k)]
    return found + [(b, a, c) for a, b, c in found] * both


def simple_paths(links, kind, both, start):
    """Each simple path from the start with its cost, over the cheapest of parallel arrows."""
    cheapest = {}
    for a, b, c in arrows(links, kind, both):
        cheapest[a, b] = min(c, cheapest.get((a, b), c))
    out, open_ = [], [((start,), 0.0)]
    while open_:
        path, cost = open_.pop()
        for (a, b), c in cheapest.items():
            if a == path[-1] and b not in path:
                out.append(((*path, b), cost + c))
                open_.append(out[-1])
    return out


WAYS = [(k, b) for k in (None, *KINDS) for b in (False, True)]


@pytest.mark.parametrize(("kind", "both"), WAYS)
def test_levels_and_first_paths(graph, links, kind, both):
    want = {0: (0,)}
    for path, _ in simple_paths(links, kind, both, 0):
        old = want.get(path[-1])
        if old is None or (len(path), path) < (len(old), old):
            want[path[-1]] = path
    assert {r.id: r.level for r in A.bfs(graph, 0, kind, both).collect()} == {k: len(p) - 1 for k, p in want.items()}
    assert {r.id: tuple(r.path) for r in A.path_bfs(graph, 0, kind, both).collect()} == want
    assert {r.id: r.level for r in A.bfs(graph, 0, kind, both, max_depth=1).collect()} == {k: len(p) - 1 for k, p in want.items() if len(p) <= 2}


def ends(spark):
    return spark.createDataFrame([p for p in product((0, 3), range(STOPS))], "src long, dst long")


@pytest.mark.parametrize(("kind", "both"), [(None, False), ("road", True)])
def test_paths_between_pairs(spark, graph, links, kind, both):
    shortest, lightest, ranked = set(), set(), set()
    for s, d in product((0, 3), range(STOPS)):
        paths = [p for p in simple_paths(links, kind, both, s) if p[0][-1] == d]
        if paths:
            shortest |= {p for p, _ in paths if len(p) == min(len(q) for q, _ in paths)}
            lightest |= {p for p in paths if p[1] == min(c for _, c in paths)}
            ranked |= {(*x, i + 1) for i, x in enumerate(sorted(paths, key=lambda x: (x[1], len(x[0]), x[0]))[:3])}
    pairs = ends(spark)
    assert {tuple(r.path) for r in A.shortest_paths(graph, pairs, kind, both, all_paths=True).collect()} == shortest
    one = [tuple(r.path) for r in A.shortest_paths(graph, pairs, kind, both).collect()]
    assert sorted(one) == sorted({(p[0], p[-1]): p for p in sorted(shortest, reverse=True)}.values())
    assert {(tuple(r.path), r.weight) for r in A.weighted_shortest_paths(graph, pairs, kind, "cost", both, all_paths=True).collect()} == lightest
    first = {(p[0], p[-1]): (p, c) for p, c in sorted(lightest, key=lambda x: (len(x[0]), x[0]), reverse=True)}
    assert {(tuple(r.path), r.weight) for r in A.weighted_shortest_paths(graph, pairs, kind, "cost", both).collect()} == set(first.values())
    assert {(tuple(r.path), r.weight, r["rank"]) for r in A.k_shortest_paths(graph, pairs, 3, kind, "cost", both).collect()} == ranked


@pytest.mark.parametrize(("low", "high"), [(1, 1), (2, 3), (3, 6), (1, None)])
def test_walks(graph, links, low, high):
    want = set()
    for origin in range(STOPS):
        front = {origin}
        for depth in range(1, (high or 40) + 1):
            step = [(i, b) for i, kind, a, b, _ in links if kind == "road" and a in front]
            if depth >= low:
                want |= {(origin, i) for i, _ in step}
            front = {b for _, b in step}
    out = Query(graph).all_nodes("Stop").from_relationships("road", (low, high)).project(lambda e: e.ident(0), lambda e: e.prop(1, "id")).df()
    assert sorted(map(tuple, out.collect())) == sorted(want)
    back = Query(graph).all_nodes("Stop").to_relationships("road", (low, high)).project(lambda e: e.prop(1, "id")).df()
    if low == 1:
        assert {r[0] for r in back.collect()} == {i for i, kind, *_ in links if kind == "road"}


def test_three_forms_of_a_hop(graph, links):
    forms = [
        run(graph, "Match((a:Stop)-[:rail]->(b:Stop))"), run(graph, "Expand(OUT, 'Stop', ForeachRelationship(FROM, 'rail', NodeScan('Stop')))"),
        Query(graph).all_nodes("Stop").from_relationships("rail").to_node("Stop").df(),
    ]
    want = sorted((a, i, b) for i, kind, a, b, _ in links if kind == "rail")
    assert [sorted((r[0].id, r[1].id, r[2].id) for r in f.collect()) for f in forms] == [want] * 3


def test_a_repeated_name_is_one_node(graph, links):
    got = run(graph, "Match((a:Stop)-[:road]->(b:Stop)-[:rail]->(a:Stop))").select("_0.id", "_1.id", "_2.id", "_3.id", "_4.id")
    want = [(a, i, b, j, a) for i, k, a, b, _ in links for j, m, c, d, _ in links if (k, m) == ("road", "rail") and c == b and d == a]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_groups(graph):
    got = run(graph, "GroupBy([$0.zone:int], [count($0.name:string), sum($0.zone:int), min($0.name:string), max($0.name:string)], NodeScan('Stop'))")
    assert sorted(map(tuple, got.collect())) == [(z, 3, 3 * z, f"stop {z}", f"stop {z + 6}") for z in range(3)]


def test_offsets_of_hashed_ids(spark):
    """Ids far apart, as importers make them: offsets count on in the order of ids."""
    r = random.Random(2)
    ids = [r.randrange(-(1 << 63), 1 << 63) for _ in range(300)]
    rows = [(i, r.choice(ids), r.choice(ids)) for i in range(900)]
    g = from_rows(spark, {"N": ("id long", [(i,) for i in ids])}, {"e": ("id long, src long, dst long", rows)})
    at = 0
    for row in A.csr_arrays(g, "e").orderBy("id").collect():
        assert (row.row_offset, row.degree) == (at, sum(s == row.id for _, s, _ in rows))
        at += row.degree
    assert at == 900


def test_projection_by_position(graph):
    rows = Query(graph).all_nodes("Stop").property("zone", lambda c: c == 1).project(var(0, "name")).df().collect()
    assert sorted(r[0] for r in rows) == ["stop 1", "stop 4", "stop 7"]
