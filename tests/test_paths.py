"""Weighted paths on graphs of which a search need not see all."""

import heapq
import random

import pytest

from graphloom.operators import algorithms as A
from graphloom.sources.tables import from_rows

NODES = 3000


@pytest.fixture(scope="module")
def links():
    """Two arrows of fractional weights, some of none, from each node to later and earlier ones; 7 and 9 only lead away."""
    r = random.Random(5)
    targets = [n for n in range(NODES) if n not in (7, 9)]
    return [(s, r.choice(targets), r.choice([0.0, *(r.random() * 9 for _ in range(20))])) for s in range(NODES) for _ in range(2)]


@pytest.fixture(scope="module")
def graph(spark, links):
    return from_rows(spark, {}, {"road": ("id long, src long, dst long, cost double", [(i, *link) for i, link in enumerate(links)])})


def lightest(links, start):
    out = {}
    for a, b, c in links:
        out.setdefault(a, []).append((b, c))
    seen, heap = {}, [(0.0, start)]
    while heap:
        d, n = heapq.heappop(heap)
        if n not in seen:
            seen[n] = d
            for b, c in out.get(n, []):
                heapq.heappush(heap, (d + c, b))
    return seen


@pytest.fixture
def sizes(monkeypatch):
    """Rows of each table that is computed, by whether it holds paths or distances."""
    found, real = {"path": 0, "dist": 0}, A.materialise

    def counted(df):
        out = real(df)
        for c in found:
            found[c] = max(found[c], out.count() if c in out.columns else 0)
        return out

    monkeypatch.setattr(A, "materialise", counted)
    return found


PAIRS = [(0, 2500), (3, 2500), (0, 7)]


def weights(links):
    return {(s, d): lightest(links, s)[d] for s, d in PAIRS if d in lightest(links, s)}


def test_paths_are_not_made_for_the_whole_graph(spark, graph, links, sizes):
    """Few paths are made and none for an unreachable target; before, each node had one."""
    got = {(r.src, r.dst): (r.weight, r.path) for r in A.weighted_shortest_paths(graph, spark.createDataFrame(PAIRS, "src long, dst long"), "road", "cost").collect()}
    assert {p: w for p, (w, _) in got.items()} == pytest.approx(weights(links)) and set(got) == {(0, 2500), (3, 2500)}
    cost = {}
    for a, b, c in links:
        cost[a, b] = min(c, cost.get((a, b), c))
    assert all(p[0] == s and p[-1] == d and sum(cost[e] for e in zip(p, p[1:])) == pytest.approx(w) for (s, d), (w, p) in got.items())
    assert sizes["path"] < 300
