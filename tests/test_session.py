"""Transactions, lookups, errors, saved graphs and the command line."""

import pytest

from graphloom import cli
from graphloom.errors import OrphanedRelationship, QueryProcessingError, UdfNotFound, UnknownId, UnknownIndex
from graphloom.functions import registry
from graphloom.graph import Session
from graphloom.operators import updates as U
from graphloom.operators.lower import run
from graphloom.plans.builder import Query
from graphloom.sources.tables import from_rows, open_saved, save


@pytest.fixture
def graph(spark):
    nodes = {"Book": ("id long, title string, pages int", [(1, "First", 90), (2, "Second", None)]), "Shelf": ("id long, room string", [(10, "cellar")])}
    return from_rows(spark, nodes, {"standsOn": ("id long, src long, dst long, place int", [(5, 1, 10, 3)])})


def titles(g):
    return sorted(r.title for r in g.node_table("Book").collect())


def test_commit_and_abort(graph):
    s = Session(graph)
    s.begin()
    s.update(U.apply(s.graph, "Create((b:Book { title: 'Third' }))"))
    assert titles(s.graph) == ["First", "Second", "Third"]
    s.abort()
    assert titles(s.graph) == ["First", "Second"]
    s.run(lambda g: U.apply(g, "Create((b:Book { title: 'Fourth' }))"))
    assert titles(s.graph) == ["First", "Fourth", "Second"]


def test_a_failing_change_leaves_nothing(graph):
    s = Session(graph)

    def change(g):
        g = U.apply(g, "Create((b:Book { title: 'Lost' }))")
        return U.apply(g, "RemoveNode(NodeScan('Shelf'))")

    with pytest.raises(OrphanedRelationship):
        s.run(change)
    assert titles(s.graph) == ["First", "Second"]


def test_inner_transactions(graph):
    s = Session(graph)
    s.begin()
    s.update(U.apply(s.graph, "Create((b:Book { title: 'Outer' }))"))
    s.begin()
    s.update(U.apply(s.graph, "Create((b:Book { title: 'Inner' }))"))
    s.abort()
    assert titles(s.commit()) == ["First", "Outer", "Second"]


def test_lookups(graph):
    assert graph.node(1) == {"id": 1, "label": "Book", "title": "First", "pages": 90}
    assert graph.node(2) == {"id": 2, "label": "Book", "title": "Second"}
    assert graph.relationship(5) == {"id": 5, "src": 1, "dst": 10, "label": "standsOn", "place": 3}
    for missing in (lambda: graph.node(99), lambda: graph.relationship(99)):
        with pytest.raises(UnknownId):
            missing()


def test_new_ids_follow_the_largest(graph):
    g = U.apply(graph, "Create((b:Book { title: 'Third' }))")
    assert g.node_table("Book").where("title = 'Third'").first().id > 10
    empty = U.apply(from_rows(graph.spark, {}, {}), "Create((b:Book { title: 'Only' }))")
    assert [r.id >= 0 for r in empty.node_table("Book").collect()] == [True]  # ids leave gaps between partitions


def test_errors(graph):
    with pytest.raises(UnknownIndex):
        run(graph, "IndexScan('Book', 'title', 'First')").collect()
    indexed = graph.create_index("Book", "title")
    assert run(indexed, "IndexScan('Book', 'title', 'First')").count() == 1 and indexed.has_index("Book", "title")
    assert not indexed.drop_index("Book", "title").has_index("Book", "title")
    with pytest.raises(UdfNotFound):
        run(graph, "Project([udf::missing($0.pages:int)], NodeScan('Book'))").collect()
    with pytest.raises(UdfNotFound):
        run(graph, "Algorithm([Missing, TUPLE], NodeScan('Book'))").collect()
    with pytest.raises(QueryProcessingError):
        U.apply(graph, "NodeScan('Book')")


def test_saved_graph(graph, tmp_path):
    save(graph, str(tmp_path))
    g = open_saved(graph.spark, str(tmp_path), ["Book", "Shelf"], ["standsOn"])
    assert g.node(1) == graph.node(1) and g.relationship(5) == graph.relationship(5)
    assert Query(g).all_nodes("Book").from_relationships("standsOn").to_node("Shelf").df().count() == 1


def test_library_of_functions(graph):
    class Library:
        @staticmethod
        def twice(c):
            return c * 2

    registry.load_library(Library)
    assert run(graph, "Project([udf::twice($0.pages:int)], Filter($0.pages > 0, NodeScan('Book')))").collect()[0][0] == 180


def test_command_line(capsys, tmp_path):
    """Queries from a file that names another one, updates in between, explain and statistics."""
    inner = tmp_path / "inner.q"
    inner.write_text("Create((r:Region { name: 'ATLANTIS', key: 77 }))\n\n")
    script = tmp_path / "script.q"
    script.write_text(f"help\n@{inner}\nProject([$0.name:string], Filter($0.key > 3, NodeScan('Region')))\n")
    cli.main(["/root/testdata/sf0.001", "-f", str(script)])
    out = capsys.readouterr().out
    assert "ATLANTIS" in out and "MIDDLE EAST" in out and "foreachrelationship" in out and "EUROPE" not in out
    cli.main(["/root/testdata/sf0.001", "-q", "Limit(1, NodeScan('Region'))", "--explain", "--stats"])
    out = capsys.readouterr().out
    assert "livesIn" in out and "Physical Plan" in out
