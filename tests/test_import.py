from graphloom.graph import PropertyGraph
from graphloom.sources import csv


def test_neo4j_style(spark, tmp_path):
    (tmp_path / "films.csv").write_text("title:ID,year\nOne (2001),2001\nTwo (2002),2002\n")
    (tmp_path / "cast.csv").write_text('name:ID\n"Doe, Jane"\n"Roe, Rick"\n')
    (tmp_path / "roles.csv").write_text(':START_ID,:END_ID,:TYPE\n"Doe, Jane",One (2001),PLAYED_IN\n"Roe, Rick",Two (2002),PLAYED_IN\nNobody,Two (2002),PLAYED_IN\n')
    g = csv.import_neo_nodes(PropertyGraph(spark, {}, {}), "Movie", str(tmp_path / "films.csv"))
    g = csv.import_neo_nodes(g, "Actor", str(tmp_path / "cast.csv"))
    g = csv.import_neo_relationships(g, str(tmp_path / "roles.csv"))
    assert (g.nodes["Movie"].count(), g.nodes["Actor"].count(), g.rels["PLAYED_IN"].count()) == (2, 2, 2)
    assert sorted(r.year for r in g.nodes["Movie"].collect()) == [2001, 2002]


def test_typed_columns_look_past_the_first_row(spark, tmp_path):
    (tmp_path / "post.csv").write_text("id|imageFile|creationDate|length\n1||2011-08-17T06:05:40.595+0000|12\n2|a.jpg|2011-08-18T06:05:40.595+0000|7\n")
    g = csv.import_nodes(PropertyGraph(spark, {}, {}), "Post", str(tmp_path / "post.csv"))
    kinds = dict(g.nodes["Post"].dtypes)
    assert kinds["imageFile"] == "string" and kinds["creationDate"].startswith("timestamp") and kinds["length"] in ("int", "bigint")
    assert g.nodes["Post"].where("imageFile IS NULL").count() == 1


def test_types_without_known_ends_are_left_out(spark, tmp_path, monkeypatch):
    """A type is there if any of its rows is linked; finding them joins all rows of types that a try does not settle only."""
    (tmp_path / "n.csv").write_text("key:ID\n" + "".join(f"n{i}\n" for i in range(20)))
    rare = "".join(f"n{i},x{i},RARE\n" for i in range(20)) + "n1,n2,RARE\n"
    (tmp_path / "r.csv").write_text(":START_ID,:END_ID,:TYPE\n" + rare + "n1,x,NONE\n" + "".join(f"n{i},n{i + 1},OFTEN\n" for i in range(19)))
    tried = []
    monkeypatch.setattr(csv, "_linked_types", lambda *a, real=csv._linked_types: tried.append(1) or real(*a))
    g = csv.import_neo_relationships(csv.import_neo_nodes(PropertyGraph(spark, {}, {}), "N", str(tmp_path / "n.csv")), str(tmp_path / "r.csv"))
    assert {t: df.count() for t, df in g.rels.items()} == {"RARE": 1, "OFTEN": 19} and tried
