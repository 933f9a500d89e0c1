import re

import pytest
from pyspark.sql import functions as F

from graphloom.llm import exact_dedup as D
from graphloom.llm.exact_dedup import exact_dedup

ROWS = [(3, "a  b"), (1, "a\tb"), (2, "c"), (7, None), (5, ""), (6, "c"), (9, "a b"), (9, "a b"), (4, "x" * 50_000), (8, " ")]


def written(spark, tmp_path, rows):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").withColumns({"keep_id": F.lit("clash"), "digest": F.lit(1)}).write.parquet(path)
    return path


def test_groups_nulls_and_repeats(spark, tmp_path):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(spark, written(spark, tmp_path, ROWS)).collect()}
    assert got == {(3, 1, 4, False), (1, 1, 4, True), (9, 1, 4, False), (2, 2, 2, True), (6, 2, 2, False), (5, 5, 2, True), (7, 5, 2, False), (4, 4, 1, True), (8, 8, 1, True)}


def test_equal_digests_of_different_texts(spark, tmp_path):
    path = written(spark, tmp_path, ROWS)
    weak = exact_dedup(spark, path, digest=lambda c: F.substring(F.md5(c), 1, 0))
    strong = exact_dedup(spark, path)
    assert sorted(map(tuple, weak.collect())) == sorted(map(tuple, strong.collect()))


def test_empty(spark, tmp_path):
    assert exact_dedup(spark, written(spark, tmp_path, [])).count() == 0


def groups(rows):
    """(id, keep_id, group_size) by plain Python."""
    by_text = {}
    for i, t in rows:
        by_text.setdefault(re.sub("[ \t\n\x0b\x0c\r]+", " ", t or ""), []).append(i)
    return sorted((i, min(ids), len(ids)) for ids in by_text.values() for i in ids)


@pytest.mark.parametrize("digest", [D.sha256, lambda text: F.substring(text, 1, 1)])
def test_batches_and_a_later_call_go_on_from_the_state(spark, tmp_path, digest):
    """One file a batch; then a file with smaller ids comes and the same folder of state is named again."""
    path, home, schema = str(tmp_path / "documents.parquet"), str(tmp_path / "home"), "doc_id long, text string"
    parts = [[(50, "a  b"), (51, None), (52, "c")], [(40, "a b"), (41, "abc"), (42, "")], [(3, "a\tb"), (4, "c"), (5, "only")]]
    for part in parts[:2]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    read = lambda: sorted((r.doc_id, r.keep_id, r.group_size) for r in D.exact_dedup(spark, path, digest=digest, home=home, files=1).collect())
    assert read() == groups([x for p in parts[:2] for x in p])
    batches = {p.name for p in (tmp_path / "home" / "state").iterdir()}
    assert len(batches) == 3  # two and the empty one
    spark.createDataFrame(parts[2], schema).coalesce(1).write.mode("append").parquet(path)
    assert read() == groups([x for p in parts for x in p])
    later = {p.name for p in (tmp_path / "home" / "state").iterdir()} - batches
    assert later == {"batch=2"}
    assert spark.read.parquet(str(tmp_path / "home" / "state" / "batch=2")).count() == 3  # the new file's digests alone
