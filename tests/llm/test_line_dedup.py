import hashlib
import random

import pytest

from graphloom.llm import line_dedup as L

HOT = "This very line is shared by many of the documents here, é"
WHITE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def brute_force(rows):
    docs = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                docs.setdefault(key(line), set()).add(i)
    hot = {k: max(v) for k, v in docs.items() if len(v) >= 5}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if hot.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def corpus():
    r = random.Random(3)
    pool = [HOT, HOT.upper(), f"\t {HOT} \r", "short", "", *(f"a longer line of more than forty characters, number {i:03}" for i in range(30)), "x" * 39, "y" * 40, "\xa0" + "z" * 40]
    rows = [(i, "\n".join(r.choices(pool, k=r.choice([0, 1, 5, 200])))) for i in range(60)]
    return [*rows, (60, None), (61, ""), (62, "\n\n"), (63, "w" * 100_000), (64, HOT + "\n" + HOT)]


@pytest.mark.parametrize("hot_lines, hot_keys", [(100_000, 100_000), (1, 10), (1, 10**9), (100, 10**9)])
def test_against_brute_force(spark, monkeypatch, hot_lines, hot_keys):
    monkeypatch.setattr(L, "HOT_LINES", hot_lines)
    monkeypatch.setattr(L, "HOT_KEYS", hot_keys)
    rows = corpus()
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, keys string, id int")
    assert sorted(map(tuple, L.line_dedup_report(df).collect())) == brute_force(rows)
    kept = L.line_dedup(df)
    assert kept.columns == df.columns
    want = {i: h for i, _, _, h in brute_force(rows)}
    assert {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in kept.collect()} == want
    assert [r.text for r in kept.where("doc_id = 60").collect()] == [None]


def test_repeated_rows_count_once(spark):
    rows = [(1, HOT), (1, HOT), (2, HOT), (3, HOT), (4, HOT)]
    schema = "doc_id long, text string"
    assert {r.n_dropped for r in L.line_dedup_report(spark.createDataFrame(rows, schema)).collect()} == {0}
    rows += [(5, HOT), (None, HOT), (None, HOT)]
    got = sorted(((r.doc_id, r.n_dropped) for r in L.line_dedup_report(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 0), (None, 0), (None, 0)]


def test_rows_that_share_an_id_lose_their_own_lines(spark):
    rows = [(1, f"first\n{HOT}"), (1, f"{HOT}\nsecond\nthird"), *((i, HOT) for i in range(2, 6))]
    got = {r.text for r in L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 1").collect()}
    assert got == {"first", "second\nthird"}


def test_empty_table(spark):
    assert L.line_dedup_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def key_rows(spark):
    keyed = L.long_keys(spark.createDataFrame(corpus(), "doc_id long, text string"), "doc_id", "text", 40)
    return keyed.selectExpr("id", "text_hash", "posexplode(hashes) as (pos, h)").where("h is not null").select("id", "text_hash", "pos", "h.h1", "h.h2")


def test_hot_keys_stay_within_their_bound(spark, monkeypatch):
    monkeypatch.setattr(L, "HOT_LINES", 1)
    rows = key_rows(spark)
    n = rows.count()
    for most in [1, 3, 10]:
        monkeypatch.setattr(L, "HOT_KEYS", most)
        assert L.hot_keys(rows, n).count() <= most


def test_ranges_are_the_only_shuffle_of_lines(spark, capsys):
    L.in_ranges(key_rows(spark)).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange rangepartitioning") == plan.count("Exchange") == 1
