import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.llm import fingerprints as P

WORDS = [f"word{i}" for i in range(400)]


def corpus():
    r = random.Random(8)
    rows = [(i * 7 + r.randrange(7), "\n".join(" ".join(r.choices(WORDS, k=r.randint(3, 30))) for _ in range(r.randint(1, 12)))) for i in range(60)]
    return [*rows, (1000, None), (1001, ""), (1002, "é" * 9), (1003, "long " * 20_000), (1004, rows[0][1]), (5_000_000, "far away from all the others")]


def edited(rows):
    rows = sorted((i, t or "") for i, t in rows)
    out = {}
    for k, (i, t) in enumerate(rows):
        n = len(t) // 4
        out[i] = t[: len(t) - n] + rows[(k + 1) % len(rows)][1][:n]
    return out


def plain_pairs(text):
    """Frequencies of pairs of neighbouring words, a paragraph's first with its start."""
    out = Counter()
    for line in text.split("\n"):
        words = re.findall("[^ \t\r\x0b\x0c]+", line)
        out.update(zip(["\n", *words], words))
    return out


def plain_likeness(a, b):
    a, b = plain_pairs(a), plain_pairs(b)
    norm = lambda c: sum(v * v for v in c.values())
    apart = sum((a[k] - b[k]) ** 2 for k in a | b)
    return 1.0 if not apart else max(0.0, 1 - apart / (norm(a) + norm(b)))


@pytest.mark.parametrize("partitions", [1, 5])
def test_report(spark, partitions):
    rows = corpus()
    schema = "doc_id long, text string, fingerprint string, id int"
    got = {r.doc_id: r for r in P.fingerprints(spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], schema).repartition(partitions)).collect()}
    want = edited(rows)
    assert {i: (r.n_chars, r.edited_sha256) for i, r in got.items()} == {i: (len(t or ""), hashlib.sha256(want[i].encode()).hexdigest()) for i, t in rows}
    by_text = {}
    for i, t in rows:
        by_text.setdefault(t or "", set()).add(got[i].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    assert len(set().union(*by_text.values())) == len(by_text)
    assert all(0 <= x <= 1 for r in got.values() for x in (r.near_edited, r.near_next))
    prose = [i for i, _ in rows[:60] if got[i].n_chars > 400]
    assert sum(got[i].near_edited for i in prose) / len(prose) > 0.55 > 0.3 > sum(got[i].near_next for i in prose) / len(prose)
    text = {i: t or "" for i, t in rows}
    for i in prose:  # four standard errors of an estimate from 60 signs
        assert abs(got[i].near_edited - plain_likeness(text[i], want[i])) < 4 * 0.18
    errors = [abs(got[i].near_edited - plain_likeness(text[i], want[i])) for i in prose]
    assert sum(errors) / len(errors) < 0.18


def test_lanes_do_not_carry(spark):
    """A lane that overflows stays modulo its own size and leaves its neighbours alone."""
    row = spark.range(1).selectExpr(f"{P.WHOLE} AS full").select(P.fold(F.array("full"), lambda x: x, P.WHOLE).alias("a"), P.fold(F.array("full", F.lit(1).cast("long")), lambda x: x, P.WHOLE).alias("b")).first()
    lane = lambda x, k: x >> k * P.GAP & (1 << P.LANE_BITS) - 1
    assert [lane(row.a, k) for k in range(3)] == [(1 << P.LANE_BITS) - 1] * 3
    assert [lane(row.b, k) for k in range(3)] == [0, (1 << P.LANE_BITS) - 1, (1 << P.LANE_BITS) - 1]


def test_order_of_paragraphs_does_not_matter(spark):
    df = spark.createDataFrame([(1, "a b c\nd e f\ng h"), (2, "g h\na b c\nd e f"), (3, "a b c\nd e f\nd e f\ng h")], "doc_id long, text string")
    a, b, c = (r.fingerprint for r in P.fingerprints(df).orderBy("doc_id").collect())
    assert a.split(":")[0] == b.split(":")[0] != c.split(":")[0]


def test_paragraphs_add_and_subtract(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "x y"), (3, "a b c\nx y")], "doc_id long, text string")
    wide = [[int(r.fingerprint.split(":")[0][k : k + 10], 16) for k in range(0, 40, 10)] for r in P.fingerprints(df).orderBy("doc_id").collect()]
    assert [(x + y) % (1 << P.WIDE_BITS) for x, y in zip(wide[0], wide[1])] == wide[2]


def test_repeated_rows_null_ids_and_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (2, "d")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.edited_sha256) for r in P.fingerprints(df).collect()), key=str)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == sorted([(1, sha("a b")), (1, sha("a b")), (None, sha("c")), (2, sha("d"))], key=str)
    assert P.fingerprints(df.limit(0)).count() == 0
