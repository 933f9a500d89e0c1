import hashlib
import random

import pytest

from graphloom.llm import substring_dedup as S


def brute_force(rows, length):
    """Removed bytes of each row, from the contract."""
    raw = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in sorted(raw):
        for s in range(len(b) - length + 1):
            v = b[s : s + length]
            first[v] = min(first.get(v, (i, s)), (i, s))
    out = {}
    for i, b in raw:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < (i, s):
                gone[s : s + length] = b"\1" * length
        rest = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest())
    return out


def corpus(seed):
    r = random.Random(seed)
    letters = "abcdefgh é"
    passages = ["".join(r.choices(letters, k=r.randint(90, 260))) for _ in range(6)]
    rows = [None, "", "short", "x" * 99, "x" * 100, "x" * 101, "z" * 3000, "ab" * 700, "日本" * 120]
    for _ in range(50):
        rows.append("".join(r.choice(passages) if r.random() < 0.5 else "".join(r.choices(letters, k=r.randint(1, 300))) for _ in range(r.randint(1, 6))))
    rows += [rows[20], rows[20], passages[0]]
    r.shuffle(rows)
    return list(enumerate(rows, 5))


@pytest.mark.parametrize(("seed", "length", "group"), [(1, 100, 4096), (2, 100, 1), (3, 30, 2)])
def test_against_brute_force(spark, monkeypatch, seed, length, group):
    monkeypatch.setattr(S, "GROUP", group)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, key string, id int")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.substring_report(df, length=length).collect()}
    assert got == brute_force(rows, length)
    kept = S.substring_dedup(df, length=length)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == set(got)
    plain = {i for i, t in rows if (t or "").isascii()}
    assert all(hashlib.sha256((r.text or "").encode()).hexdigest() == got[r.doc_id][3] for r in kept.collect() if r.doc_id in plain)


def test_rows_that_share_an_id_are_not_before_each_other(spark):
    t = "".join(random.Random(1).choices("abcdefgh", k=300))
    got = S.substring_report(spark.createDataFrame([(1, t), (1, t), (2, t)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (1, 0), (2, 300)]


def test_empty_table(spark):
    assert S.substring_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_that_share_an_id_and_differ_give_their_own_strings(spark):
    r = random.Random(2)
    a, b, c = ("".join(r.choices("abcdefgh", k=300)) for _ in range(3))
    got = S.substring_report(spark.createDataFrame([(1, a), (1, c + b), (2, b), (3, c + a)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed) for r in got) == [(1, 300, 0), (1, 600, 0), (2, 300, 300), (3, 600, 600)]
