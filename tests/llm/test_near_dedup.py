import random

import numpy as np
import pytest

from graphloom.llm import near_dedup as N
from graphloom.llm import setsketch


def word_set(text, width):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")).split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute_force(rows, width, percent):
    sets = [(i, word_set(t, width)) for i, t in rows]
    low = {i: i for i, _ in rows}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                low[y] = x
    return {i: (len(s), root(i), root(i) == i) for i, s in sets}


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = [None, "", " \n ", "one", "ONE", "one two", "One  TWO", "x" * 20_000, "a\xa0b c d"]
    for _ in range(25):
        base = r.choices(vocabulary, k=r.choice([8, 60, 200, 400]))
        rows.append(" ".join(base))
        for _ in range(r.choice([0, 1, 3, 12])):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 25))):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            rows.append(" ".join(copy).title() if r.random() < 0.3 else " ".join(copy))
    r.shuffle(rows)
    return list(enumerate(rows, 3))


@pytest.mark.parametrize(("seed", "width", "percent", "side"), [(1, 3, 85, 256), (2, 5, 80, 4)])
def test_against_brute_force(spark, monkeypatch, seed, width, percent, side):
    monkeypatch.setattr(N, "SIDE", side)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], "doc_id long, text string, n int, digest string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(df, width=width, percent=percent).collect()}
    assert got == brute_force(rows, width, percent)
    kept = N.near_dedup(df, width=width, percent=percent)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, x in got.items() if x[2]}


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in N.near_duplicates(df).collect()), key=str)
    assert got == [(1, 1), (1, 1), (2, 1), (None, None)]


def test_empty_table(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_registers_merge_and_estimate():
    r = np.random.default_rng(5)
    common, a, b = (r.integers(0, 1 << 64, n, np.uint64, endpoint=False) for n in (4000, 500, 500))
    x, y, both = np.concatenate([common, a]), np.concatenate([common, b]), np.concatenate([common, a, b])
    regs = setsketch.sketch([x, y, both])
    assert (setsketch.merge(regs[0], regs[1]) == regs[2]).all()
    got = setsketch.estimate(regs[:1], regs[1:2], np.array([len(x)]), np.array([len(y)]))[0]
    assert abs(got - 0.8) < 0.08


def test_bands_hold_the_bound():
    for t, rows in ((0.85, 7), (0.8, 6)):
        assert setsketch.band_rows(t) == rows
        assert (1 - t**rows) ** (setsketch.M // rows) < setsketch.MISS
