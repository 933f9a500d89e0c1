import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from graphloom.llm import packing as K

TEXTS = [
    None, "", " ", "a", "Hello, World! It's 42 o'clock...", "ÄÖÜ straße µ² ½ ª ŉ", "日本語 и русский", "emoji 🙂", "<|endoftext|> inside", "don't WON'T we'll '''s", "tabs\tand\nlines\r\n", "x" * 5000, "word " * 9000,
    "1234567890 " * 800, "!?!?...;;;", "a\xa0b", "Hello, World! It's 42 o'clock...", "İstanbul ſ K", *(f"text {i} " * (i * 7 % 900) for i in range(80)),
]


def table(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, 1, "clash") for i, t in enumerate(texts)], "doc_id long, text string, piece int, id string")


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(public_tokenizers.path(K.TOKENIZER))


def test_ids_are_the_librarys(lib):
    w = K.WordIds(public_tokenizers.path(K.TOKENIZER))
    texts = [t or "" for t in TEXTS]
    for _ in range(2):  # from the library, then from memory
        assert [np.frombuffer(x, "<u4").tolist() for x in w.encode_all(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    every = [f"{a}{chr(c)}{b}" for c in range(0x20, 0x180) for a, b in (("", ""), ("a", "b"), (" ", "1"), ("'s", "'"))]
    assert [np.frombuffer(x, "<u4").tolist() for x in w.encode_all(every)] == [lib.encode(t, add_special_tokens=False).ids for t in every]


def test_pieces_and_places(spark, lib):
    rows = K.best_fit_packing(table(spark)).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(range(len(TEXTS)))
    for i, parts in by_doc.items():
        ids = np.asarray([*lib.encode(TEXTS[i] or "", add_special_tokens=False).ids, 1], "<u4")
        for k, r in enumerate(sorted(parts, key=lambda r: r.piece)):
            own = ids[k * 4096 : (k + 1) * 4096]
            assert (r.piece, r.start, r.length, r.ids_crc32) == (k, k * 4096, len(own), zlib.crc32(own.tobytes()))
        assert sum(r.length for r in parts) == len(ids)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= -(-total // 4096) + 1


def test_the_fullest_closes_first():
    fit = K.BestFit(10, 2)
    assert [fit.place(n) for n in (6, 7, 5, 3, 4)] == [(0, 0), (1, 0), (2, 0), (0, 6), (2, 5)]


def plain_best_fit(sizes, length, most):
    """The same rule over a list of open bins, the newest last."""
    open_, made, out = [], 0, []
    for n in sizes:
        fits = [x for x in open_ if x[0] >= n]
        if fits:
            best = [x for x in fits if x[0] == min(fits)[0]][-1]
            open_.remove(best)
            free, bin_ = best
        else:
            free, bin_, made = length, made, made + 1
        out.append((bin_, length - free))
        if free > n:
            if len(open_) == most:
                open_.remove([x for x in open_ if x[0] == min(open_)[0]][-1])
            open_.append((free - n, bin_))
    return out


@pytest.mark.parametrize(("length", "bins"), [(10, 1), (30, 3), (30, 20), (4096, 64)])
def test_against_a_plain_packer(length, bins):
    sizes = np.random.default_rng(length + bins).integers(1, length + 1, 3000).tolist()
    fit = K.BestFit(length, bins)
    assert [fit.place(n) for n in sizes] == plain_best_fit(sizes, length, bins)
    assert fit.open <= bins


def test_another_tokenizer_gets_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    w, own = K.WordIds(path), Tokenizer.from_file(path)
    assert not w.cuts_alike
    texts = [t or "" for t in TEXTS]
    assert [np.frombuffer(x, "<u4").tolist() for x in w.encode_all(texts)] == [own.encode(t, add_special_tokens=False).ids for t in texts]


def test_best_bin_is_the_tightest():
    fit = K.BestFit(10, 8)
    assert [fit.place(n) for n in (7, 6, 3, 4)] == [(0, 0), (1, 0), (0, 7), (1, 6)]


def test_empty_table(spark):
    assert K.best_fit_packing(table(spark, [])).count() == 0
