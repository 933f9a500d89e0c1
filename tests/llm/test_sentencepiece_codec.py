import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from graphloom.llm import sentencepiece_codec as S

TEXTS = [
    None, "", " ", "  ", "\n", "\n\n x", "a", "Hello  world", " lead and trail ", "tab\there", "straße Öl naïve", "日本語のテキスト mixed 文字", "emoji 🙂🙂 end", "▁sign▁", "x" * 300, "lala" * 5000,
    "a" * 70 + " b", "line one\nline two\n\n  indented\r\n", "0123456789 3.14159 <s> </s> <unk> <0x41>", "Hello  world", "the quick brown fox " * 400,
]


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(S.MODEL))


def table(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, id int")


@pytest.mark.parametrize("most", [0, 12, S.LEXICON])
def test_ids_and_round_trip_are_the_librarys(spark, lib, most):
    encoded = S.encode(table(spark), most=most)
    got = {r.doc_id: list(r.ids) for r in encoded.collect()}
    assert got == {i: lib.encode(t or "") for i, t in enumerate(TEXTS)}
    back = {r.doc_id: r.text for r in S.decode(encoded).collect()}
    assert back == {i: lib.decode(lib.encode(t or "")) for i, t in enumerate(TEXTS)}


def test_report(spark, lib):
    for r in S.codec_report(table(spark)).collect():
        t = TEXTS[r.doc_id] or ""
        ids = lib.encode(t)
        assert (r.n_bytes, r.n_tokens, r.ids_crc32, r.round_trip) == (len(t.encode()), len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()), lib.decode(ids) == t)


def test_empty_table(spark):
    assert S.codec_report(table(spark, [])).count() == 0


def test_lattice_gives_the_librarys_merges(spark, lib):
    words = ["▁" + w for w in "internationalization unbelievable aaaaaaaaaaaa abracadabra xylophone Zürich 漢字かな 🙂 antidisestablishmentarianism".split()] + ["mid", "▁▁▁x", "a"]
    model = S.Model(public_tokenizers.path(S.MODEL))
    pieces = spark.createDataFrame(model.pieces, "piece string, id int, score double")
    lattices = S.lattice(spark.createDataFrame([(w,) for w in words], "word string"), pieces, 16)
    got = {r.word: list(r.ids) for r in S.word_ids(lattices, model.first_byte).collect()}
    own = S.Codec(model, {})
    assert got == {w: np.frombuffer(x, "<i4").tolist() for w, x in zip(words, own.library(words))}


def test_viterbi_is_the_best_path(spark):
    pieces = {"a": -2.0, "b": -2.5, "ab": -3.0, "ba": -3.5, "aba": -5.5, "bab": -4.0}
    words = ["".join(p) for n in range(1, 7) for p in itertools.product("abc", repeat=n)][::7]
    unknown = -20.0

    def best(w):
        if not w:
            return 0.0
        return max((pieces[w[:k]] if w[:k] in pieces else unknown) + best(w[k:]) for k in range(1, len(w) + 1) if w[:k] in pieces or k == 1)

    names = {p: i for i, p in enumerate(pieces)}
    back = {i: p for p, i in names.items()}
    df = spark.createDataFrame([(p, i, pieces[p]) for p, i in names.items()], "piece string, id int, score double")
    lattices = S.lattice(spark.createDataFrame([(w,) for w in words], "word string"), df, 3)
    rows = S.word_ids(lattices, 1000, "viterbi", unknown).collect()
    assert len(rows) == len(words)
    for r in rows:
        assert "".join(back[i] if i in back else chr(i - 1000) for i in r.ids) == r.word
        assert abs(sum(pieces[back[i]] if i in back else unknown for i in r.ids) - best(r.word)) < 1e-9


def test_frequent_words_keep_their_bound(spark):
    counts = spark.createDataFrame([(f"w{i}", i % 5) for i in range(50)], "word string, n long")
    assert S.frequent(counts, 25).agg(F.count("*"), F.min("n")).first() == (20, 3)
