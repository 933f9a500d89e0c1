import public_tokenizers
import pytest
import sentencepiece

from graphloom.llm import token_counts as C

TEXTS = [
    None, "", " ", "  ", "\n", "\n\n x", "a", "Hello  world", " lead and trail ", "tab\there", "straße Öl naïve", "日本語 mixed 文字", "emoji 🙂🙂", "▁sign▁", "x" * 3000, "line one\nline two\n\n  indented\r\n",
    "<s> </s> <unk> <0x41>", "Hello  world", "the quick brown fox " * 2000,
]


@pytest.mark.parametrize("most", [C.HEAD, 5, 0])
def test_counts_are_the_librarys(spark, most):
    """All pre-tokens in the head, some, or none: those outside it are joined."""
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(C.MODEL))
    rows = [*enumerate(TEXTS), (3, "another text of row three"), (None, "the quick fox"), (None, None), *((100 + i, "the quick fox") for i in range(30))]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, n_tokens string, h1 int")
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in C.token_counts(df, most=most).collect()), key=str)
    counts = [(i, len((t or "").encode()), len(lib.encode(t or ""))) for i, t in rows]
    assert got == sorted(((i, b, n, n > 4096) for i, b, n in counts), key=str)
    assert any(x[3] for x in got)


def test_each_pretoken_is_counted_once(spark):
    df = spark.createDataFrame([("a b a",), ("b  c",), (None,), ("c\n\nd",)], "text string").repartition(3)
    table = {r.word: (r.n, r.pieces) for r in C.piece_table(C.pretoken_counts(df, C.MODEL), C.MODEL).collect()}
    assert {k: n for k, (n, _) in table.items()} == {"a": 2, "b": 2, " ▁▁c": 1, "c\n\nd": 1}


def test_the_head_is_bounded(spark):
    table = spark.createDataFrame([("a", 9, 1), ("b", 5, 1), ("c", 5, 2), ("x" * 65, 99, 30)], "word string, n long, pieces long")
    assert [C.head(table, k) for k in (0, 1, 2, 3)] == [{}, {"a": 1}, {"a": 1}, {"a": 1, "b": 1, "c": 2}]


def test_empty_table(spark):
    assert C.token_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
