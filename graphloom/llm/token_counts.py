"""Token counts of whole texts without keeping token ids.

1. Each text is split into pre-tokens that no piece of the vocabulary can cross.  A first pass over the texts gives the
   distinct pre-tokens with their frequencies (combined in each task, then by a shuffle).
2. The tokenizer sees each row of that table, and so each distinct pre-token of all texts, once: pieces by pre-token.
3. A second pass makes the frequencies of pre-tokens in each text.  Those of the most frequent pre-tokens, ``HEAD`` at
   most, meet their pieces where they are made: that part of the table is broadcast.  The others are joined to the table
   by pre-token.  Frequencies times pieces are summed for each row, by a number that the rows get when they are written.

No ids are made into rows.  A pre-token that a third of all texts hold is in the head, or, if the head is full, has its
join's partition split by adaptive execution; sums are combined before they are shuffled.

Null text counts as empty and an empty text has no tokens.  Repeated rows, rows that share an id and rows with a null id
are counted each for itself; an empty table gives no rows.  Other columns of the input are ignored and dropped.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut, small_batches, text_groups

MODEL = "piece_bpe_32k.model"
#: Pre-tokens that are broadcast, the longest of them, and distinct ones that a task holds before it hands them on.
HEAD, HEAD_CHARS, HELD = 300_000, 64, 300_000
SPACE = "▁"
PRETOKEN = re.compile(f"\n+|{SPACE}*[^{SPACE}\n]+|{SPACE}+")


class PieceCounter:
    """Pre-tokens of texts, and the number of pieces of each by the sentencepiece library.

    A pre-token is written without its word start; one that has none, or several, is written after a blank.
    """

    def __init__(self, model_path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = (self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size()))
        # a boundary is safe where no piece has a word start after another character, nor a line end beside anything
        self.splits = all(not re.search(f"[^{SPACE}]{SPACE}|\n.|.\n", p, re.S) for p in pieces) and self.lib.encode("\n", out_type=str)[-1] == "<0x0A>"

    def pretokens(self, text: str) -> list[str]:
        if not text:
            return []
        if not self.splits:
            return ["  " + text]  # the whole text is one
        words = text.split(" ")
        if "" not in words and SPACE not in text:
            return words
        found = PRETOKEN.findall(SPACE + text.replace(" ", SPACE))
        return [t[1:] if t[0] == SPACE and t[1:2] not in ("", SPACE) else " " + t for t in found]

    def pieces(self, pretokens: list[str]) -> list[int]:
        plain = [t for t in pretokens if t[0] != " "]
        known = dict(zip(plain, map(len, self.lib.encode(plain, num_threads=1)))) if plain else {}
        return [known[t] if t[0] != " " else self._odd(t[1:]) for t in pretokens]

    def _odd(self, token: str) -> int:
        if token[0] == " ":
            return len(self.lib.encode(token[1:]))
        if token[0] == "\n":
            return len(token)
        if token == SPACE:
            return 1
        if token[0] == SPACE:  # the library puts a word start before every text
            return len(self.lib.encode(token[1:]))
        return len(self.lib.encode("\n" + token)) - 2


@lru_cache(maxsize=2)
def counter(model_path: str) -> PieceCounter:
    return PieceCounter(model_path)


def pretoken_counts(texts: DataFrame, model: str) -> DataFrame:
    """(word, n) of the distinct pre-tokens of all texts."""

    def run(batches):
        c, held = counter(public_tokenizers.path(model)), Counter()

        def parts():
            words = sorted(held)  # neighbours that begin alike compress well in the shuffle
            n = np.fromiter(map(held.__getitem__, words), np.int64, len(words))
            for s in range(0, len(words), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[s : s + 20_000], pa.string()), pa.array(n[s : s + 20_000])], ["word", "n"])

        for b in batches:
            for _, own in text_groups(b, 0):
                for t in own:
                    held.update(c.pretokens(t))
                if len(held) > HELD:
                    yield from parts()
                    held = Counter()
        yield from parts()

    return texts.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def piece_table(counts: DataFrame, model: str) -> DataFrame:
    """(word, n, pieces)."""

    def run(batches):
        c = counter(public_tokenizers.path(model))
        for b in batches:
            for part, words in text_groups(b, 0, rows=4096):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(c.pieces(words), pa.int64())], ["word", "n", "pieces"])

    return counts.mapInArrow(run, "word string, n long, pieces long")


def head(table: DataFrame, most: int) -> dict[str, int]:
    """Pieces of the most frequent short pre-tokens, at most ``most``: all of a frequency, or none of it."""
    short = table.where(F.char_length("word") <= HEAD_CHARS)
    level = F.least("n", F.lit(100_000))  # so many rows in the histogram at most
    least, total = 1 << 62, 0
    for n, words in sorted(map(tuple, short.groupBy(level.alias("level")).agg(F.count(F.lit(1))).collect()), reverse=True):
        total += words
        if total > most:
            break
        least = n
    return dict(map(tuple, short.where(level >= least).select("word", "pieces").collect()))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, limit: int = 4096, most: int = HEAD) -> DataFrame:
    """Per row of ``docs``: id, UTF-8 bytes, tokens, and whether there are more than ``limit`` tokens."""
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(text.alias("text"), F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"))
    table = cut(piece_table(pretoken_counts(texts, model), model), "token-pieces")
    frequent = spark.sparkContext.broadcast(head(table, most))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        c, known = counter(public_tokenizers.path(model)), frequent.value
        for b in batches:
            for part, own in text_groups(b, 0):
                sums, words, ns, ends = [], [], [], [0]
                for t in own:
                    total = 0
                    for w, n in Counter(c.pretokens(t)).items():
                        pieces = known.get(w)
                        if pieces is None:
                            words.append(w)
                            ns.append(n)
                        else:
                            total += n * pieces
                    sums.append(total)
                    ends.append(len(words))
                rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(ns, pa.int32())], ["word", "n"]))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(sums, pa.int64()), rare], ["id", "n_bytes", "common", "rare"])

    made = texts.mapInArrow(run, f"id {kind}, n_bytes long, common long, rare array<struct<word:string,n:int>>")
    rows = cut(made.withColumn("row", F.monotonically_increasing_id()), "token-frequencies")
    met = rows.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.n").join(table.select("word", "pieces"), "word")
    sums = met.groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("others"))
    n = F.col("common") + F.coalesce("others", F.lit(0))
    return rows.drop("rare").join(sums, "row", "left").select(F.col("id").alias(id_col), "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
