"""SentencePiece encoding and decoding over a relational lattice.

1. Texts are cut into pre-tokens that no piece crosses; distinct pre-tokens are counted (combined before the shuffle).
2. The most frequent ones, ``LEXICON`` at most (a frequency threshold from the histogram of counts), form the lexicon.
   Their substrings of bounded length are exploded and equi-joined to the piece table; matches are the edges of a
   lattice, grouped by word.
3. A higher-order ``aggregate`` folds each word's lattice.  For unigram models the fold is Viterbi: the best score of each
   prefix.  A BPE model's library result is not the best sum of scores, so there the fold is over merges: its state is a
   bit for each boundary between symbols, and each step clears the boundary inside the best edge that spans two symbols.
4. Documents look their pre-tokens up in the lexicon (broadcast: its size is bounded).  Pre-tokens outside it, rare or
   longer than ``WORD`` characters, go to the library; both give the same ids, so nothing is cut or dropped.

Decoding joins the pieces' bytes; bytes that stand for unknown characters become those characters again.  A text that
holds the word-start sign itself is decoded with a blank there, as the library does.

Null counts as empty; an empty text has no ids.  Repeated rows are encoded each for itself; an empty table gives no
rows.  Other columns of the input are ignored and dropped.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import cut, text_or_empty

MODEL, SPACE = "piece_bpe_32k.model", "▁"
PRETOKEN = f"\n+|{SPACE}*[^{SPACE}\n]+|{SPACE}+"
#: Words in the lexicon, the longest of them (boundaries are bits of a 64-bit integer), words a worker remembers besides.
LEXICON, WORD, CACHE_ENTRIES = 200_000, 62, 300_000
#: What an unknown character costs below the lowest score, as unigram models count it.
UNKNOWN_COST = 10.0
#: Texts whose new words go to the library in one call.
GROUP = 256


class Model:
    """Pieces of a model file: (piece, id, score), the bytes each id stands for, and whether merges or Viterbi decide."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        lib, n = self.lib, self.lib.get_piece_size()
        self.pieces = [(lib.id_to_piece(i), i, lib.get_score(i)) for i in range(n) if not (lib.is_unknown(i) or lib.is_control(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.first_byte = lib.piece_to_id("<0x00>")
        text = {i: p.replace(SPACE, " ").encode() for p, i, _ in self.pieces}
        self.bytes = [bytes([i - self.first_byte]) if lib.is_byte(i) else text.get(i, b"") for i in range(n)]
        # a boundary is safe where no piece has a word start after another character, nor a line end beside anything
        self.splits = all(not re.search(f"[^{SPACE}]{SPACE}|\n.|.\n", p, re.S) for p, _, _ in self.pieces) and lib.is_byte(self.first_byte)


def pretokens(text: Column) -> Column:
    """The pre-tokens of a text, a word start before the text and for each blank; none for an empty text."""
    marked = F.concat(F.lit(SPACE), F.translate(text_or_empty(text), " ", SPACE))
    return F.when(F.length(text_or_empty(text)) > 0, F.regexp_extract_all(marked, F.lit(PRETOKEN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.select(F.explode(pretokens(F.col(text_col))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def frequent(counts: DataFrame, most: int = LEXICON) -> DataFrame:
    """The words of the highest counts, ``most`` of them or fewer: all words above a count, or none of it."""
    short = counts.where(F.char_length("word") <= WORD)
    level = F.least("n", F.lit(100_000))  # so many rows in the histogram at most
    sizes = sorted(((r["level"], r["words"]) for r in short.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)
    least, total = 1 << 62, 0
    for n, words in sizes:
        total += words
        if total > most:
            break
        least = n
    return short.where(level >= least)


def lattice(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """(word, edges): for each word its edges (s, e, id, score) with s < e the places of characters."""
    spread = (
        words.select("word", F.explode(F.sequence(F.lit(0), F.char_length("word") - 1)).alias("s"))
        .select("word", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.char_length("word") - F.col("s")))).alias("k"))
        .select("word", "s", (F.col("s") + F.col("k")).alias("e"), F.substring("word", F.col("s") + 1, F.col("k")).alias("piece"))
    )
    edges = spread.join(F.broadcast(pieces), "piece")  # the model's vocabulary: a fixed size
    found = edges.groupBy("word").agg(F.collect_list(F.struct("s", "e", "id", "score")).alias("edges"))
    return words.select("word").join(found, "word", "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<struct<s:int,e:int,id:int,score:double>>")))


def bits_below(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n) - F.lit(1)


def bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n)


def merge_fold(edges: Column, size: Column) -> Column:
    """Boundaries, as bits 0 to ``size``, that are left when no edge spans two symbols any more."""

    def step(state, _):
        inside = lambda x: state.bitwiseAND(bits_below(x["e"])).bitwiseAND(F.bitwise_not(bits_below(x["s"] + 1)))
        fits = lambda x: (state.bitwiseAND(bit(x["s"])) != 0) & (state.bitwiseAND(bit(x["e"])) != 0) & (F.bit_count(inside(x)) == 1)
        best = F.array_max(F.transform(F.filter(edges, fits), lambda x: F.struct(x["score"], (-x["s"]).alias("left"), inside(x).alias("gone"))))
        return F.coalesce(state.bitwiseXOR(best["gone"]), state)

    start = bits_below(size + 1)
    return F.when(size < 2, start).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), start, step))


def viterbi_fold(edges: Column, size: Column, unknown: Column) -> Column:
    """Boundaries of the path of the highest sum of scores; a character that is no piece costs ``unknown``.

    The state holds, for each prefix, its best sum and the place where its last edge begins; ties go to the longer edge.
    """

    def step(best, e):
        known = F.filter(edges, lambda x: x["e"] == e)
        ways = F.transform(known, lambda x: F.struct((F.get(best, x["s"])["total"] + x["score"]).alias("total"), (-x["s"]).alias("from")))
        alone = F.when(~F.exists(known, lambda x: x["s"] == e - 1), F.struct((F.get(best, e - 1)["total"] + unknown).alias("total"), (-(e - 1)).alias("from")))
        return F.concat(best, F.array(F.array_max(F.concat(ways, F.array(alone)))))

    start = F.array(F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("from")))
    best = F.aggregate(F.sequence(F.lit(1), size), start, step)
    back = lambda state, e: F.when(state.bitwiseAND(bit(e)) != 0, state.bitwiseOR(bit(-F.get(best, e)["from"]))).otherwise(state)
    return F.aggregate(F.reverse(F.sequence(F.lit(1), size)), bit(size), back)


def byte_ids(char: Column, first: int) -> Column:
    raw = F.encode(char, "UTF-8")
    return F.transform(F.sequence(F.lit(1), F.octet_length(raw)), lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("int") + first)


def word_ids(lattices: DataFrame, first_byte: int, kind: str = "merge", unknown: float = 0.0) -> DataFrame:
    """(word, ids): each lattice folded; a symbol that is no piece becomes the ids of its bytes."""
    size = F.char_length("word")
    cuts = merge_fold(F.col("edges"), size) if kind == "merge" else viterbi_fold(F.col("edges"), size, F.lit(unknown))
    folded = lattices.select("word", "edges", cuts.alias("cuts"))
    ends = F.filter(F.sequence(F.lit(1), size), lambda i: F.col("cuts").bitwiseAND(bit(i)) != 0)
    at = F.concat(F.array(F.lit(0)), ends)
    symbols = F.zip_with(F.slice(at, 1, F.size(at) - 1), ends, lambda s, e: F.struct(s.alias("s"), e.alias("e")))

    def ids(x):
        hit = F.filter("edges", lambda y: (y["s"] == x["s"]) & (y["e"] == x["e"]))
        return F.when(F.size(hit) > 0, F.transform(hit, lambda y: y["id"])).otherwise(byte_ids(F.substring("word", x["s"] + 1, F.lit(1)), first_byte))

    return folded.select("word", F.flatten(F.transform(symbols, ids)).alias("ids"))


def lexicon(spark: SparkSession, docs: DataFrame, model: Model, text_col: str = "text", most: int = LEXICON, kind: str = "merge") -> DataFrame:
    """(word, ids) of the frequent words, by the lattice alone."""
    pieces = spark.createDataFrame([(p, i, s) for p, i, s in model.pieces], "piece string, id int, score double")
    words = frequent(cut(word_counts(docs, text_col), "piece-words"), most).select("word").repartition("word")
    unknown = min(s for _, _, s in model.pieces) - UNKNOWN_COST
    return word_ids(lattice(words, pieces, max(len(p) for p, _, _ in model.pieces)), model.first_byte, kind, unknown)


class Codec:
    """Encodes and decodes texts in a worker, with a lexicon and the library for words that are not in it."""

    def __init__(self, model: Model, known: dict[str, bytes]):
        self.model, self.known, self.more = model, known, {}
        self.cut = re.compile(PRETOKEN).findall

    def library(self, words: list[str]) -> list[bytes]:
        """Ids of pre-tokens.  The library puts a word start before each text; a line end keeps it off other words."""
        bare = [w[1:] if w[0] == SPACE else "\n" + w for w in words]
        out = self.model.lib.encode(bare, num_threads=1)
        start = len(self.model.lib.encode("\n"))
        return [np.asarray([self.model.lib.piece_to_id(SPACE)] if w == SPACE else ids if w[0] == SPACE else ids[start:], "<i4").tobytes() for w, ids in zip(words, out)]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        if not self.model.splits:
            return [np.asarray(x, "<i4").tobytes() for x in self.model.lib.encode(texts, num_threads=1)]
        words = [self.cut(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.more) > CACHE_ENTRIES:
            self.more = {}
        known, more = self.known, self.more
        new = [w for w in set().union(*words).difference(known) if w not in more]
        own = dict(zip(new, self.library(new))) if new else {}
        more.update((w, x) for w, x in own.items() if len(w) <= WORD)
        long = {w: x for w, x in own.items() if len(w) > WORD}
        return [b"".join([known[w] if w in known else more[w] if w in more else long[w] for w in ws]) for ws in words]

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.model.bytes.__getitem__, np.frombuffer(ids, "<i4").tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(key: str, model: str, words) -> Codec:
    """One codec a worker and lexicon."""
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(Model(public_tokenizers.path(model)), dict(words.value))
    return _CODECS[key]


def broadcast_lexicon(docs: DataFrame, text_col: str, model: str, most: int):
    spark = docs.sparkSession
    rows = cut(lexicon(spark, docs, Model(public_tokenizers.path(model)), text_col, most), "piece-lexicon").collect()  # at most ``most`` short words
    return spark.sparkContext.broadcast([(r["word"], np.asarray(r["ids"], "<i4").tobytes()) for r in rows])


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, most: int = LEXICON) -> DataFrame:
    """Per row of ``docs``: id and the ids of its text as the library gives them, without begin and end."""
    words, kind = broadcast_lexicon(docs, text_col, model, most), docs.schema[id_col].dataType.simpleString()
    key = str(id(words)) + model

    def run(batches):
        c = codec(key, model, words)
        for b in batches:
            for s in range(0, b.num_rows, GROUP):
                part = b.slice(s, GROUP)
                ids = [np.frombuffer(x, "<i4") for x in c.encode_all([t or "" for t in part.column(1).to_pylist()])]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, np.concatenate(ids))], ["id", "ids"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """Per row: id and the text of its ids; null ids give an empty text."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        c = Codec(Model(public_tokenizers.path(model)), {})
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(np.asarray(x or [], "<i4").tobytes()) for x in b.column(1).to_pylist()], pa.string())], ["id", "text"])

    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def codec_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, most: int = LEXICON) -> DataFrame:
    """Per row: id, n_bytes, n_tokens, ids_crc32 (little-endian 32-bit ids), decoded_sha256, and whether decoding gives the text back."""
    words, kind = broadcast_lexicon(docs, text_col, model, most), docs.schema[id_col].dataType.simpleString()
    key = str(id(words)) + model

    def run(batches):
        c = codec(key, model, words)
        for b in batches:
            for s in range(0, b.num_rows, GROUP):
                part = b.slice(s, GROUP)
                texts = [t or "" for t in part.column(1).to_pylist()]
                rows = []
                for t, ids in zip(texts, c.encode_all(texts)):
                    back, raw = c.decode(ids), t.encode("utf-8", "surrogatepass")
                    rows.append((len(raw), len(ids) // 4, zlib.crc32(ids), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == t))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.bool_())], ["id", "n_bytes", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"])

    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        .mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
        .withColumnRenamed("id", id_col)
    )
