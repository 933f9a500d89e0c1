"""Removal of long lines that many documents share.

A line's key is the line without white space at both ends, A-Z in lower case.  Each document gives 128-bit hashes of its
long keys with their positions, written once.  Hashes are dealt into ranges and sorted within them by document, largest
id first, and position; streaming through a range, the first document of a hash keeps its lines and the others lose
theirs if the hash counts enough documents.  What comes back is no text but a compressed bitmap of dropped lines for each
document: 64-line words, without the words in which all lines stay.

A hash is never cut by a range, so hashes of very many lines do not go into ranges: those of at least ``HOT_LINES``
lines, and of at least 1 / ``HOT_KEYS`` of all lines.  There are at most ``HOT_KEYS`` of them whatever the input, so
their numbers of documents and largest ids, combined before the shuffle, are broadcast to where the lines are.  Both
ways are always taken and give the same decision.

Keys of at least ``min_chars`` code points found in at least ``min_docs`` documents lose all their lines but those in the
largest id that holds it.  Null or empty text is one empty line.  Rows that repeat an id count as one document, and
each of those rows is cut alike by its own lines.  A row with a null id is no document: it is not counted and keeps all
its lines.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import BLANKS, ascii_lower, cut, drop, text_or_empty

MIN_CHARS, MIN_DOCS = 40, 5
#: Lines from which on a key may stay out of the ranges, and the most keys that do (40 bytes each are broadcast).
HOT_LINES, HOT_KEYS = 100_000, 100_000


def lines(text):
    return F.split(text_or_empty(text), "\n")


def long_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """Id, hash of the text and, for each line, the two hashes of its key, or null where the key is short."""

    def hashes(key):
        return F.when(F.char_length(key) >= min_chars, F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")))

    keys = F.transform(lines(F.col(text_col)), lambda x: F.btrim(ascii_lower(x), F.lit(BLANKS)))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), keys.alias("keys")).select("id", "text_hash", F.transform("keys", hashes).alias("hashes"))


def hot_keys(rows: DataFrame, n_lines: int) -> DataFrame:
    """h1, h2, docs, keep_id of the at most ``HOT_KEYS`` keys that have too many lines for one range."""
    bound = max(HOT_LINES, -(-n_lines // HOT_KEYS))
    many = cut(rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= bound).select("h1", "h2"), "line-hot")
    found = rows.join(F.broadcast(many), ["h1", "h2"]).select("h1", "h2", "id").distinct()  # rows that share an id are one document
    out = cut(found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.max("id").alias("keep_id")), "line-hot-docs")
    drop(many)
    return out


def in_ranges(rows: DataFrame) -> DataFrame:
    """``rows`` with docs and keep_id of their key, by one pass through ranges of hashes in order of document and position."""
    key = Window.partitionBy("h1", "h2")
    order = key.orderBy(F.desc("id"), "text_hash", "pos")
    seen = rows.repartitionByRange("h1", "h2").withColumn("keep_id", F.first("id").over(order)).withColumn("new", F.when(F.lag("id").over(order) == F.col("id"), 0).otherwise(1))
    return seen.withColumn("docs", F.sum("new").over(key)).drop("new")


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Id, text_hash, n_dropped and ``words``: array of (word, bits), bit b of word w set when line 64 w + b is dropped.

    Only rows that lose lines are listed, equal rows once; the hash tells rows that share an id apart.
    """
    keyed = cut(long_keys(docs, id_col, text_col, min_chars).where("id is not null and exists(hashes, h -> h is not null)"), "line-keys")
    n_lines = keyed.agg(F.sum(F.size(F.filter("hashes", lambda h: h.isNotNull())).cast("long"))).first()[0] or 0
    rows = keyed.select("id", "text_hash", F.posexplode("hashes").alias("pos", "h")).where(F.col("h").isNotNull()).select("id", "text_hash", "pos", "h.h1", "h.h2")
    hot = hot_keys(rows, n_lines)
    met = rows.join(F.broadcast(hot), ["h1", "h2"]).unionByName(in_ranges(rows.join(F.broadcast(hot), ["h1", "h2"], "left_anti")))
    hits = met.where((F.col("docs") >= min_docs) & (F.col("id") != F.col("keep_id")))
    by_word = hits.groupBy("id", "text_hash", F.shiftright("pos", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("bits"))
    out = cut(by_word.groupBy("id", "text_hash").agg(F.sum(F.bit_count("bits")).alias("n_dropped"), F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words")), "line-bitmaps")
    drop(keyed, hot)
    return out


def dropped_positions(words):
    return F.flatten(F.transform(words, lambda w: F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("getbit", w["bits"], b) == 1), lambda b: w["word"] * 64 + b)))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, the text without the dropped lines, and __n_lines, __n_dropped.

    Bitmaps grow with the documents, so they meet by shuffle at every size and are never broadcast.
    """
    found = bitmaps.select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("n_dropped").alias("__n_dropped"), dropped_positions(F.col("words")).alias("__drop"))
    all_lines = lines(F.col(text_col))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drop")), lambda i: F.get("__lines", i))
    return (
        docs.join(found.hint("merge"), (docs[id_col] == F.col("__id")) & (F.xxhash64(docs[text_col]) == F.col("__hash")), "left")
        .withColumn("__lines", all_lines)
        .withColumn(text_col, F.when(F.col("__drop").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")))
        .withColumn("__n_lines", F.size("__lines").cast("long"))
        .withColumn("__n_dropped", F.coalesce("__n_dropped", F.lit(0)).cast("long"))
        .drop("__id", "__hash", "__drop", "__lines")
    )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with its columns, each text without the lines to drop."""
    return apply_bitmaps(docs, keep_bitmaps(docs, id_col, text_col, min_chars, min_docs), id_col, text_col).drop("__n_lines", "__n_dropped")


def line_dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Per row: id, n_lines, n_dropped, kept_sha256."""
    slim = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias(text_col))
    out = apply_bitmaps(slim, keep_bitmaps(slim, id_col, text_col, min_chars, min_docs), id_col, text_col)
    return out.select(id_col, F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(text_or_empty(F.col(text_col)), 256).alias("kept_sha256"))


ORACLE = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
hot AS (SELECT key, max(doc_id) AS keep_id FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, hot.keep_id IS NOT NULL AND hot.keep_id <> k.doc_id AS gone FROM k LEFT JOIN hot ON k.key = hot.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
