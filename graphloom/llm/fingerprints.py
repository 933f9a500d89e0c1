"""Fingerprints of documents that add up over paragraphs.

A paragraph (a line of the text) is hashed to a wide vector; a document's fingerprint is the sum of its paragraphs'
vectors, lane by lane, modulo powers of two.  So the order of paragraphs does not matter, equal multisets of paragraphs
give equal fingerprints, and a paragraph is inserted or deleted by adding or subtracting its vector.

A vector has two parts.  WIDE lanes of 40 bits come from hashes of the whole paragraph and decide equality (160 bits).
60 lanes of 20 bits count the bits of the hashes of the paragraph's pairs of neighbouring words (its first word pairs with
the line end), three lanes to one 64-bit sum with a free bit above each, so that no lane carries into another; from them
the likeness of two documents is estimated, with a standard error of about 0.18 times one minus the likeness and more.

The order of documents is made over ids and lengths alone: they are range-partitioned by sampled bounds, whatever the ids
look like, and each id finds the one before it.  Each text then sends the start that the document before it needs, a
quarter of that document's length, and nothing else of a text moves but to meet it.

Null or empty text is one empty paragraph without words.  A null id counts as the smallest of all.  Rows that repeat an id
are fingerprinted each for itself; what follows them is the next larger id, and of rows that repeat that one the
smallest start.  After the last document comes the first.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import cut, text_or_empty

WIDE, WIDE_BITS, SUMS, LANE_BITS = 4, 40, 20, 20
LANES = SUMS * 3
#: Lanes are a bit further apart than they are wide.  One bit at the bottom of each of the three lanes of a sum, and all bits of them.
GAP = LANE_BITS + 1
MASK = 1 | 1 << GAP | 1 << 2 * GAP
WHOLE = MASK * ((1 << LANE_BITS) - 1)


def paragraphs(text: Column) -> Column:
    return F.split(text_or_empty(text), "\n")


def words(text: Column) -> Column:
    """The words of a text, and a line end by itself before each paragraph but the first."""
    return F.filter(F.split(F.regexp_replace(text, "\n", " \n "), "[ \t\r\x0b\x0c]+"), lambda w: w != "")


def pair_hashes(words_: Column) -> Column:
    """A hash of each word with the one before it in its paragraph (a paragraph's first word with the line end)."""
    pairs = F.transform(words_, lambda w, i: F.when(w != "\n", F.xxhash64(w, F.when(i > 0, F.get(words_, i - 1)).otherwise("\n"))))
    return F.filter(pairs, lambda h: h.isNotNull())


def fold(array: Column | str, value, kept: int) -> Column:
    """Sum of ``value`` of each element; of each partial sum the bits of ``kept`` stay."""
    return F.aggregate(array, F.lit(0).cast("long"), lambda total, x: (total + value(x)).bitwiseAND(F.lit(kept)))


def wide_lane(k: int) -> Column:
    return fold("__paragraphs", lambda p: F.shiftrightunsigned(F.xxhash64(F.lit(k), p), 64 - WIDE_BITS), (1 << WIDE_BITS) - 1)


def lane_sum(k: int) -> Column:
    return fold("__pairs", lambda h: F.shiftrightunsigned(h, k).bitwiseAND(F.lit(MASK)), WHOLE)


def fingerprinted(rows: DataFrame, text_col: str, name: str) -> DataFrame:
    """``rows`` with a column ``name``: the parts of the text's fingerprint, n (pairs), wide and sums (arrays)."""
    parts = F.struct(F.size("__pairs").cast("long").alias("n"), F.array(*map(wide_lane, range(WIDE))).alias("wide"), F.array(*map(lane_sum, range(SUMS))).alias("sums"))
    return (
        rows.withColumn("__paragraphs", paragraphs(F.col(text_col)))
        .withColumn("__words", words(text_or_empty(F.col(text_col))))
        .withColumn("__pairs", pair_hashes(F.col("__words")))
        .withColumn(name, parts)
        .drop("__paragraphs", "__words", "__pairs")
    )


def lanes(sums: Column, n: Column) -> Column:
    """Counts of lanes; of the numbers that a lane may stand for, the one nearest to half the pairs (exact below 2 ** 20 pairs)."""
    size = 1 << LANE_BITS
    plain = F.array(*(F.shiftrightunsigned(F.get(sums, F.lit(k)), GAP * j).bitwiseAND(F.lit(size - 1)) for k in range(SUMS) for j in range(3)))
    return F.when(n < size, plain).otherwise(F.transform(plain, lambda x: x + F.lit(size) * F.round((n / 2 - x) / size).cast("long")))


def text_form(wide: Column, sums: Column) -> Column:
    hexes = lambda a, n: F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), n, "0")), "")
    return F.concat(hexes(wide, WIDE_BITS // 4), F.lit(":"), hexes(sums, 16))


def likeness(n: Column, sums: Column, wide: Column, m: Column, other_sums: Column, other_wide: Column) -> Column:
    """0 to 1: twice the pairs that both texts have, of all pairs, from the two fingerprints alone.

    A lane holds the number of pairs whose hash has its bit set; twice that less the number of pairs is a sum of signs.
    Mean squares of such sums estimate squared norms of the pairs' frequencies; those of the difference and of both texts
    give the likeness.  A norm is no less than the number of pairs.
    """
    a, b = lanes(sums, n), lanes(other_sums, m)
    mean_square = lambda x: F.aggregate(x, F.lit(0.0), lambda t, v: t + v.cast("double") * v) / F.lit(float(LANES))
    apart = mean_square(F.zip_with(a, b, lambda x, y: F.lit(2) * (x - y) - (n - m)))
    norms = mean_square(F.transform(a, lambda x: F.lit(2) * x - n)) + mean_square(F.transform(b, lambda x: F.lit(2) * x - m))
    some = F.greatest(F.lit(0.0), F.lit(1.0) - apart / F.greatest(norms, (n + m).cast("double")))
    return F.when((wide == other_wide) & (sums == other_sums), F.lit(1.0)).when((n + m) == 0, F.lit(0.0)).otherwise(some)


def order(rows: DataFrame) -> DataFrame:
    """(key, before, quarter): for each key of ``rows`` (key, n_chars) the key before it and a quarter of that one's length.

    Before the first comes the last.  Each range of keys is put in order by itself; ranges are as many as partitions.
    """
    each = rows.groupBy("key").agg(F.max("n_chars").alias("n_chars"))
    ranged = cut(each.repartitionByRange("key").withColumn("range", F.spark_partition_id()), "fingerprint-order")
    lasts = ranged.groupBy("range").agg(F.max(F.struct("key", "n_chars")).alias("last"))
    over = Window.orderBy("range")  # one row for each range
    lasts = lasts.select("range", F.coalesce(F.lag("last").over(over), F.last("last").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("other"))
    own = F.lag(F.struct("key", "n_chars")).over(Window.partitionBy("range").orderBy("key"))
    found = ranged.withColumn("own", own).join(lasts, "range").withColumn("x", F.coalesce("own", "other"))
    return found.select("key", F.col("x.key").alias("before"), F.floor(F.col("x.n_chars") / 4).cast("int").alias("quarter"))


#: The key of rows with a null id.
NONE = -(1 << 63)


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each row's key (the id, or NONE) and text, the key of the next document, and the start of its text.

    Both joins read the same columns of the rows, so texts are shuffled once for them.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NONE)).alias("key"), text_or_empty(F.col(text_col)).alias("text"))
    links = cut(order(rows.select("key", F.char_length("text").alias("n_chars"))), "fingerprint-links")
    starts = rows.join(links, "key").select(F.col("before").alias("key"), F.col("key").alias("next_key"), F.expr("substring(text, 1, quarter)").alias("start"))
    return rows.join(starts.groupBy("key", "next_key").agg(F.min("start").alias("start")), "key")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last quarter (rounded down, in code points) replaced by as much of the next text's start.
    """
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    pairs = with_next(docs, id_col, text_col).select("key", "next_key", "text", n.cast("long").alias("n_chars"), F.concat(F.col("text").substr(F.lit(1), n - quarter), F.col("start").substr(F.lit(1), quarter)).alias("edited"))
    marked = fingerprinted(fingerprinted(pairs, "text", "f"), "edited", "e")
    wide_rows = cut(marked.select("key", "next_key", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "f", "e"), "fingerprints")
    following = cut(wide_rows.groupBy(F.col("key").alias("next_key")).agg(F.min(F.struct("f.n", "f.wide", "f.sums")).alias("g")), "fingerprints-next")
    near = lambda a, b: likeness(F.col(f"{a}.n"), F.col(f"{a}.sums"), F.col(f"{a}.wide"), F.col(f"{b}.n"), F.col(f"{b}.sums"), F.col(f"{b}.wide"))
    return wide_rows.join(following, "next_key").select(
        F.when(F.col("key") != NONE, F.col("key")).alias(id_col), "n_chars", "edited_sha256", text_form(F.col("f.wide"), F.col("f.sums")).alias("fingerprint"), text_form(F.col("e.wide"), F.col("e.sums")).alias("edited_fingerprint"),
        near("f", "e").alias("near_edited"), near("f", "g").alias("near_next"),
    )
