"""Removal of byte strings that occurred before, by distributed prefix doubling.

The rank of a position at length h is a 64-bit name of its h bytes; the pair of ranks at p and p + h gives the rank at
2h, so ranks at growing offsets need no join.  Positions leave as soon as their rank is unique, in three rounds:

1. (24 bytes)  Of each window of ``length`` bytes one position is examined: the one of its 24-byte ranks that is
   lowest (ties: leftmost).  Equal windows examine equal positions, so a rank that occurs once in all texts frees every
   window that examines it.  About one position in forty is counted, and counts are combined before the shuffle.
   Repeated ranks meet the positions by a join of numbers alone; only then do texts give out strings.
2. (the run)   Neighbouring windows that examine one position make one string.  Equal strings collapse to their first
   occurrence and its copies; copies are repeats throughout, so a hot group of copies costs one row.
3. (``length`` bytes)  Where one rank has several strings, their windows' rank pairs are sorted, and each window whose
   rank has an earlier position is a repeat.  Ranks with more than ``GROUP`` strings are dealt out by window.

A byte goes if a window that covers it starts earlier too: in a smaller id, or in the same text at a smaller place.
Windows never cross texts; repeats are judged on the input.  Null counts as empty, texts shorter than ``length`` stay.
Rows that share an id are at equal places, so neither is earlier than the other.  An empty table gives no rows.
The report drops other columns; the filter keeps them, and leaves texts valid UTF-8 by keeping characters whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut, drop

LENGTH, GRAM = 100, 24
#: Strings of one rank that one task sorts; bytes ranked at once.
GROUP, BYTES = 4096, 1 << 19
TABLE = np.random.default_rng(11).integers(0, 1 << 64, 256, np.uint64, endpoint=False)
C, D = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def join_ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    t = a * C + b
    t ^= t >> np.uint64(29)
    t *= D
    t ^= t >> np.uint64(32)
    return t


def ranks(x: np.ndarray, length: int) -> np.ndarray:
    """Names of the strings of ``length`` bytes at each place, by doubling; the last step overlaps or is shorter."""
    r, h = TABLE[x], 1
    shorter = {1: r}
    while 2 * h <= length:
        r = join_ranks(r[:-h], r[h:])
        h *= 2
        shorter[h] = r
    if h < length:
        r = join_ranks(r[: len(r) - (length - h)], r[length - h :])
    return r


def examined(r: np.ndarray, width: int) -> np.ndarray:
    """Place of the lowest of the ``width`` ranks from each place on, the leftmost of equals."""
    low, at, h = r, np.arange(len(r), dtype=np.int64), 1

    def step(low, at, gap):
        left = low[: len(low) - gap] <= low[gap:]
        return np.where(left, low[: len(low) - gap], low[gap:]), np.where(left, at[: len(at) - gap], at[gap:])

    while 2 * h <= width:
        low, at = step(low, at, h)
        h *= 2
    if h < width:
        low, at = step(low, at, width - h)
    return at


def strings(texts: list[bytes], length: int):
    """Number of text, key, start, windows of each string, and the bytes that all starts count in."""
    x = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    if len(x) < length:
        none = np.empty(0, np.int64)
        return none, none, none, none, ends - sizes
    gram = min(GRAM, length)
    r = ranks(x, gram)
    at = examined(r, length - gram + 1)
    ok = np.zeros(len(at), bool)
    for s, e in zip(ends - sizes, ends - length + 1):
        ok[s : max(s, e)] = True
    new = ok.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~ok[:-1]
    new[[int(s) for s, n in zip(ends - sizes, sizes) if n >= length]] = True
    first = np.flatnonzero(new)
    number = np.cumsum(new)
    windows = np.bincount(number[ok] - 1, minlength=len(first))
    text = np.searchsorted(ends, first, "right")
    return text, r[at[first]].view(np.int64), first, windows, ends - sizes


def in_groups(batches, at: int):
    """(part, texts) of Arrow batches, of a bounded number of bytes unless one text has more."""
    for b in batches:
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(at).to_pylist()]
        s = size = 0
        for k, t in enumerate(texts):
            if k > s and size + len(t) > BYTES:
                yield b.slice(s, k - s), texts[s:k]
                s, size = k, 0
            size += len(t)
        if s < len(texts):
            yield b.slice(s), texts[s:]


def positions(docs: DataFrame, length: int) -> DataFrame:
    """(key, id, mark, start, windows) of each string, without its bytes."""

    def run(batches):
        for part, texts in in_groups(batches, 2):
            text, key, first, windows, starts = strings(texts, length)
            at = pa.array(text)
            yield pa.RecordBatch.from_arrays([pa.array(key), part.column(0).take(at), part.column(1).take(at), pa.array(first - starts[text]), pa.array(windows)], ["key", "id", "mark", "start", "windows"])

    return docs.select("id", "mark", "text").mapInArrow(run, "key long, id long, mark long, start long, windows long")


def occurrences(marked: DataFrame, length: int) -> DataFrame:
    """(key, id, start, windows, bytes) of the strings that ``marked`` (id, text, found) names."""

    def run(batches):
        for b in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
            found = b.column(2).flatten()
            row = np.repeat(np.arange(b.num_rows), b.column(2).value_lengths().to_numpy())
            for s in range(0, len(row), 20_000):
                own, part = row[s : s + 20_000], found.slice(s, 20_000)
                key, start, windows = part.flatten()
                ends = start.to_numpy() + windows.to_numpy() + (length - 1)
                content = [texts[r][i:e] for r, i, e in zip(own.tolist(), start.to_pylist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([key, b.column(0).take(pa.array(own)), start, windows, pa.array(content, pa.binary())], ["key", "id", "start", "windows", "bytes"])

    return marked.select("id", "text", "found").mapInArrow(run, "key long, id long, start long, windows long, bytes binary")


def window_names(contents: list[bytes], windows: np.ndarray, keys_: np.ndarray, length: int):
    """Number of the string, place in it, and name of each window."""
    x = np.frombuffer(b"".join(contents), np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(c) for c in contents])[:-1]])
    row = np.repeat(np.arange(len(contents)), windows)
    place = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    return row, place, join_ranks(ranks(x, length)[begin[row] + place], keys_[row].view(np.uint64)).view(np.int64)


def runs(row, place, flag):
    """Maximal runs of flagged windows as (row, first place, count)."""
    i = np.flatnonzero(flag)
    if not len(i):
        return i, i, i
    head = np.flatnonzero(np.concatenate([[True], (np.diff(i) != 1) | (np.diff(row[i]) != 0)]))
    return row[i[head]], place[i[head]], np.diff(np.append(head, len(i)))


RANGE = "id long, start long, windows long"


def repeats_in_groups(firsts: DataFrame, length: int) -> DataFrame:
    """Windows of first occurrences that have an earlier place in another string of the same key."""

    def ranges(rows):
        rows.sort(key=lambda r: (r[1], r[2]))
        key, id_, start, windows = (np.array(c, np.int64) for c in list(zip(*rows))[:4])
        row, place, name = window_names([r[4] for r in rows], windows, key, length)
        _, first, inverse = np.unique(name, return_index=True, return_inverse=True)
        # places of one id and start (rows that share an id) are not before each other
        own, lead = np.stack([id_[row], start[row] + place]), first[inverse]
        r, p, n = runs(row, place, (own != own[:, lead]).any(0))
        return pa.RecordBatch.from_arrays([pa.array(id_[r]), pa.array(start[r] + p), pa.array(n.astype(np.int64))], ["id", "start", "windows"])

    def run(batches):
        held, last = [], None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if len(held) >= 5000 and row[0] != last:
                    yield ranges(held)
                    held = []
                held.append(row)
                last = row[0]
        if held:
            yield ranges(held)

    return firsts.select("key", "id", "start", "windows", "bytes").repartition("key").sortWithinPartitions("key").mapInArrow(run, RANGE)


def repeats_by_window(firsts: DataFrame, length: int) -> DataFrame:
    """The same for keys of very many strings: each window is a row of its own."""

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 2000):
                key, id_, start, windows, content = b.slice(s, 2000).columns
                row, place, name = window_names(content.to_pylist(), windows.to_numpy(), key.to_numpy(), length)
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(id_.to_numpy()[row]), pa.array(start.to_numpy()[row] + place)], ["name", "id", "start"])

    rows = firsts.select("key", "id", "start", "windows", "bytes").mapInArrow(run, "name long, id long, start long")
    lead = rows.groupBy("name").agg(F.min(F.struct("id", "start")).alias("lead"), F.max(F.struct("id", "start")).alias("last")).where("lead <> last").select("name", "lead")
    return rows.join(lead, "name").where(F.struct("id", "start") != F.col("lead")).select("id", "start", F.lit(1).cast("long").alias("windows"))


def repeated_ranges(docs: DataFrame, length: int) -> DataFrame:
    """(id, ranges): for each text the starts and counts of its windows that occurred earlier."""
    docs = docs.withColumn("mark", F.xxhash64("text"))  # tells rows that share an id apart
    places = cut(positions(docs, length), "substring-positions")
    repeated = cut(places.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "substring-keys")
    found = places.join(repeated, "key", "left_semi").groupBy("id", "mark").agg(F.collect_list(F.struct("key", "start", "windows")).alias("found"))
    marks = cut(found, "substring-marks")
    drop(places, repeated)
    seen = cut(occurrences(docs.join(marks, ["id", "mark"]), length), "substring-strings")
    drop(marks)
    firsts = cut(seen.groupBy("key", "bytes").agg(F.min(F.struct("id", "start", "windows")).alias("x")).select("key", "bytes", "x.*"), "substring-firsts")
    several = firsts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    unsure = cut(firsts.join(several, "key"), "substring-unsure")
    copies = seen.select("id", "start", "windows").join(firsts.select("id", "start"), ["id", "start"], "left_anti")
    found = copies.unionByName(repeats_in_groups(unsure.where(F.col("n") <= GROUP), length)).unionByName(repeats_by_window(unsure.where(F.col("n") > GROUP), length))
    ranges = cut(found.groupBy("id").agg(F.collect_list(F.struct("start", "windows")).alias("ranges")), "substring-ranges")
    drop(seen, firsts, unsure)
    return ranges


def spans(ranges, size: int, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the windows cover."""
    out: list[list[int]] = []
    for s, e in sorted((r["start"], min(size, r["start"] + r["windows"] + length - 1)) for r in ranges or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        elif s < e:
            out.append([s, e])
    return [(s, e) for s, e in out]


def kept(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for s, e in gone:
        parts.append(text[at:s])
        at = e
    return b"".join(parts) + text[at:]


def whole_characters(text: bytes, gone: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans shrunk to begin and end between characters."""
    out = []
    for s, e in gone:
        while s < e and text[s] & 0xC0 == 0x80:
            s += 1
        while s < e < len(text) and text[e] & 0xC0 == 0x80:
            e -= 1
        if s < e:
            out.append((s, e))
    return out


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")


def substring_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches):
        for b in batches:
            out = []
            for t, ranges in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                t = (t or "").encode("utf-8", "surrogatepass")
                gone = spans(ranges, len(t), length)
                rest = kept(t, gone)
                out.append((len(t), len(t) - len(rest), len(gone), hashlib.sha256(rest).hexdigest()))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    joined = rows.join(repeated_ranges(_named(docs, id_col, text_col), length), "id", "left")
    return joined.select("id", "text", "ranges").mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id_col)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with its columns, each text without the characters that a repeated window covers."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        for b in batches:
            out = []
            for t, ranges in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist()):
                if ranges:
                    raw = t.encode("utf-8", "surrogatepass")
                    t = kept(raw, whole_characters(raw, spans(ranges, len(raw), length))).decode("utf-8", "surrogatepass")
                out.append(t)
            cols = list(b.columns[: len(names)])
            cols[at] = pa.array(out, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names)

    ranges = repeated_ranges(_named(docs, id_col, text_col), length).select(F.col("id").alias("__id"), F.col("ranges").alias("__ranges"))
    return docs.join(ranges, docs[id_col].cast("long") == F.col("__id"), "left").drop("__id").mapInArrow(run, docs.schema)


ORACLE = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, s, b[s:s + 99] AS v FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 98)) AS s FROM d WHERE octet_length(b) >= 100)),
f AS (SELECT v, min((doc_id, s)) AS first FROM w GROUP BY v HAVING count(*) > 1),
g AS (SELECT w.doc_id, w.s FROM w JOIN f ON w.v = f.v WHERE (w.doc_id, w.s) > f.first),
i AS (SELECT *, sum(CASE WHEN s <= coalesce(prev, -1000) + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS run
  FROM (SELECT *, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS prev FROM g)),
r AS (SELECT doc_id, run, min(s) AS lo, max(s) + 99 AS hi FROM i GROUP BY doc_id, run),
k AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) + 1 AS from_ FROM r),
p AS (SELECT k.doc_id, count(*) AS n_spans, sum(hi - lo + 1) AS n_removed, string_agg(hex(d.b[from_:lo - 1]), '' ORDER BY lo) AS hexes, max(hi) AS last
  FROM k JOIN d ON k.doc_id = d.doc_id GROUP BY k.doc_id)
SELECT d.doc_id, octet_length(d.b) AS n_bytes, CAST(coalesce(p.n_removed, 0) AS BIGINT) AS n_removed, coalesce(p.n_spans, 0) AS n_spans,
  CASE WHEN p.doc_id IS NULL THEN sha256(d.b) ELSE sha256(unhex(p.hexes || hex(d.b[p.last + 1:octet_length(d.b)]))) END AS kept_sha256
FROM d LEFT JOIN p ON d.doc_id = p.doc_id
"""
