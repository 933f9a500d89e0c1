"""Packing of tokenised documents into sequences of bounded length.

Bounded-space online best fit.  Pieces come in an order that a hash of document and piece fixes, and each is placed for
good when it comes.  At most ``OPEN_BINS`` bins are open.  Free space is a small integer, so they are keyed by it: a bitset
has the bit ``f`` set while some open bin has ``f`` places free, and the best bin for a piece of length ``n`` is the lowest
set bit at or above ``n``.  If none fits and all allowed bins are open, the fullest closes first.

Documents are tokenised where they are read; only small piece rows (no ids, no texts) are shuffled, dealt by a hash
of document and piece into blocks of about ``BLOCK`` pieces.  Each block is packed alone and leaves at most its open bins
unfilled.  The number of blocks grows with the data; no block depends on another.

Null text counts as empty: such a document is one piece that holds the end id alone.  Repeated rows are packed each
for itself.  An empty table gives no rows.  Other columns of the input are ignored and dropped.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut, small_batches, text_groups

TOKENIZER, LENGTH, END_ID = "word_bpe_49k.json", 4096, 1
OPEN_BINS, BLOCK = 64, 16_384
CACHE_ENTRIES, CACHE_CHARS = 500_000, 64
#: Texts of these characters alone need no Unicode normalisation and lower-case one to one.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-įı-ſ]*")
LETTERS, NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-ſ", "0-9\xb2\xb3\xb9\xbc-\xbe"
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\\s{LETTERS}{NUMBERS}]+")
#: Rows whose new words go to the library in one call.
GROUP = 256


def byte_letters() -> dict[int, str]:
    """For each character of plain texts the letters that stand for its UTF-8 bytes in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0x180)}


class WordIds:
    """Ids of texts as little-endian 32-bit bytes; each distinct word of plain texts is merged once.

    The tokenizer drops white space and cuts texts into words before it merges.  Plain texts are cut here, and the
    library's merges run on words not met before; any other text goes to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.lib = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.lib.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = byte_letters()
        self.cuts_alike = True
        probe = [f"{a}{chr(c)}{b}" for c in range(0x20, 0x180) for a, b in (("", ""), ("a", "B"), ("Ab ", "1"), ("'s", "' 12"))]
        self.known: dict[str, bytes] = {}  # by word, and by what stands between white space

        self.cuts_alike = self.encode_all(probe) == [self.library(t) for t in probe]  # a tokenizer of other rules gets whole texts
        self.known = {}

    def library(self, text: str) -> bytes:
        return np.asarray(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def merged(self, words: list[str]) -> list[bytes]:
        e = self.merges.encode(" ".join(words).translate({**self.letters, 32: " "}), add_special_tokens=False)
        ids, at = array("I", e.ids), np.flatnonzero(np.diff(np.asarray(e.word_ids, np.int64), prepend=-1)).tolist() + [len(e.ids)]
        return [ids[a:b].tobytes() for a, b in zip(at, at[1:])]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        if not self.cuts_alike:
            return [self.library(t) for t in texts]
        split = [t.lower().split() if "<|" not in t and PLAIN.fullmatch(t) else None for t in texts]
        if len(self.known) > CACHE_ENTRIES:
            self.known = {}
        known = self.known
        found = [w and list(map(known.get, w)) for w in split]  # one lookup a word; the table is larger than a CPU's cache
        gaps = [[i for i, x in enumerate(f) if x is None] if f else () for f in found]
        new = {w[i] for w, g in zip(split, gaps) for i in g}
        parts = {w: WORDS.findall(w) for w in new if not w.isalpha()}  # words of letters alone are not cut
        missing = list(set(filterfalse(known.__contains__, chain.from_iterable(parts.values()))).union(w for w in new if w.isalpha()))
        if missing:
            known.update(zip(missing, self.merged(missing)))
        known.update((w, b"".join([known[x] for x in p])) for w, p in parts.items() if w not in known)
        for w, f, g in zip(split, found, gaps):
            for i in g:
                f[i] = known[w[i]]
        out = [self.library(t) if f is None else b"".join(f) for t, f in zip(texts, found)]
        for w in {*new, *missing}:
            if len(w) > CACHE_CHARS:
                known.pop(w, None)
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, length: int = LENGTH) -> DataFrame:
    """A row for each piece of at most ``length`` ids: id, piece, start, length, ids_crc32."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        w, end = word_ids(public_tokenizers.path(tokenizer)), np.asarray([END_ID], "<u4").tobytes()
        for b in batches:
            at, rows = [], []
            for i, ids in enumerate(x + end for _, texts in text_groups(b, 1, rows=GROUP) for x in w.encode_all([t or "" for t in texts])):
                for k, s in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[s : s + 4 * length]
                    at.append(i)
                    rows.append((k, s // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


class BestFit:
    """Best fit over at most ``bins`` open bins of ``length`` places."""

    def __init__(self, length: int, bins: int):
        self.length, self.bins, self.open, self.bits, self.made = length, bins, 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(length + 1)]

    def _take(self, free: int) -> int:
        bin_ = self.by_free[free].pop()
        self.open -= 1
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        return bin_

    def place(self, n: int) -> tuple[int, int]:
        """Number of the bin that takes a piece of ``n`` ids, and the place in it."""
        fit = self.bits >> n
        if fit:
            free = n + (fit & -fit).bit_length() - 1
            bin_ = self._take(free)
        else:
            free, bin_ = self.length, self.made
            self.made += 1
        left = free - n
        if left:
            if self.open >= self.bins:  # the fullest has the least free space
                self._take((self.bits & -self.bits).bit_length() - 1)
            self.by_free[left].append(bin_)
            self.bits |= 1 << left
            self.open += 1
        return bin_, self.length - free


def pack(parts: DataFrame, length: int = LENGTH, bins: int = OPEN_BINS, block: int = BLOCK) -> DataFrame:
    """Adds sequence_id and offset to piece rows; ``parts`` is read twice and should be a written table."""
    n = max(1, -(-parts.count() // block))

    def run(batches):
        block_, fit = None, None
        for b in batches:
            made = []
            for k, size in zip(b.column(0).to_pylist(), b.column(4).to_pylist()):
                if k != block_:
                    block_, fit = k, BestFit(length, bins)
                bin_, off = fit.place(size)
                made.append((block_ << 32 | bin_, off))
            cols = list(zip(*made)) or [[]] * 2
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *(pa.array(c, pa.int64()) for c in cols)], [*b.schema.names[1:], "sequence_id", "offset"])

    kind = parts.schema["id"].dataType.simpleString()
    return (
        parts.select(F.pmod(F.xxhash64("id", "piece"), F.lit(n)).alias("block"), "id", "piece", "start", "length", "ids_crc32")
        .repartition(n, "block")
        .sortWithinPartitions("block", F.xxhash64("piece", "id"), "id", "piece", "ids_crc32")
        .mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    )


def best_fit_packing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, length: int = LENGTH) -> DataFrame:
    """Pieces of all documents with their sequence and place."""
    small_batches(docs.sparkSession)
    return pack(cut(pieces(docs, id_col, text_col, tokenizer, length), "pieces"), length).withColumnRenamed("id", id_col)
