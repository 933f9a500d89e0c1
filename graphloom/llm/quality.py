"""Quality of texts by a byte-level convolutional network in numpy.

A text is its UTF-8 bytes, cut into chunks of 64 bytes that overlap by half and cover all of it.  Learned filters of four
bytes (stride two) run over the bytes; their rectified responses are averaged in each chunk.  A hidden layer reads each
chunk, its units are max-pooled over the document's chunks, and one logistic unit combines them into the probability of
label 1.

The network is trained on the driver from at most ``SAMPLE`` labelled rows of each class: those with the lowest hash of
the id, never held-out ones, and among them those of at most ``SAMPLE_BYTES`` bytes, each of them whole.  Scoring reads
whole texts of any length.  Ids, languages and sources are never inputs.

Null counts as empty; an empty text is one chunk of padding and gets a score like any other.  NUL bytes count as padding.
A null id is scored like any other and is never held out.  Without usable labels each
score is 0.5.  Repeated rows are scored each for itself; an empty table gives no rows.  The report drops other
columns; the filter keeps them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import small_batches, text_groups

BLOCK, FILTERS, HIDDEN = 32, 8, 32
SAMPLE, SAMPLE_BYTES = 1500, 1 << 16
EPOCHS, BATCH, RATE = 4, 128, 0.01
THRESHOLD = 0.3
#: Bytes scored at once.
GROUP_BYTES = 1 << 20


class Net:
    """Parameters and the forward and backward pass over a group of texts."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "t": r.normal(0, 0.3, (4, 256, FILTERS)).astype(np.float32), "c": np.zeros(FILTERS, np.float32),
            "w": r.normal(0, FILTERS**-0.5, (FILTERS, HIDDEN)).astype(np.float32), "b": np.zeros(HIDDEN, np.float32),
            "v": r.normal(0, HIDDEN**-0.5, HIDDEN).astype(np.float32), "a": np.zeros(1, np.float32),
        }

    @staticmethod
    def buffer(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All texts in one zero-padded array, and where each one's first chunk is; each starts with a block of zeros."""
        blocks = [2 + max(1, -(-len(t) // BLOCK)) for t in texts]
        starts = np.concatenate([[0], np.cumsum(blocks)[:-1]])
        x = np.zeros(BLOCK * int(sum(blocks)), np.uint8)
        for t, s in zip(texts, starts):
            at = (int(s) + 1) * BLOCK
            x[at : at + len(t)] = np.frombuffer(t, np.uint8)
        return x, starts

    def forward(self, x: np.ndarray, starts: np.ndarray, train: bool = False):
        p = self.p
        size = (x != 0).reshape(-1, BLOCK).sum(1, dtype=np.float32)
        pairs = x.astype(np.uint16)[:-1] << 8
        pairs = np.append(pairs | x[1:], np.uint16(0))
        first, second = pairs[0::2], np.append(pairs[2::2], np.uint16(0))
        both = lambda i: (p["t"][i][:, None, :] + p["t"][i + 1][None, :, :]).reshape(65536, FILTERS)
        h = both(0)[first]
        h += both(2)[second]
        h += p["c"]
        np.maximum(h, 0, out=h)
        h[x[0::2] == 0] = 0
        conv = h.reshape(-1, BLOCK // 2, FILTERS).sum(1)
        chunk = lambda y: y[:-1] + y[1:]
        n = np.maximum(chunk(size), 8)[:, None]
        z = 2 * chunk(conv) / n
        g = np.maximum(z @ p["w"] + p["b"], 0)
        ends = np.append(starts[1:], len(size))
        # the chunk of a text's last block and the next one's zeros belongs to no text
        bounds = np.stack([starts, ends - 1], 1).ravel()
        pool = np.maximum.reduceat(np.append(g, np.zeros((1, HIDDEN), np.float32), 0), bounds)[::2]
        score = 1 / (1 + np.exp(-(pool @ p["v"] + p["a"])))
        return (score, (h, first, second, n, z, g, pool, bounds)) if train else score

    def gradient(self, x, starts, label):
        p = self.p
        score, (h, first, second, n, z, g, pool, bounds) = self.forward(x, starts, True)
        d = ((score - label) / len(label)).astype(np.float32)
        out = {"v": pool.T @ d, "a": d.sum(keepdims=True)}
        dg = np.zeros_like(g)
        dpool = d[:, None] * p["v"]
        for i, (s, e) in enumerate(bounds.reshape(-1, 2)):
            top = g[s:e].argmax(0) + s
            dg[top, np.arange(HIDDEN)] = dpool[i] * (pool[i] > 0)
        out["w"], out["b"] = z.T @ dg, dg.sum(0)
        dz = 2 * (dg @ p["w"].T) / n
        dconv = np.zeros((len(h) // (BLOCK // 2), FILTERS), np.float32)
        dconv[:-1] += dz
        dconv[1:] += dz
        rows = np.repeat(dconv, BLOCK // 2, 0) * (h > 0)
        live = np.flatnonzero(rows.any(1))
        rows, f, s = rows[live], first[live], second[live]
        out["c"] = rows.sum(0)
        out["t"] = np.stack([np.stack([np.bincount(i, rows[:, k], 256) for k in range(FILTERS)], 1) for i in (f >> 8, f & 255, s >> 8, s & 255)]).astype(np.float32)
        return out

    def fit(self, texts: list[bytes], labels: np.ndarray, seed: int = 7) -> "Net":
        """Adam over balanced batches, in an order that the seed fixes."""
        r = np.random.default_rng(seed)
        m, s, step = {k: 0 for k in self.p}, {k: 0 for k in self.p}, 0
        sides = [np.flatnonzero(labels == k) for k in (0, 1)]
        if not all(map(len, sides)):
            return self
        rounds = max(20, EPOCHS * max(map(len, sides)) // (BATCH // 2))
        for _ in range(rounds):
            pick = np.concatenate([r.choice(x, BATCH // 2) for x in sides])
            x, starts = self.buffer([texts[i] for i in pick])
            step += 1
            for k, g in self.gradient(x, starts, labels[pick].astype(np.float32)).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                self.p[k] -= (RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def score(self, texts: list[bytes]) -> list[float]:
        out, group, size = [], [], 0
        for t in texts:
            if group and size + len(t) > GROUP_BYTES:
                out += self.forward(*self.buffer(group)).tolist()
                group, size = [], 0
            group.append(t)
            size += len(t)
        return out + (self.forward(*self.buffer(group)).tolist() if group else [])


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Net | None:
    """A network fitted on a bounded sample of the labelled rows that are not held out; None without both classes."""
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"), F.xxhash64(id_col).alias("hash")).where(~held_out(F.col("id")) & F.col("id").isNotNull() & F.col("label").isin(0, 1))
    some = None
    for k in (0, 1):
        part = usable.where(F.col("label") == k).orderBy("hash", "id").limit(sample)
        some = part if some is None else some.unionByName(part)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES)
    rows = texts.join(F.broadcast(some), "id").select("text", "label", "hash").toLocalIterator()  # at most 2 * sample rows of SAMPLE_BYTES
    rows = sorted((r["hash"], r["label"], r["text"].encode("utf-8", "surrogatepass")) for r in rows)
    target = np.array([label for _, label, _ in rows])
    if len(set(target.tolist())) < 2:
        return None
    return Net().fit([t for _, _, t in rows], target)


def scores(docs: DataFrame, net: Net | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row, over its whole text."""
    kind = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            for part, own in text_groups(b, 1):
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in own]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(net.score(texts) if net else [0.5] * len(texts), pa.float64())], ["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, held_out, score, predicted."""
    out = scores(docs, train(docs, labels, id_col, text_col), id_col, text_col)
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with its columns, without the documents that the network rejects."""
    net = train(docs, labels, id_col, text_col)
    small_batches(docs.sparkSession)
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        for b in batches:
            for part, own in text_groups(b, at):
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in own]
                yield part.filter(pa.array([x >= threshold for x in net.score(texts)], pa.bool_())) if net else part

    return docs.mapInArrow(run, docs.schema)
