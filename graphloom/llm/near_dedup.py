"""Near-duplicate documents by SetSketch.

1. Each text becomes a set of word shingles; the set's SetSketch registers and a digest of the set are kept.
2. Rows with equal sets collapse to one representative before anything is compared, so copies cost nothing more.
3. Bands of register values give buckets.  In each bucket every member is paired with the lowest id only (a star).
   A pair's similarity is estimated from both sketches by maximum likelihood; clear misses go; the others are verified
   on their full sets.  Verified links give components.
4. Buckets whose members are not yet in one component are finished exactly: all pairs of different components are
   compared on sketches and then on their full sets inside blocks of bounded rows and bytes, each pair once (in the first
   band that both share).  A block joins components as it finds links, skips pairs that are joined already, and gives out
   one link for each join, so fewer links leave it than it has members; the bucket's largest component meets the other
   members only, never itself.

Bands are as wide as the threshold allows: 36 of 7 registers at 0.85, where a pair at the threshold shares no bucket with
a probability of 9e-7, and 42 of 6 registers at 0.8 (3e-6).  The estimate has a standard error of 0.02 to 0.03; pairs up
to ``MARGIN`` below the threshold are verified.  A full set holds the 64-bit hash of each distinct shingle: two different
shingles of a pair of sets of a million fall together with a probability of 5e-8.

Null or empty texts have empty sets and are linked with nothing.  Rows with equal text fall together whatever their
ids; rows with a null id keep a null component.  Rows that share an id are one document: a link of one of its texts is a
link of the id, each row's component is that of its own set, and the filter keeps or drops all of them.  An empty table gives no rows.  The report drops other columns; the
filter keeps them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import setsketch
from graphloom.llm.common import cut, drop, small_batches, text_groups
from graphloom.llm.components import connected_components

MARGIN = 0.11
#: Members of one side of a block and shingles in them, pairs of one salt, and ids that may be broadcast (8 bytes each).
SIDE, SIDE_SHINGLES, PAIRS, BROADCAST_IDS = 256, 1_000_000, 32, 1_000_000


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, n, digest, regs) of each row; digest and regs are null for an empty set."""

    def run(batches):
        for b in batches:
            for part, texts in text_groups(b, 1):
                sets = [setsketch.shingles(t, width) for t in texts]
                digests = [setsketch.digest(s) if len(s) else None for s in sets]
                place: dict[bytes, int] = {}
                new = []
                for s, d in zip(sets, digests):
                    if d is not None and d not in place:
                        place[d] = len(new)
                        new.append(s)
                regs = setsketch.sketch(new)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([None if d is None else regs[place[d]].tobytes() for d in digests], pa.binary())], ["id", "n", "digest", "regs"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, n long, digest binary, regs binary")


def band_rows(reps: DataFrame, width: int) -> DataFrame:
    """(id, band, key): a row for each band of ``width`` registers of each representative."""
    each = setsketch.M // width

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                keys = setsketch.bands(_regs(part.column(1).to_pylist()), width)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(np.arange(0, keys.size + 1, each, dtype=np.int32), keys.ravel())], ["id", "keys"])

    return reps.select("id", "regs").mapInArrow(run, "id long, keys array<long>").select("id", F.posexplode("keys").alias("band", "key"))


def _regs(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.uint16).reshape(-1, setsketch.M)


def likely(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose estimated similarity is at least ``least``."""
    side = lambda x: reps.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                a, c, na, nc, ra, rc = b.slice(at, 2048).columns
                est = setsketch.estimate(_regs(ra.to_pylist()), _regs(rc.to_pylist()), na.to_numpy(), nc.to_numpy())
                keep = pa.array(est >= least)
                yield pa.RecordBatch.from_arrays([a.filter(keep), c.filter(keep)], ["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long")


def reaches(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets are similar enough."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold.

    A first id with many partners is dealt out by a salt; its text goes once to each salt, and partners stream by.
    """
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS).cast("long").alias("salts"))
    dealt = pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"))
    heads = dealt.select("a", "salt").distinct().join(texts.withColumnRenamed("id", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    rest = dealt.join(texts.withColumnRenamed("id", "b"), "b").select("a", "salt", "b", "text")

    def run(batches):
        at, own = None, []
        for batch in batches:
            out = []
            for part, texts_ in text_groups(batch, 3):
                for a, salt, b, text in zip(*(c.to_pylist() for c in part.columns[:3]), texts_):
                    s = setsketch.shingles(text, width)
                    if b is None:
                        own = [*own, s] if at == (a, salt) else [s]
                        at = (a, salt)
                    elif at == (a, salt) and any(reaches(x, s, percent) for x in own):
                        out.append((a, b))
            cols = list(zip(*out)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])

    return heads.unionByName(rest).repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b")).mapInArrow(run, "a long, b long")


def full_sets(texts: DataFrame, width: int) -> DataFrame:
    """(id, n, digest, words): the sorted 64-bit hashes of the set, its size and its digest."""

    def run(batches):
        for b in batches:
            for part, own in text_groups(b, 1):
                sets = [setsketch.shingles(t, width) for t in own]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(setsketch.digest, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "n", "digest", "words"])

    return texts.select("id", "text").mapInArrow(run, "id long, n long, digest binary, words binary")


class Rows:
    """Members of a block as arrays."""

    def __init__(self, key, i, j, left, right, band, id_, comp, n, regs, keys, words):
        self.parts = key, i, j, left, right, band, id_, comp, n, regs, keys, words

    @classmethod
    def of(cls, batch: pa.RecordBatch, width: int) -> "Rows":
        *plain, regs, words = batch.columns
        regs = _regs(regs.to_pylist())
        blobs = np.empty(len(regs), object)
        blobs[:] = words.to_pylist()
        return cls(*(c.to_numpy(zero_copy_only=False) for c in plain), regs, setsketch.bands(regs, width), blobs)

    def take(self, at) -> "Rows":
        return Rows(*(x[at] for x in self.parts))

    def __add__(self, other: "Rows") -> "Rows":
        return Rows(*(np.concatenate([x, y]) for x, y in zip(self.parts, other.parts)))

    def groups(self) -> np.ndarray:
        """Where each group of equal (key, i, j) begins."""
        key, i, j = self.parts[:3]
        return np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))

    def links(self, least: float, percent: int) -> list[tuple[int, int]]:
        """Of one group: verified pairs that join different components, one for each join.

        A pair that shared an earlier band is left to that band's group.
        """
        key, i, j, left, right, band, id_, comp, n, regs, keys, words = self.parts
        x, y = np.flatnonzero(left), np.flatnonzero(right)
        ok = (comp[x][:, None] != comp[y][None, :]) & (100 * np.minimum(n[x][:, None], n[y][None, :]) >= percent * np.maximum(n[x][:, None], n[y][None, :]))
        if i[0] == j[0]:
            ok &= id_[x][:, None] < id_[y][None, :]
        p, q = np.nonzero(ok)
        found, over = [], {}

        def root(c):
            while c in over:
                c = over[c]
            return c

        for s in range(0, len(p), 4096):
            a, b = x[p[s : s + 4096]], y[q[s : s + 4096]]
            near = (regs[a] == regs[b]).sum(1) >= (least - 0.1) * setsketch.M
            near &= (keys[a, : band[0]] != keys[b, : band[0]]).all(1)
            a, b = a[near], b[near]
            if len(a):
                good = setsketch.estimate(regs[a], regs[b], n[a], n[b]) >= least
                for u, v in zip(a[good].tolist(), b[good].tolist()):
                    c, d = root(comp[u]), root(comp[v])
                    if c != d and reaches(np.frombuffer(words[u], np.uint64), np.frombuffer(words[v], np.uint64), percent):
                        over[max(c, d)] = min(c, d)
                        found.append((min(id_[u], id_[v]), max(id_[u], id_[v])))
        return found


def crossing(members: DataFrame, profiles: DataFrame, least: float, percent: int, width: int) -> DataFrame:
    """Links between different components within a bucket, compared in blocks; each joins two components of its block.

    ``members`` has key, band, id, comp, largest (the bucket's largest component), and the number of parts that it
    (within) and the other members (others) are dealt into; ``profiles`` id, n, regs and words.  Parts of the largest
    component, numbered last, meet parts of the others only.
    """
    mine = F.col("comp") == F.col("largest")
    rows = (
        members.join(profiles, "id")
        .withColumn("part", F.when(mine, F.col("others") + F.pmod(F.xxhash64("id"), F.col("within"))).otherwise(F.pmod(F.xxhash64("id"), F.col("others"))))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1 + F.when(mine, 0).otherwise(F.col("within")))))
        .select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") <= F.col("other")).alias("left"), (F.col("part") >= F.col("other")).alias("right"), "band", "id", "comp", "n", "regs", "words")
    )

    def batch_of(found):
        cols = list(zip(*found)) or [[], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                part = Rows.of(batch.slice(s, 1024), width)
                held = part if held is None else held + part
                at = held.groups().tolist()
                yield batch_of([x for a, b in zip(at, at[1:]) for x in held.take(slice(a, b)).links(least, percent)])
                held = held.take(slice(at[-1], None))
        yield batch_of(held.links(least, percent) if held else [])

    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long")


def only(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose id is in ``ids``; the ids are broadcast when their counted size allows it."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Per row: id, n_shingles, component_id, kept."""
    small_batches(docs.sparkSession)
    least = percent / 100 - MARGIN
    marks = cut(sketches(docs, id_col, text_col, width), "near-sketches")
    sets = marks.where("n > 0 and id is not null")
    reps = cut(sets.groupBy("digest").agg(F.min_by(F.struct("id", "n", "regs"), "id").alias("x")).select("x.id", "x.n", "x.regs", "digest"), "near-sets")
    sketched = reps.select("id", "n", "regs")
    band = setsketch.band_rows(percent / 100)
    # bands are read twice, and buckets are written before they meet them: a join that shares no shuffle with an
    # aggregation can split a hot bucket
    rows = cut(band_rows(reps, band), "near-bands")
    buckets = cut(rows.groupBy("key").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("size")).where("size > 1").select("key", "pivot"), "near-heads")
    members = cut(rows.join(buckets, "key"), "near-buckets")
    drop(rows, buckets)
    ids = cut(members.select("id").distinct(), "near-ids")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("hash"))
    texts = cut(only(texts, ids).dropDuplicates(["id", "hash"]).select("id", "text"), "near-texts")

    star = cut(members.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), "near-star")
    close = cut(likely(star, sketched, least), "near-likely")
    links = cut(verified(close, texts, width, percent), "near-links")
    drop(star, close, ids)
    comps = cut(connected_components(links), "near-components")

    labelled = members.join(comps, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component", "pivot")
    sized = labelled.join(reps.groupBy("id").agg(F.max("n").alias("n")), "id")
    shares = sized.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"))
    shares = shares.groupBy("key").agg(F.max(F.struct("rows", "comp", "shingles")).alias("top"), F.sum("rows").alias("all"), F.sum("shingles").alias("all_shingles")).where("all > top.rows")
    parts = lambda rows, shingles: F.greatest(F.ceil(rows / SIDE), F.ceil(shingles / SIDE_SHINGLES)).cast("long")
    mixed = shares.select("key", F.col("top.comp").alias("largest"), parts(F.col("top.rows"), F.col("top.shingles")).alias("within"), parts(F.col("all") - F.col("top.rows"), F.col("all_shingles") - F.col("top.shingles")).alias("others"))
    unsettled = cut(labelled.join(cut(mixed, "near-mixed"), "key"), "near-unsettled")
    own = cut(full_sets(only(texts, cut(unsettled.select("id").distinct(), "near-ids")), width).join(reps.select("id", "digest", "regs"), ["id", "digest"]).select("id", "n", "regs", "words"), "near-full-sets")
    more_links = cut(crossing(unsettled, own, least, percent, band), "near-more")
    drop(members, texts, unsettled, own)
    if not more_links.isEmpty():
        name = lambda x: F.coalesce(F.col(f"c{x}.component"), F.col(x)).alias(x)
        joined = more_links.join(comps.alias("ca"), F.col("a") == F.col("ca.id"), "left").join(comps.alias("cb"), F.col("b") == F.col("cb.id"), "left").select(name("a"), name("b"))
        over = cut(connected_components(joined), "near-over").toDF("old", "low")
        known = comps.join(over, comps["component"] == over["old"], "left").select("id", F.coalesce("low", "component").alias("component"))
        comps = known.unionByName(over.join(comps, over["old"] == comps["id"], "left_anti").select(F.col("old").alias("id"), F.col("low").alias("component")))
    named = reps.select("digest", F.col("id").alias("rep")).join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = marks.select("id", "n", "digest").join(named, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with its columns, one document of each group of near duplicates: the one with the smallest id."""
    gone = near_duplicates(docs, id_col, text_col, width, percent).where(~F.col("kept")).select(F.col(id_col).alias("__gone"))
    return docs.join(gone, docs[id_col].cast("long") == F.col("__gone"), "left_anti")
