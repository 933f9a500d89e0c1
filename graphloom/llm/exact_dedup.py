"""Exact deduplication by a stateful stream.

A Structured Streaming query keeps one state row for each content digest, on disk (RocksDB), without expiry: the
smallest document id seen, where that document's bytes lie (file and row), and how many rows had the digest.  State
belongs to the shared checkpoint folder, so a lost executor's part is rebuilt from there, and a later call that names the
same folder goes on from it and reads new files only.  A digest hit is only a candidate: the bytes of every hit are
compared with those found at the place that the state names, and rows that differ in spite of equal digests are grouped
again by their full text.

Texts count as equal when identical after each run of white space is replaced by one blank; null counts as empty.
Of equal texts the smallest id stays.  Repeated rows with the same id and text fall in one group; all of them have
``kept`` set if theirs is the smallest id.  A null id comes before all others.  An empty table gives no rows.  Other columns are ignored and dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import cut, drop, fresh_path, text_or_empty

#: Without preallocation a partition of the state takes the room of its rows, not some megabytes at least.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Digests of repeated texts that may be broadcast (about 250 bytes each).
BROADCAST_DIGESTS = 200_000


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def normalised(text: Column) -> Column:
    return F.regexp_replace(text_or_empty(text), r"[\x20\x09-\x0D]+", " ")


def place() -> Column:
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def digest_state(spark: SparkSession, path: str, id_col: str, text_col: str, digest: Callable[[Column], Column], home: str | None = None, files: int | None = None) -> DataFrame:
    """One row for each digest under ``path``: digest, keep (id, file, row) and group_size.

    ``home`` is the folder of the state, a new one by default; ``files`` bounds the files of a batch.
    """
    schema = spark.read.parquet(path).schema
    home = home or fresh_path(spark, "exact-dedup")
    rows = (
        spark.readStream.schema(schema).options(**({"maxFilesPerTrigger": files} if files else {}))
        .parquet(f"{path[:-1]}[{path[-1]}]")  # as a glob, the stream takes a folder and a single file alike
        .select(digest(normalised(F.col(text_col))).alias("digest"), F.struct(F.col(id_col).alias("id"), place().getField("file").alias("file"), place().getField("row").alias("row")).alias("at"))
    )
    seen = rows.groupBy("digest").agg(F.min("at").alias("keep"), F.count(F.lit(1)).alias("group_size"))
    empty = spark.createDataFrame([], seen.schema)
    empty.withColumn("batch", F.lit(0).cast("long")).write.mode("overwrite").parquet(f"{home}/state/batch=none")

    def sink(part: DataFrame, batch: int) -> None:
        part.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{home}/state/batch={batch}")

    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        seen.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{home}/log").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    updates = spark.read.schema(empty.schema.add("batch", "long")).parquet(f"{home}/state/batch=*")
    return updates.groupBy("digest").agg(F.max_by(F.struct("keep", "group_size"), "batch").alias("last")).select("digest", "last.keep", "last.group_size")


def exact_dedup(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, home: str | None = None, files: int | None = None) -> DataFrame:
    """Per row of the table at ``path``: id, keep_id, group_size, kept, text_sha256."""
    state = cut(digest_state(spark, path, id_col, text_col, digest, home, files).select("digest", F.col("keep.id").alias("keep_id"), F.struct("keep.file", "keep.row").alias("keep_at"), "group_size"), "exact-dedup-state")
    docs = spark.read.parquet(path).select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"), place().alias("at"))
    seen = docs.select("id", digest(F.col("norm")).alias("digest"), F.sha2("norm", 256).alias("text_sha256")).join(state.drop("keep_at"), "digest")
    shared = state.where("group_size > 1").select("digest", "keep_at")
    small = shared.count() <= BROADCAST_DIGESTS
    hits = cut(docs.withColumn("digest", digest(F.col("norm"))).join(F.broadcast(shared) if small else shared, "digest"), "exact-dedup-hits")
    # written first: a join that shares no shuffle with an aggregation can split the rows of one digest
    stays = cut(hits.where(F.col("at") == F.col("keep_at")).select("digest", F.col("norm").alias("keep_norm")), "exact-dedup-stays")
    other = cut(hits.join(stays, "digest").where(F.col("norm") != F.col("keep_norm")).select("digest", "id", "norm"), "exact-dedup-other")
    drop(hits, stays)
    if not other.isEmpty():  # equal digests of different texts
        own = other.groupBy("digest", "norm").agg(F.min("id").alias("own_keep"), F.count(F.lit(1)).alias("own_size")).select("digest", F.sha2("norm", 256).alias("text_sha256"), "own_keep", "own_size")
        rest = own.groupBy("digest").agg(F.sum("own_size").alias("others"))
        seen = (
            seen.join(own, ["digest", "text_sha256"], "left").join(rest, "digest", "left")
            .withColumn("keep_id", F.when(F.col("own_size").isNull(), F.col("keep_id")).otherwise(F.col("own_keep")))
            .withColumn("group_size", F.coalesce("own_size", F.col("group_size") - F.coalesce("others", F.lit(0))))
        )
    return seen.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


ORACLE = """
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm
"""
