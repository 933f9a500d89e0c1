"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that the contracts of this subpackage name: blank, tab, LF, VT, FF, CR.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session may lack the setting; it gets a temporary folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = spark.sparkContext.getCheckpointDir()
        if not own:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
            own = spark.sparkContext.getCheckpointDir()
        found = own
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove tables that ``cut`` wrote and that nothing will read again."""
    for t in tables:
        drop_path(t.sparkSession, t._written)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared file system that is read no more."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Bytes of one Arrow batch between the JVM and Python; long texts would else make batches of 64 MB.
BATCH_BYTES, BATCH_SETTING = "8m", "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's bound on Arrow batches, unless it was set before."""
    if spark.conf.get(BATCH_SETTING, None) in (None, "67108864b", "64MB"):
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def text_groups(batch: pa.RecordBatch, at: int, most: int = 1 << 20, rows: int = 512) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Parts of a batch with the texts of its column ``at``: at most ``rows`` rows and ``most`` bytes, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    s = 0
    while s < batch.num_rows:
        before = ends[s - 1] if s else 0
        e = min(s + rows, max(s + 1, int(np.searchsorted(ends, before + most, "right"))))
        part = batch.slice(s, e - s)
        yield part, part.column(at).to_pylist()
        s = e


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))
