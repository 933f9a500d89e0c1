"""Cutting the lineage of iterative jobs in storage that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> str:
    """The shared checkpoint folder; a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if folder and not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    elif not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
    return (folder or context.getCheckpointDir()).rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{prepare(spark)}/{name}-{uuid.uuid4().hex}"


#: An estimate of a table's bytes beyond this is no size; Spark takes as much for a table of unknown size.
MOST_BYTES = 2**63 - 1


def materialise(df: DataFrame) -> DataFrame:
    """``df`` computed once into the checkpoint folder."""
    prepare(df.sparkSession)
    return _plain_size(df.checkpoint())


def _plain_size(df: DataFrame) -> DataFrame:
    """A checkpoint keeps its plan's estimate of bytes, joins multiply them, and a loop that joins a table to one that comes
    from it squares them each round: after some thirty rounds that number alone fills the driver.  It is dropped here."""
    plan = df._jdf.queryExecution().analyzed()
    if int(plan.stats().sizeInBytes()) <= MOST_BYTES:
        return df
    jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
    none = getattr(getattr(jvm.scala, "None$"), "MODULE$")
    plan = jvm.org.apache.spark.sql.execution.LogicalRDD(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(), session, none, none)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, plan), df.sparkSession)
