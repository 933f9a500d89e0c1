"""Updates whose keys other rows have too."""

from pyspark.sql import functions as F

from graphloom import catalog

SF = "/root/testdata/sf0.001"


def with_copies(tmp_path, spark, **changes):
    """The smallest tables, some of them changed by ``changes`` (table to function)."""
    for table in "region nation customer supplier part orders lineitem events conversations".split():
        path = f"{SF}/{table}.parquet"
        df = spark.read.parquet(path)
        (changes[table](df) if table in changes else df).write.parquet(str(tmp_path / f"{table}.parquet"))
    return str(tmp_path)


def test_only_the_created_node_is_removed(spark, tmp_path):
    """A part of the created node's key, with relationships."""
    key = lambda c: lambda df: df.withColumn(c, F.when(F.col(c) == 1, 999999).otherwise(F.col(c)).cast(df.schema[c].dataType))
    d = with_copies(tmp_path, spark, part=key("p_partkey"), lineitem=key("l_partkey"))
    assert spark.read.parquet(f"{d}/lineitem.parquet").where("l_partkey = 999999").count() > 0
    assert [r.n for r in catalog.queries()["remove_node"](spark, d).collect()] == [spark.read.parquet(f"{d}/part.parquet").count()]


def test_the_created_node_is_read_by_its_id(spark, tmp_path):
    """A customer of the created node's key is not in the result."""
    d = with_copies(tmp_path, spark, customer=lambda df: df.withColumn("c_custkey", F.when(F.col("c_custkey") == 7, 12345).otherwise(F.col("c_custkey")).cast(df.schema["c_custkey"].dataType)))
    got = sorted((r.key, r.name) for r in catalog.queries()["create_node"](spark, d).collect())
    want = sorted((r.c_custkey, r.c_name) for r in spark.read.parquet(f"{d}/customer.parquet").where("c_custkey < 5").collect())
    assert got == [*want, (12345, "Rocky")]
