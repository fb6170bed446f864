"""Hand-offs through the shared folder."""

from pyspark.sql import functions as F

from tickloom.settings import materialize


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if "shuffle_" in f}


def test_a_stored_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    counted = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    stored = materialize(counted)
    assert sorted(map(tuple, stored.collect())) == sorted((k, 1000 // 7 + (k < 1000 % 7)) for k in range(7))
    assert not shuffle_files(spark) - before
    assert counted.agg(F.sum("count")).first()[0] == 1000
