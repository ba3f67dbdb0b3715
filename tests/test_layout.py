"""spread_by: under-partitioned inputs are hash-spread; large inputs are left alone."""

from wordloom.operators.layout import spread_by


def _has_exchange(df):
    return "Exchange" in df._jdf.queryExecution().executedPlan().toString()


def test_small_input_is_spread_by_key(spark):
    df = spark.range(0, 1000, numPartitions=1).withColumnRenamed("id", "row_id")
    out = spread_by(df, "row_id")
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(r.row_id for r in out.collect()) == list(range(1000))


def test_large_input_is_untouched(spark):
    n = spark.sparkContext.defaultParallelism * 2
    df = spark.range(0, 1000, numPartitions=n).withColumnRenamed("id", "row_id")
    out = spread_by(df, "row_id")
    assert out is df and not _has_exchange(out)


def test_single_row_group_file_with_empty_splits_is_spread(spark):
    from pyspark.sql import functions as F

    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")  # one row group, one file
    busy = df.groupBy(F.spark_partition_id()).count().count()
    assert busy == 1  # however many splits Spark cuts, one task holds every row
    out = spread_by(df.withColumnRenamed("doc_id", "row_id"), "row_id")
    assert out.groupBy(F.spark_partition_id()).count().count() > 1
