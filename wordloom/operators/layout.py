"""Physical layout helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread_by(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition a small, under-partitioned input by ``key``.

    A scan of one row group or a few small files would run every per-row regex
    in a handful of tasks.  Such an input is spread by ``key`` (deterministic on
    retry, and a later ``groupBy(key)`` reuses the partitioning without another
    exchange).  The decision reads the plan and runs nothing: an input is left
    alone if its plan states two partitions a core or more, or if the files it
    reads would fill as many splits, so no full shuffle is added at scale.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    query = df._jdf.queryExecution()
    if query.executedPlan().outputPartitioning().numPartitions() >= 2 * cores:
        return df
    split_bytes = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    leaves = query.optimizedPlan().collectLeaves()
    read = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if read >= 2 * cores * split_bytes:
        return df
    return df.repartition(max(cores, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)
