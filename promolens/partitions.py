"""How rows are dealt over tasks where Spark cannot tell how much they grow."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows by key over a given number of tasks, which Spark does not merge.

    Small shuffled partitions are merged by their compressed size; rows that are exploded, sorted
    and hashed behind the shuffle take many times that in one task.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)
