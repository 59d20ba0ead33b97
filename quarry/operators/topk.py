"""The first rows of each group without ranking a group in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tree_top(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str) -> DataFrame:
    """The first ``k`` rows of each group by ``order``, numbered from 1 in column
    ``rank``. ``order`` should tell all rows apart; ties are broken at will.

    Two levels: groups are cut into about as many subgroups as the root of the number
    of shuffle partitions, by the task that a row comes from. Spark's own limit of a
    ranked window keeps k rows per group in each task before the shuffle, a subgroup
    ranks those of its tasks, and the last level ranks k rows per subgroup: with t
    tasks no task sorts more than about k x sqrt(t) rows of one group."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    subgroups = math.isqrt(max(parts - 1, 0)) + 1
    for keys in ([*group, "__sub"], group):
        if "__sub" in keys:
            df = df.withColumn("__sub", F.pmod(F.spark_partition_id(), F.lit(subgroups)))
        window = Window.partitionBy(*keys).orderBy(*order)
        df = df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)
    return df.drop("__sub")
