"""Dense numbering of keys within groups, for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def rank_within(df: DataFrame, group: list[str], order: list[str], out: str = "n") -> DataFrame:
    """1-based position of each row in its group.

    Rows are range-partitioned by (group, order); a row's position is the number of its
    group's rows in earlier partitions plus its position in its own.  Only one count per
    group and partition is exchanged, so a group may fill many partitions.
    """
    ranged = materialize(df.repartitionByRange(*group, *order).withColumn("__part", F.spark_partition_id()), "ranged")
    local = ranged.withColumn("__at", F.row_number().over(Window.partitionBy(*group, "__part").orderBy(*order)))
    sizes = ranged.groupBy(*group, "__part").count()
    ahead = sizes.withColumn("__ahead", F.coalesce(F.sum("count").over(Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    return local.join(ahead, [*group, "__part"]).withColumn(out, (F.col("__at") + F.col("__ahead")).cast("bigint")).drop("__at", "__ahead", "__part")
