"""Exact ranks without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def running_total(df: DataFrame, order: list[str], weight: str, out: str, group: list[str] | None = None) -> DataFrame:
    """``df`` with ``out``: the sum of ``weight`` over the rows before this one, by ``order``, among rows
    of the same ``group`` (all rows by default).

    The rows are range-partitioned by group and order, so a large group spans many partitions; a
    row's total is its own partition's running sum plus the totals of the group's earlier partitions.
    Those come from one row per (partition, group). The ranged rows are materialised, which fixes
    the partition numbers."""
    group = group or []
    ranged = materialize(df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy("_part", *group).agg(F.sum(weight).alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", *group, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("_before") + F.coalesce(F.sum(weight).over(inside), F.lit(0))
    return ranged.join(offsets, ["_part", *group]).withColumn(out, total).drop("_part", "_before")
