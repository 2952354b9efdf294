"""Positions in an order without bringing a group into one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.plans.scratch import materialised


def all_equal(a: DataFrame, b: DataFrame, on: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in on])


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` with a column ``name``: 0, 1, 2 ... in the order within equal ``by``; nulls first.

    One range shuffle by the keys sorts the rows over all tasks; rows are numbered within partitions and
    the counts of the partitions before are added, which are as many rows as partitions and keys.  Rows that
    are equal in all order columns are in one partition, so end the order with an id.
    """
    keys = [F.col(f"`{c}`") for c in by]
    ranged = df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    ranged = materialised(ranged, "ordered")  # fixes which row is in which partition
    counts = ranged.groupBy("_part", *keys).agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    inside = F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order))
    placed = ranged.withColumn("_n", inside)
    joined = placed.join(offsets, all_equal(placed, offsets, ["_part", *by]))  # small: a row per partition and key
    return joined.select(*[placed[f"`{c}`"] for c in df.columns], (F.col("_before") + F.col("_n") - 1).cast("long").alias(name))
