"""Gapless numbering of large groups without bringing a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.llm.common import sized_partitions, written

CHUNK_ROWS = 5_000
HOT_KEYS = 1_000


def hash_order(key: Column) -> Column:
    """An MD5 of the key as text: the order of a shuffle that every run repeats."""
    return F.md5(F.coalesce(key.cast("string"), F.lit("")))


def numbered(
    df: DataFrame, group: str, key: Column, ties: list[str], name: str, row_count: int | None = None
) -> DataFrame:
    """``df`` with a column ``name``: 0, 1, 2 ... within each group, in the order of ``hash_order(key)``.

    A group is cut into chunks by leading bits of the hash, so that a group of any size is
    spread over many tasks; chunk counts are summed up to offsets and rows are numbered
    within chunks.  Chunks follow the hash order, so their number doesn't show in the result.
    A group's chunk counts, rows / CHUNK_ROWS of them at most, are summed up in one task.
    Rows equal in key and ``ties`` are numbered in no stated order.

    A key that more than 1/HOT_KEYS of the rows have (null ids, say) would be in one chunk: the rows of such
    keys come after all others of their group, in chunks by a hash of key, ties and a number of their own.
    """
    rows = df.count() if row_count is None else row_count
    chunks = sized_partitions(rows, CHUNK_ROWS)
    hashed = df.withColumn("_hash", hash_order(key))
    common = hashed.groupBy("_hash").agg(F.count("*").alias("n")).where(F.col("n") > max(CHUNK_ROWS, rows // HOT_KEYS))
    hot = [r["_hash"] for r in common.collect()] if chunks > 1 else []  # fewer than HOT_KEYS
    bits = F.conv(F.substring("_hash", 1, 8), 16, 10).cast("long")
    hashed, dealt = hashed.withColumns({"_spread": F.lit(0).cast("long"), "_late": F.lit(0)}), F.xxhash64("_hash", *ties, "_spread")
    if hot:
        often = hashed.where(F.col("_hash").isin(hot)).withColumns({"_spread": F.monotonically_increasing_id(), "_late": F.lit(1)})
        hashed = hashed.where(~F.col("_hash").isin(hot)).unionByName(written(often, "often"))  # writing fixes the numbers
    at = F.when(F.col("_late") == 1, F.shiftrightunsigned(dealt, 32)).otherwise(bits)
    hashed = hashed.withColumn("_chunk", (F.shiftright(at * F.lit(chunks), 32) + F.col("_late") * chunks).cast("int"))
    counts = hashed.groupBy(group, "_chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col(group).alias("_group"),
        F.col("_chunk").alias("_at"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
    )
    inside = Window.partitionBy(group, "_chunk").orderBy("_hash", *ties, "_spread")
    joined = hashed.join(offsets, hashed[group].eqNullSafe(offsets["_group"]) & (hashed["_chunk"] == offsets["_at"]))
    return joined.withColumn(name, (F.col("_offset") + F.row_number().over(inside) - 1).cast("long")).drop(
        "_hash", "_chunk", "_group", "_at", "_offset", "_spread", "_late"
    )
