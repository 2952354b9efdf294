"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.plans.scratch import materialised as written
from lumenlake.plans.scratch import scratch_dir

__all__ = ["ascii_lower", "digest_of", "joined_hot", "scratch_dir", "sized_partitions", "table", "written"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column):
    """A-Z to a-z and nothing else, unlike ``lower`` which folds all of Unicode."""
    return F.translate(column, UPPER, LOWER)


def joined_hot(rows: DataFrame, lookup: DataFrame, on: list[str], how: str = "left", most: int = 1_000) -> DataFrame:
    """``rows`` joined to ``lookup`` (one row per key), where a key may hold a large part of the rows.

    Keys with more than 1/``most`` of the rows number fewer than ``most``: their lookup rows are
    broadcast and their rows stay where they are.  The other keys are joined by a shuffle.  The rows
    are read several times, so they should be a table or cheap to make.  Null keys match nothing.
    """
    total = rows.count()
    heavy = rows.groupBy(*on).agg(F.count("*").alias("_rows")).where((F.col("_rows") * most > total) & (F.col("_rows") > most))
    heavy = F.broadcast(written(heavy.select(*on), "hot"))  # fewer than ``most`` keys
    hot = F.broadcast(lookup.join(heavy, on, "left_semi"))
    few = rows.join(heavy, on, "left_anti").join(lookup, on, how)
    return few.unionByName(rows.join(heavy, on, "left_semi").join(hot, on, how))


def sized_partitions(rows: int, per_partition: int, least: int = 1) -> int:
    return max(least, -(-rows // per_partition))


def digest_of(*parts: bytes) -> str:
    h = hashlib.sha256()
    for p in parts:
        h.update(len(p).to_bytes(8, "little"))
        h.update(p)
    return h.hexdigest()
