"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``.

    Where the session names no such folder, a master of one machine uses the warehouse instead;
    on a cluster that could be a folder which only the driver sees, so it is an error there.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        master = spark.conf.get("spark.master", "local")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = posixpath.join(spark.conf.get("spark.sql.warehouse.dir"), "_scratch")
    return posixpath.join(shared, f"{name}-{uuid.uuid4().hex}")


def materialised(df: DataFrame, name: str) -> DataFrame:
    """The frame written to a scratch table and read again, which cuts its lineage."""
    return materialised_at(df, name)[0]


def materialised_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As `materialised`, with the table's path, by which `discard` removes it."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a scratch table from which nothing is read any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
