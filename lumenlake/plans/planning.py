"""Incremental index planning: what to index, what is current, what to prune."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lumenlake.operators.filters import same_size_time_profile


def records_per_source(indexed: DataFrame) -> DataFrame:
    """(uri, records): the stored points of each source item; a source has few points."""
    point = F.struct("point_id", "size_bytes", "modified_at", "profile", "complete")
    return indexed.groupBy("uri").agg(F.collect_list(point).alias("records"))


def planned(scan: DataFrame, indexed: DataFrame, ledger: DataFrame) -> DataFrame:
    """Each scanned item with status ``pending`` or ``current``.

    ``scan`` is (uri, size_bytes, modified_at, profile), ``indexed`` is (uri, point_id, size_bytes,
    modified_at, profile, complete), ``ledger`` is (uri, size_bytes, modified_at, profile, status,
    point_ids).  A matching ledger entry decides: it must be completed and all its points present
    and current.  Without one, any current record will do.
    """
    entry = ledger.select(
        F.col("uri"), F.struct("size_bytes", "modified_at", "profile", "status", "point_ids").alias("entry")
    )
    joined = scan.join(records_per_source(indexed), "uri", "left").join(entry, "uri", "left")
    here = (F.col("size_bytes"), F.col("modified_at"), F.col("profile"))

    def same(x):
        return same_size_time_profile(x["size_bytes"], here[0], x["modified_at"], here[1], x["profile"], here[2])

    records = F.coalesce("records", F.expr("cast(array() as array<struct<point_id:string,size_bytes:bigint,modified_at:double,profile:string,complete:boolean>>)"))
    current = F.filter(records, lambda r: same(r) & F.coalesce(r["complete"], F.lit(False)))
    ids = F.transform(current, lambda r: r["point_id"])
    known = F.col("entry").isNotNull() & same(F.col("entry"))
    committed = F.coalesce(
        (F.col("entry.status") == "completed")
        & (F.size("entry.point_ids") > 0)
        & F.forall("entry.point_ids", lambda p: F.array_contains(ids, p)),
        F.lit(False),
    )
    is_current = F.when(known, committed).otherwise(F.size(current) > 0)
    return joined.select("uri", "size_bytes", "modified_at", "profile", F.when(is_current, "current").otherwise("pending").alias("status"))


def to_prune(indexed: DataFrame, scan: DataFrame, scanned_sources: DataFrame | None = None) -> DataFrame:
    """Distinct indexed (uri, point_id) whose item is gone.

    With ``scanned_sources`` (source) only items of sources that were scanned can go, so that an
    unreachable source loses nothing.
    """
    if scanned_sources is not None:
        indexed = indexed.join(scanned_sources.select("source").distinct(), "source", "left_semi")
    return indexed.join(scan.select("uri").distinct(), "uri", "left_anti").select("uri", "point_id").distinct()


def stale_points(before: DataFrame, produced: DataFrame) -> DataFrame:
    """Points that their source had and has not produced again (uri, point_id)."""
    return before.join(produced.select("uri", "point_id"), ["uri", "point_id"], "left_anti").join(
        produced.select("uri").distinct(), "uri", "left_semi"
    )


def totals(outcomes: DataFrame) -> DataFrame:
    """One row of counts by status of (uri, status)."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    return outcomes.agg(F.count("*").alias("total"), *map(of, ("indexed", "already_indexed", "skipped", "failed")))


OUTCOMES = ("indexed", "already_indexed", "skipped", "failed")


def with_totals(outcomes: DataFrame, write: Callable[[DataFrame], None]) -> DataFrame:
    """One row of counts by status of (uri, status), as `totals`, taken while ``write`` writes the outcomes: no second pass.

    ``write`` must read all rows once.  Spark counts a retried task's rows once.
    """
    seen = Observation("outcomes")
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    write(outcomes.observe(seen, F.count(F.lit(1)).alias("total"), *map(of, OUTCOMES)))
    row = seen.get
    names = ("total", *OUTCOMES)
    return outcomes.sparkSession.createDataFrame([tuple(row[n] for n in names)], ", ".join(f"{n} long" for n in names))
