"""The ledger of an indexing run: what is pending, which points are committed, what to resume.

The ledger is a merge-on-read table with a row per item, changed by tables of items: a run registers all
its pending items at once, commits the points of a batch of parts at once, and closes items at
once.  Each change writes the rows that it changes; what has grown is compacted when a run registers.  A run that dies leaves items ``running`` with the points that were committed; `planned` then
has those items pending again, and their committed points name what need not be computed twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.sources.merge import MergeTable

SCHEMA = (
    "uri string, source string, size_bytes bigint, modified_at double, profile string, status string, "
    "point_ids array<string>, error string, updated_at timestamp"
)
STATUSES = ("running", "completed", "failed", "cancelled")


class IndexLedger:
    def __init__(self, spark: SparkSession, path: str):
        self.table = MergeTable(spark, path, "uri", SCHEMA)

    def load(self) -> tuple[DataFrame, str | None]:
        """The entries, and why there are none if the ledger can't be read: it is empty then until the next write."""
        try:
            entries = self.table.read()
            entries.limit(1).collect()
            return entries, None
        except Exception as e:  # an unreadable ledger costs a new analysis, not the run
            return self.table.read_version(0), str(e).splitlines()[0]

    def register(self, pending: DataFrame) -> None:
        """Pending items (uri, source, size_bytes, modified_at, profile) that have no entry get one, running."""
        self.table.compact()
        self.table.insert_missing(_fresh(pending))

    def start(self, items: DataFrame) -> None:
        """Items are begun anew, whatever their entries were: running, without points."""
        self.table.upsert(_fresh(items))

    def commit(self, points: DataFrame) -> None:
        """Points (uri, point_id) of finished parts are added to their items, each once."""
        new = points.groupBy("uri").agg(F.sort_array(F.collect_set("point_id")).alias("_points"))  # an item has few points
        version = self.table.version()
        old = self.table.read_version(version).select("uri", F.col("point_ids").alias("_old"))
        known = F.coalesce("_old", F.array().cast("array<string>"))
        ids = F.concat(known, F.array_except("_points", known))
        grown = old.join(new, "uri").select("uri", ids.alias("point_ids"), F.current_timestamp().alias("updated_at"))
        self.table.set_fields(grown, expect=version)

    def complete(self, produced: DataFrame) -> None:
        """Items (uri, point_ids) are done: exactly these points are theirs."""
        self._close(produced.select("uri", "point_ids"), "completed", F.lit(None).cast("string"))

    def fail(self, errors: DataFrame) -> None:
        """Items (uri, error) have failed."""
        self._close(errors.select("uri", F.col("error").alias("_error")), "failed", F.col("_error"))

    def cancel(self, items: DataFrame) -> None:
        """Items (uri) that are running are cancelled."""
        version = self.table.version()
        running = self.table.read_version(version).where("status = 'running'").select("uri")
        self._close(items.select("uri").join(running, "uri", "left_semi"), "cancelled", F.lit("cancelled"), version)

    def _close(self, rows: DataFrame, status: str, error: Column, expect: int | None = None) -> None:
        changed = rows.withColumns({"status": F.lit(status), "error": error, "updated_at": F.current_timestamp()})
        self.table.set_fields(changed.drop("_error"), expect=expect)

    def unfinished(self) -> DataFrame:
        """Entries that a resumed run takes up again, with the points that are committed."""
        return self.load()[0].where("status <> 'completed'")


def _fresh(items: DataFrame) -> DataFrame:
    return items.select(
        "uri", "source", "size_bytes", "modified_at", "profile", F.lit("running").alias("status"),
        F.array().cast("array<string>").alias("point_ids"), F.lit(None).cast("string").alias("error"), F.current_timestamp().alias("updated_at"),
    )
