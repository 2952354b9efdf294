"""Watching for changes, and the state of jobs, on batch or streaming frames."""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.sources.merge import MergeTable, NumberedLog
from lumenlake.sources.scan import EXTENSIONS, scan


def debounced(events: DataFrame, by: list[str], ts: str, path: str, quiet: str, late: str | None = None) -> DataFrame:
    """Bursts of events that end after a quiet time: first and last time, events, distinct paths.

    On a stream ``late`` sets the watermark by which a burst is closed.
    """
    if late is not None:
        events = events.withWatermark(ts, late)
    return events.groupBy(*by, F.session_window(ts, quiet).alias("burst")).agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("events"), F.sort_array(F.collect_set(path)).alias("paths")
    )


def snapshot_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """(uri, change) between two listings (uri, size_bytes, modified_at): added, changed or removed.

    A file stream sees new paths only, so in-place changes and deletions come from listings.
    """
    a = before.select("uri", F.struct("size_bytes", "modified_at").alias("a"))
    b = now.select("uri", F.struct("size_bytes", "modified_at").alias("b"))
    change = (
        F.when(F.col("a").isNull(), "added")
        .when(F.col("b").isNull(), "removed")
        .when((F.col("a.size_bytes") != F.col("b.size_bytes")) | (F.abs(F.col("a.modified_at") - F.col("b.modified_at")) > 0.001), "changed")
    )
    return a.join(b, "uri", "full").withColumn("change", change).where("change IS NOT NULL").select("uri", "change")


def root_changes(wanted: DataFrame, watched: DataFrame) -> DataFrame:
    """(root, action): roots to watch and to let go."""
    add = wanted.select("root").subtract(watched.select("root")).withColumn("action", F.lit("watch"))
    return add.unionByName(watched.select("root").subtract(wanted.select("root")).withColumn("action", F.lit("unwatch")))


#: Kinds of file events after which an index may be out of date, and those of them that folders have too.
CHANGES = ("any", "create", "create_file", "create_folder", "remove", "remove_file", "remove_folder", "modify", "modify_data", "rename", "metadata", "write_time", "close_write")
FOLDER_CHANGES = ("create", "create_folder", "remove", "remove_folder", "rename")


def relevant(events: DataFrame, extensions: Iterable[str] | None = None) -> DataFrame:
    """Events (kind, path) that may change the index: of indexed files, or of names without an extension that may be folders.

    An event without a path counts by its kind alone.
    """
    wanted = list(extensions or (e for es in EXTENSIONS.values() for e in es))
    extension = F.lower(F.regexp_extract("path", r"[^/](\.[^./]+)$", 1))
    folder = F.col("kind").isin(*FOLDER_CHANGES) & (extension == "")
    return events.where(F.col("kind").isin(*CHANGES) & (F.col("path").isNull() | extension.isin(*wanted) | folder))


def watch_new_files(spark: SparkSession, path: str, checkpoint: str, handle: Callable[[DataFrame, int], None]):
    """Run ``handle`` on each batch of files that arrived below a path; the checkpoint resumes it."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(path).drop("content")
    return files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class ListingWatch:
    """Changes of a source between listings, each handled once: new, changed in place and removed files.

    A batch's listing is written below ``path`` under its number before anything is handled, and is read again if
    the batch is run again, so a restart sees the same changes; a file that changes meanwhile is in the next.
    """

    def __init__(self, spark: SparkSession, spec: str, path: str, handle: Callable[[DataFrame, int], None]):
        self.spark, self.spec, self.path, self.handle = spark, spec, path, handle
        self.log = NumberedLog(spark, posixpath.join(path, "_log"))

    def _listing(self, number: int) -> DataFrame:
        return self.spark.read.parquet(posixpath.join(self.path, self.log.read(number)))

    def tick(self, batch: int) -> None:
        """Compare the source with the listing of the batch before; batches are numbered from 0."""
        number, before = batch + 1, [n for n in self.log.numbers() if n < batch + 1]
        if number not in self.log.numbers():
            name = f"listing-{number:012d}"
            rows = scan(self.spark, self.spec).select(F.col("item_uri").alias("uri"), "size_bytes", "modified_at")
            rows.write.mode("overwrite").parquet(posixpath.join(self.path, name))
            self.log.commit(number, name)
        now = self._listing(number)
        old = self._listing(before[-1]) if before else now.limit(0)
        self.handle(snapshot_changes(old, now), batch)
        for n in before[:-1]:  # the one before this may be asked for again
            path, fs = self.log._hadoop("..", self.log.read(n))
            fs.delete(path, True)
            self.log.remove(n)

    def run(self, checkpoint: str, every: str = "5 seconds"):
        """Tick for as long as the query runs; its checkpoint numbers the batches."""
        ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return ticks.writeStream.foreachBatch(lambda _, batch: self.tick(batch)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


class PendingChanges:
    """Changed paths that wait until their root has been quiet for a while and no job of it runs.

    Two tables: paths with the time of their last event, and roots with the time from which quiet is counted.  A root
    that is due while its job runs is put off and counts from then; so does one whose job could not be started, and it
    keeps its paths.  A job that is done takes away the events that it was given, not those that came meanwhile.
    """

    UNKNOWN = "<unknown>"

    def __init__(self, spark: SparkSession, path: str, quiet: float, buckets: int = 4):
        self.quiet = quiet
        self.paths = MergeTable(spark, posixpath.join(path, "paths"), "key", "key string, root string, path string, at double", buckets)
        self.roots = MergeTable(spark, posixpath.join(path, "roots"), "root", "root string, since double", buckets)

    def add(self, events: DataFrame) -> None:
        """Events (root, path, at in seconds); an event without a path changes something unknown."""
        path = F.coalesce("path", F.lit(self.UNKNOWN))
        rows = events.groupBy("root", path.alias("path")).agg(F.max("at").alias("at"))
        self.paths.upsert(rows.select(F.concat_ws("\n", "root", "path").alias("key"), "root", "path", "at"))
        known = self.roots.read().withColumnRenamed("since", "at")
        self.roots.upsert(events.select("root", "at").unionByName(known).groupBy("root").agg(F.max("at").alias("since")).join(events.select("root").distinct(), "root", "left_semi"))

    def due(self, now: float, busy: DataFrame | None = None) -> DataFrame:
        """(root, path, at) to be worked on; roots of ``busy`` (root) that are due are put off."""
        quiet = self.roots.read().where(F.lit(now) - F.col("since") >= self.quiet).select("root")
        if busy is not None:
            late = quiet.join(busy.select("root").distinct(), "root", "left_semi")
            quiet = quiet.join(busy.select("root").distinct(), "root", "left_anti")
            self.put_off(late, now)
        return self.paths.read().join(quiet, "root", "left_semi").select("root", "path", "at")

    def put_off(self, roots: DataFrame, now: float) -> None:
        """Roots (root) whose job runs, or could not be started, are quiet from now."""
        self.roots.set_fields(roots.select("root", F.lit(float(now)).alias("since")))

    def done(self, given: DataFrame) -> None:
        """Take away what `due` gave; a path with a later event stays."""
        keys = given.select(F.concat_ws("\n", "root", "path").alias("key"), F.col("at").alias("_given"))
        same = self.paths.read().join(keys, "key").where(F.col("at") <= F.col("_given")).select("key")
        self.paths.delete(same)
        self.paths.compact()
        self.roots.compact()


TERMINAL = ("succeeded", "failed", "cancelled")


def latest_states(events: DataFrame) -> DataFrame:
    """(job_id, status, sequence, active): the last status of each job by sequence."""
    last = events.groupBy("job_id").agg(F.max_by("status", "sequence").alias("status"), F.max("sequence").alias("sequence"))
    return last.withColumn("active", ~F.col("status").isin(*TERMINAL))


def progress(events: DataFrame) -> DataFrame:
    """(job_id, done, total, ratio) from events with done and total parts."""
    sums = events.groupBy("job_id").agg(F.sum("done").alias("done"), F.sum("total").alias("total"))
    return sums.withColumn("ratio", F.when(F.col("total") > 0, F.least(F.lit(1.0), F.col("done") / F.col("total"))).otherwise(F.lit(0.0)))
