"""Registries that live between batches: voices or people that new items are recognised by, or found.

State is two merge-on-read tables, founders and assignments, each row with the number of the batch that made
it.  A batch sees the founders of earlier batches only, and founders, numbers and assignments follow from
them and the batch alone, so a batch that is run again after a crash writes the same rows over its own.
The stream's checkpoint says which batch is next, the tables hold the state: nothing is kept in a process, and a
registry grows beyond the memory of any task.
"""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.operators.founding import KNOWN_AT, FoundingParams, founded
from lumenlake.operators.order import numbered
from lumenlake.plans.scratch import materialised
from lumenlake.sources.merge import MergeTable


class FounderRegistry:
    """Founders and assignments below a path, by group; ``least`` is the cosine from which an item is a founder's.

    Items are (group, item, vector), with ids as strings; within a batch they arrive in the order of their ids, and
    batches in theirs.  An item that comes again is assigned anew by what there is in its latest batch; an item
    without a usable vector is assigned no number.
    """

    def __init__(self, spark: SparkSession, path: str, least: float, params: FoundingParams = FoundingParams(), buckets: int = 16):
        self.least, self.params = least, params
        head = "key string, grp string, number long, batch long"
        self.founders = MergeTable(spark, posixpath.join(path, "founders"), "key", f"{head}, item string, vector array<double>", buckets)
        self.assigned = MergeTable(spark, posixpath.join(path, "assigned"), "key", f"{head}, item string, score double", buckets)

    def handle(self, items: DataFrame, batch: int) -> None:
        """One batch, for ``foreachBatch``; may be run again with the same items.

        Of several vectors of an item in a batch the one of the greatest hash counts.
        """
        rows = items.select(F.col("group").cast("string").alias("grp"), F.col("item").cast("string").alias("item"), F.col("vector").cast("array<double>").alias("vector"))
        rows = materialised(rows.groupBy("grp", "item").agg(F.max_by("vector", F.xxhash64("vector")).alias("vector")), "batch")
        before = self.founders.read().where(F.col("batch") < batch)
        known = before.join(rows, before["grp"].eqNullSafe(rows["grp"]), "left_semi").select("grp", "number", "item", "vector")
        known = materialised(known, "known")
        found = materialised(founded(rows, "grp", "item", "vector", self.least, self.params, known=known), "found")
        # numbers go on from the highest of a group
        new = numbered(found.where("founds").select("grp", "item", "width", "at"), ["grp"], [F.col("item")], "place")
        used = known.groupBy(F.col("grp").alias("_g")).agg((F.max("number") + 1).alias("used"))
        number = (F.col("place") + F.coalesce("used", F.lit(0))).alias("number")
        new = materialised(new.join(used, F.col("grp").eqNullSafe(F.col("_g")), "left").select("grp", "item", "width", "at", number), "new")
        group, made = F.coalesce("grp", F.lit("-")), F.lit(batch).cast("long").alias("batch")
        own = rows.select(F.col("grp").alias("_g"), F.col("item").alias("_i"), "vector")
        with_vector = new.join(own, F.col("grp").eqNullSafe(F.col("_g")) & F.col("item").eqNullSafe(F.col("_i")))
        self.founders.upsert(with_vector.select(F.concat_ws("/", "number", group).alias("key"), "grp", "number", made, "item", "vector"))
        of_new = new.select(F.col("grp").alias("_g"), F.col("width").alias("_w"), F.col("at").alias("_at"), F.col("number").alias("_new"))
        same = F.col("grp").eqNullSafe(F.col("_g")) & (F.col("width") == F.col("_w")) & (F.col("founder_at") == F.col("_at"))
        number = F.when(F.col("founder_at") < 0, F.col("founder_at") - KNOWN_AT).otherwise(F.col("_new")).alias("number")
        key = F.concat_ws("/", F.coalesce("item", F.lit("-")), group).alias("key")
        self.assigned.upsert(found.join(of_new, same, "left").select(key, "grp", number, made, "item", "score"))
        self.founders.compact()
        self.assigned.compact()

    def run(self, stream: DataFrame, checkpoint: str):
        """Handle what a stream of items has, and stop; run again for what has come since."""
        return stream.writeStream.foreachBatch(self.handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
