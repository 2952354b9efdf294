"""Interval joins by a sorted sweep.

Spans of a key are cut at all their ends into pieces, each with the spans that cover it.  Points and pieces
are then sorted together, and a point takes the piece before it: a running last value, no product of points
and spans.  The sort is one range shuffle by key and position, so a key of any size is over many tasks; what is
open at the end of a partition is carried into the next by a scan over a row per partition and key.

What is shuffled is points + pieces.  A piece holds the spans that overlap there, so a row grows with the depth of
overlap, and spans within many others are in as many pieces.  Spans that don't end after they start cover
nothing; null keys and positions meet nothing.

Keys of few points and few spans need no order over all tasks: `covered` joins those by the key, which shuffles each
row once, and sweeps the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.operators.order import all_equal, numbered
from lumenlake.plans.scratch import materialised

POINTS, SPANS = 100_000, 64  # of a key, up to which its points meet its spans directly


def carried_last(df: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the last value that isn't null at or before each row in the order within equal ``by``."""
    ranged = materialised(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ordered")
    inside = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = F.when(F.col(value).isNotNull(), F.struct(*order))
    ends = ranged.groupBy("_part", *by).agg(F.max_by(value, at).alias("_end"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    local = ranged.withColumn("_local", F.last(value, ignorenulls=True).over(inside))
    joined = local.join(carried, all_equal(local, carried, ["_part", *by]))
    return joined.select(*[local[f"`{c}`"] for c in df.columns], F.coalesce("_local", "_carried").alias(name))


def pieces(spans: DataFrame, key: str, start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """((key, piece, at) of each piece, (key, piece, first, span) of each span in each piece it covers).

    ``piece`` counts from 0 in a key; ``first`` is the span's first piece; ``span`` is the span's row.
    """
    sound = spans.where(F.col(key).isNotNull() & (F.col(start) < F.col(end)))
    rows = sound.select(F.col(key).alias("key"), F.col(start).alias("from"), F.col(end).alias("to"), F.struct(*(F.col(f"`{c}`") for c in spans.columns)).alias("span"))
    rows = materialised(rows, "spans")
    ends = rows.select("key", F.col("from").alias("at")).union(rows.select("key", "to")).distinct()
    cut = materialised(numbered(ends, ["key"], [F.col("at")], "piece"), "pieces")
    of = lambda column, name: cut.select("key", F.col("at").alias(column), F.col("piece").alias(name))
    placed = rows.join(of("from", "first"), ["key", "from"]).join(of("to", "past"), ["key", "to"])
    return cut, placed.select("key", F.explode(F.sequence(F.col("first"), F.col("past") - 1)).alias("piece"), "first", "span")


def covered(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """Points (key, at, further columns) with each span (key, start, end, further columns) with start <= at < end."""
    over = lambda rows, most: rows.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("n")).where(F.col("n") > most).select("_key")
    large = materialised(over(points.where(F.col(key).isNotNull()), POINTS).union(over(spans.where(F.col(key).isNotNull()), SPANS)).distinct(), "large")
    if large.isEmpty():
        return _met(points, spans, key, at, start, end)
    of = lambda rows, how: rows.join(large, F.col(f"`{key}`") == F.col("_key"), how)
    met = _met(of(points, "left_anti"), of(spans, "left_anti"), key, at, start, end)
    return met.unionByName(_swept(of(points, "left_semi"), of(spans, "left_semi"), key, at, start, end))


def _met(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """As `covered`, for keys with few of both."""
    dots = points.select(F.struct(*(F.col(f"`{c}`") for c in points.columns)).alias("point"))
    covers = spans.where(F.col(start) < F.col(end)).select(F.struct(*(F.col(f"`{c}`") for c in spans.columns)).alias("span"))
    inside = (F.col(f"point.`{key}`") == F.col(f"span.`{key}`")) & (F.col(f"point.`{at}`") >= F.col(f"span.`{start}`")) & (F.col(f"point.`{at}`") < F.col(f"span.`{end}`"))
    met = dots.join(covers.hint("merge"), inside)  # Spark doesn't know how many spans a row of theirs became
    return met.select("point.*", *[F.col(f"span.`{c}`") for c in spans.columns if c != key])


def _swept(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """As `covered`, for keys with many of either."""
    cut, members = pieces(spans, key, start, end)
    active = members.groupBy("key", "piece").agg(F.collect_list("span").alias("spans"))
    open_ = cut.join(active, ["key", "piece"], "left").select(
        "key", F.col("at").alias("at"), F.lit(0).alias("kind"), F.coalesce("spans", F.array().cast(active.schema["spans"].dataType)).alias("spans"), F.lit(None).alias("point")
    )
    rows = points.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    dots = rows.select(
        F.col(key).alias("key"), F.col(at).alias("at"), F.lit(1).alias("kind"), F.lit(None).alias("spans"), F.struct(*(F.col(f"`{c}`") for c in points.columns)).alias("point")
    )
    swept = carried_last(open_.unionByName(dots), ["key"], ["at", "kind"], "spans", "open")
    met = swept.where("kind = 1").select("point", F.explode("open").alias("span"))
    return met.select("point.*", *[F.col(f"span.`{c}`") for c in spans.columns if c != key])


def _located(points: DataFrame, position: Column, cut: DataFrame, name: str, strict: bool) -> DataFrame:
    """Rows (key, row) with the last piece that begins at or before a position (before it, if strict); null before the first."""
    marks = cut.select("key", "at", F.lit(1).alias("kind"), "piece", F.lit(None).alias("row"))
    dots = points.select("key", position.alias("at"), F.lit(0 if strict else 2).alias("kind"), F.lit(None).cast("long").alias("piece"), F.struct("*").alias("row"))
    swept = carried_last(marks.unionByName(dots), ["key"], ["at", "kind"], "piece", "found")
    return swept.where("kind <> 1").select("row.*", F.col("found").alias(name))


def overlapping(segments: DataFrame, windows: DataFrame, key: str, start: str = "start", end: str = "end", window_start: str = "window_start", window_end: str = "window_end") -> DataFrame:
    """Segments joined to the windows of their key that they overlap by more than a point; both with both ends."""
    cut, members = pieces(windows, key, window_start, window_end)
    rows = segments.where(F.col(key).isNotNull() & (F.col(start) < F.col(end)))
    rows = rows.select(F.col(key).alias("key"), F.struct(*(F.col(f"`{c}`") for c in segments.columns)).alias("segment"))
    rows = _located(rows, F.col(f"segment.`{start}`"), cut, "a", strict=False)
    rows = _located(rows, F.col(f"segment.`{end}`"), cut, "b", strict=True).where("b IS NOT NULL").withColumn("a", F.coalesce("a", F.lit(0)))
    in_pieces = rows.withColumn("piece", F.explode(F.sequence("a", "b")))
    met = in_pieces.join(members, ["key", "piece"]).where(F.col("piece") == F.greatest("a", "first"))  # the first piece that both are in
    return met.select("segment.*", *[F.col(f"span.`{c}`") for c in windows.columns if c != key])
