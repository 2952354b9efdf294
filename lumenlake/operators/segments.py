"""Temporal segments: slices by window, joins by interval, frames by stride."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.functions.temporal import overlap_seconds, overlaps, thinned
from lumenlake.operators.sweep import carried_last, covered, overlapping


def slice_segments(segments: Column, start: Column, end: Column) -> Column:
    """Segments of an array that overlap a window; their times stay relative to the source."""
    return F.filter(segments, lambda s: overlaps(s["start_seconds"], s["end_seconds"], start, end))


def transcript_slice(segments: Column, speech: Column, start: Column, end: Column) -> Column:
    """Text, parts and speech ratio of a scene; null where nothing overlaps it."""
    parts, spoken = slice_segments(segments, start, end), slice_segments(speech, start, end)
    text = F.array_join(F.filter(F.transform(parts, lambda s: F.trim(s["text"])), lambda t: t != ""), " ")
    ratio = F.least(F.lit(1.0), overlap_seconds(spoken, start, end) / (end - start))
    return F.when((F.size(parts) > 0) | (F.size(spoken) > 0), F.struct(text.alias("text"), parts.alias("segments"), spoken.alias("speech"), ratio.alias("speech_ratio")))


def join_overlapping(segments: DataFrame, windows: DataFrame, key: str, bucket: float | None = None, swept: bool = False) -> DataFrame:
    """Segments (key, start, end) joined to windows (key, window_start, window_end) that they overlap.

    The key makes an equi-join.  Where one key has very many of both, ``bucket`` cuts time into
    pieces: both sides meet per piece, and a pair counts in the piece in which its overlap begins;
    ``swept`` sorts both sides instead (see `sweep.overlapping`), which needs no size of pieces.
    Segments with an open start or end have no last piece and take the plain join.
    """
    test = overlaps(F.col("start"), F.col("end"), F.col("window_start"), F.col("window_end"))
    plain = segments.join(windows, key).where(test)
    if bucket is None and not swept:
        return plain
    closed = F.col("start").isNotNull() & F.col("end").isNotNull()
    open_ = segments.where(~closed).join(windows, key).where(test)
    if swept:
        return overlapping(segments.where(closed), windows, key).unionByName(open_)
    pieces = lambda a, b: F.explode(F.sequence(F.floor(a / bucket), F.floor(b / bucket)))
    left = segments.where(closed & (F.col("start") <= F.col("end"))).withColumn("_piece", pieces(F.col("start"), F.col("end")))
    right = windows.where("window_start <= window_end").withColumn("_piece", pieces(F.col("window_start"), F.col("window_end")))
    first = F.floor(F.greatest("start", "window_start") / bucket)
    met = left.join(right, [key, "_piece"]).where(test & (F.col("_piece") == first)).drop("_piece")
    return met.unionByName(open_)


def scene_frames(frames: DataFrame, scenes: DataFrame, stride: int, most: int) -> DataFrame:
    """Frames (video_id, frame) of each scene (video_id, scene, start, end): the first, every ``stride``-th, ``most`` at most.

    By `sweep.covered`: frames of long videos don't meet the other scenes of their video, which may overlap.
    """
    kept = covered(frames, scenes, "video_id", "frame", "start", "end").where((F.col("frame") - F.col("start")) % stride == 0)
    n = F.row_number().over(Window.partitionBy("video_id", "scene").orderBy("frame"))  # each task sends its first ones only
    return kept.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")


def content_cuts(frames: DataFrame, threshold: float = 27.0, least: int = 15) -> DataFrame:
    """(video_id, frame, score): frames at which a scene begins, from (video_id, frame, hue, saturation, value) rows.

    A frame's score is the mean of the three channels' differences from the frame before it; it is a cut if that
    reaches the threshold and the last cut (or the video's first frame) is ``least`` frames back or more.  Rows
    are compared over the borders of partitions (`sweep.carried_last`).  A cut depends on cuts that are closer than
    ``least`` only, so frames in runs of close candidates are decided together, one run in a row.  A frame
    with a null channel is skipped, and null videos and frames.
    """
    channels = ("hue", "saturation", "value")
    rows = frames.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in ("video_id", "frame", *channels)]))
    seen = F.struct("frame", *channels)
    # each frame twice: first it asks for what is before it, then it is what is before the next
    ask = rows.select("video_id", "frame", F.lit(0).alias("turn"), seen.alias("own"), F.lit(None).alias("told"))
    tell = rows.select("video_id", "frame", F.lit(1).alias("turn"), F.lit(None).alias("own"), seen.alias("told"))
    met = carried_last(ask.unionByName(tell), ["video_id"], ["frame", "turn"], "told", "before").where("turn = 0")
    score = sum(F.abs(F.col(f"own.{c}") - F.col(f"before.{c}")) for c in channels) / len(channels)
    scored = met.select("video_id", "frame", "before", score.cast("double").alias("score"))
    # the first frame counts as a cut for those after it
    candidates = scored.where(F.col("before").isNull() | (F.col("score") >= threshold)).drop("before")
    mark = candidates.select("video_id", "frame", "score", F.lit(0).alias("turn"), F.lit(None).cast("long").alias("told"))
    told = candidates.select("video_id", "frame", "score", F.lit(1).alias("turn"), F.col("frame").cast("long").alias("told"))
    gaps = carried_last(mark.unionByName(told), ["video_id"], ["frame", "turn"], "told", "last").where("turn = 0")
    starts = gaps.withColumn("start", F.when(F.col("last").isNull() | (F.col("frame") - F.col("last") >= least), F.col("frame")))
    runs = carried_last(starts.select("video_id", "frame", "score", "start"), ["video_id"], ["frame"], "start", "run")
    together = runs.groupBy("video_id", "run").agg(F.array_sort(F.collect_list(F.struct("frame", "score"))).alias("c"))
    kept = F.aggregate(
        "c", F.slice("c", 1, 0),
        lambda acc, x: F.when((F.size(acc) == 0) | (x["frame"] - F.element_at(acc, -1)["frame"] >= least), F.array_append(acc, x)).otherwise(acc),
    )
    cuts = together.select("video_id", F.explode(kept).alias("c"))
    return cuts.where("c.score IS NOT NULL").select("video_id", "c.frame", "c.score")


def adjacent_pairs(rows: DataFrame, by: str, order: str) -> DataFrame:
    """Each row with the one after it: columns ``order`` and next_``order``."""
    after = F.lead(order).over(Window.partitionBy(by).orderBy(order))
    return rows.withColumn(f"next_{order}", after).where(F.col(f"next_{order}").isNotNull())


def audio_bits(
    duration: Column, boundaries: Column, speech: Column, onsets: Column, most: float = 30.0, least: float = 0.75
) -> Column:
    """Segments between cut points, in pieces of ``most`` seconds; none under ``least`` seconds.

    Over 0.35 of speech make a segment speech, onsets without it music_or_sound; the rest is audio.
    Where there is any speech, segments with neither are left out.  Without a segment the whole is one.
    """
    def pieces(cuts):  # the starts of the pieces between a cut point and the next, and the last point
        def starts(a, i):
            b = F.get(cuts, i + 1)
            n = F.greatest(F.lit(1), F.ceil((b - a) / most).cast("int"))
            return F.when(b.isNotNull(), F.transform(F.sequence(F.lit(0), n - 1), lambda k: a + k * F.lit(most))).otherwise(F.array(a))

        return F.flatten(F.transform(cuts, starts))

    def between(points):
        def classed(a, i):
            b = F.least(F.get(points, i + 1), duration)
            return let(overlap_seconds(speech, a, b), lambda heard: let(
                F.size(F.filter(onsets, lambda o: (o >= a) & (o < b))), lambda hits: one(a, b, heard, hits)))

        return F.filter(F.transform(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), classed), lambda s: s["kept"])

    def one(a, b, heard, hits):
        share = heard / (b - a)
        kind = F.when(share >= 0.35, "speech").when(hits > 0, "music_or_sound").otherwise("audio")
        sure = F.when(share >= 0.35, F.least(F.lit(1.0), share)).when(hits > 0, F.greatest(F.lit(0.25), F.least(F.lit(0.85), hits / 6.0))).otherwise(0.25)
        kept = (b - a >= least) & ~((heard <= 0) & (hits == 0) & (F.size(speech) > 0))
        return F.struct(F.round(a, 3).alias("start_seconds"), F.round(b, 3).alias("end_seconds"), kind.alias("kind"), sure.alias("confidence"), F.coalesce(kept, F.lit(False)).alias("kept"))

    def or_whole(bits):
        plain = F.transform(bits, lambda s: F.struct(*(s[k].alias(k) for k in ("start_seconds", "end_seconds", "kind", "confidence"))))
        whole = F.struct(F.lit(0.0).alias("start_seconds"), F.round(duration, 3).alias("end_seconds"), F.lit("audio").alias("kind"), F.lit(0.25).cast("double").alias("confidence"))
        return F.when(duration > 0, F.when(F.size(bits) > 0, plain).otherwise(F.array(whole))).otherwise(F.slice(plain, 1, 0))

    points = let(boundaries, lambda cuts: thinned(pieces(cuts), 0.25))
    return let(let(points, between), or_whole)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def transcript(spoken: Column) -> Column:
    """A transcript of (text, language, segments of index, start, end, text, confidence) as it is stored.

    Without a text the segments' texts are joined; blank segments go; an empty transcript is null.
    """
    parts = F.filter(
        F.transform(spoken["segments"], lambda s: F.struct(
            s["index"].cast("long").alias("segment_index"), s["start_seconds"].alias("start_seconds"), s["end_seconds"].alias("end_seconds"),
            F.trim(s["text"]).alias("text"), s["confidence"].alias("confidence"))),
        lambda s: F.coalesce(s["text"] != "", F.lit(False)),
    )
    text = F.trim(F.coalesce(spoken["text"], F.array_join(F.transform(parts, lambda s: s["text"]), " ")))
    return F.when(text != "", F.struct(text.alias("text"), spoken["language"].alias("language"), parts.alias("segments")))
