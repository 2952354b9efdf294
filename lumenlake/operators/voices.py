"""Recognised voices of audio files, and enrolment of unknown ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.operators.founding import FoundingParams, founded
from lumenlake.operators.order import numbered
from lumenlake.plans.scratch import materialised


def recognised(segments: DataFrame) -> DataFrame:
    """Per medium and voice over (media_id, voice_id, label, start, end, score): the first label, counts, seconds and mean score."""
    seconds = F.greatest(F.lit(0.0), F.col("end") - F.col("start"))
    return (
        segments.where("voice_id IS NOT NULL")
        .groupBy("media_id", "voice_id")
        .agg(
            F.min_by("label", F.when(F.col("label").isNotNull(), F.col("start"))).alias("label"),
            F.count("*").alias("segment_count"),
            F.round(F.sum(seconds), 3).alias("total_seconds"),
            F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.avg("score"))).alias("confidence"),
        )
    )


def usable_segments(segments: DataFrame, least: float = 0.25, most: float = 30.0) -> DataFrame:
    return segments.where((F.col("end") - F.col("start")).between(least, most))


def enrol(
    segments: DataFrame, group: str, min_score: float = 0.86, first_number: int = 1, params: FoundingParams = FoundingParams()
) -> DataFrame:
    """(group, segment_id, voice, label, score): recognise or enrol in the order of segment_id.

    A segment is the voice whose founder it is most similar to, by ``min_score`` at least (the first of
    equals), or founds one with a score of 1; what is recognised changes no voice.  Segments with a start
    and an end take part only if their length is usable.  Voices of a registry (``group``) are numbered from
    ``first_number``, the highest in use plus one.  Registries of any size: see `founding.founded`; a segment
    without a usable vector has no voice (nulls).
    """
    if {"start", "end"} <= set(segments.columns):
        segments = usable_segments(segments)
    found = materialised(founded(segments, group, "segment_id", "embedding", min_score, params), "voices")
    founders = found.where("founds").select(F.col(group).alias("_g"), F.col("width").alias("_w"), F.col("at").alias("_at"), F.col("segment_id").alias("_s"))
    names = numbered(founders, ["_g"], [F.col("_s"), F.col("_w"), F.col("_at")], "_n")
    same = F.col(group).eqNullSafe(F.col("_g")) & (F.col("width") == F.col("_w")) & (F.col("founder_at") == F.col("_at"))
    number = F.col("_n") + first_number
    return found.join(names, same, "left").select(
        group, "segment_id", F.format_string("voice-%04d", number).alias("voice"), F.format_string("Voice %d", number).alias("label"), "score"
    ).withColumns({c: F.when(F.col("score").isNotNull(), F.col(c)) for c in ("voice", "label")})
