"""Inverse indexes: the media of each person and each speaker."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def average(total, n):
    return F.coalesce(total / F.nullif(n, F.lit(0)), F.lit(0.0))


def person_locations(media: DataFrame) -> DataFrame:
    """(person_id, media_id, relative_path, label, faces, frames, confidence_sum, confidence_n) from faces and people.

    The label is the first that the medium has, its faces before its people.
    """
    base = media.select("id", "relative_path", "faces", "people")
    order = lambda part: F.struct(F.lit(part).alias("part"), "pos")
    seen = base.select("id", "relative_path", F.posexplode("faces").alias("pos", "f")).where("f.person_id IS NOT NULL").select(
        F.col("f.person_id").alias("person_id"), F.col("id").alias("media_id"), "relative_path", F.col("f.person_label").alias("label"), order(0).alias("at"),
        F.lit(1).alias("faces"), F.lit(0).alias("said"), F.col("f.frame_index").alias("frame"), F.col("f.confidence").cast("double").alias("c"),
    )
    said = base.select("id", "relative_path", F.posexplode("people").alias("pos", "p")).where("p.person_id IS NOT NULL").select(
        F.col("p.person_id").alias("person_id"), F.col("id").alias("media_id"), "relative_path", F.col("p.label").alias("label"), order(1).alias("at"),
        F.lit(0).alias("faces"), F.col("p.face_count").alias("said"), F.lit(None).cast("int").alias("frame"), F.col("p.confidence").cast("double").alias("c"),
    )
    return (
        seen.unionByName(said)
        .groupBy("person_id", "media_id", "relative_path")
        .agg(
            F.greatest(F.sum("faces"), F.max("said").cast("long")).alias("face_count"),
            F.count_distinct("frame").alias("frames"),
            F.sum("c").alias("c_sum"),
            F.count("c").alias("c_n"),
            F.min_by("label", F.when(F.col("label").isNotNull(), F.col("at"))).alias("label"),
        )
    )


def people_index(media: DataFrame) -> DataFrame:
    """Per person: faces, media, mean confidence, the first label by media id, and the first place by path.

    Sums only: a person may be in a third of all media.  The places are rows of `people_places`.
    """
    return (
        person_locations(media)
        .groupBy("person_id")
        .agg(
            F.sum("face_count").alias("face_count"),
            F.count("*").alias("media_count"),
            average(F.sum("c_sum"), F.sum("c_n")).alias("confidence"),
            F.min_by("label", F.when(F.col("label").isNotNull(), F.col("media_id"))).alias("label"),
            F.min(F.struct("relative_path", "media_id")).alias("first_place"),
        )
        .orderBy("person_id")
    )


def people_places(media: DataFrame) -> DataFrame:
    """The places of people as rows, by person, path and medium: a sort by range, which no group confines to a task."""
    places = person_locations(media).select("person_id", "relative_path", "media_id", "face_count", "frames")
    return places.orderBy("person_id", "relative_path", "media_id")


def speaker_locations(media: DataFrame) -> DataFrame:
    """Per voice and medium, from the media's audio: occurrences, bounds of the voice's segments, best confidence, sums.

    A voice occurs in a medium as often as it has segments there, or as often as it says, once at least.
    """
    audio = F.col("audio_analysis")
    scene = [c for c in ("scene_start_seconds", "scene_end_seconds", "media_kind") if c in media.columns]
    voices = media.select("id", "relative_path", *scene, audio["audio_segments"].alias("segments"), F.posexplode(audio["recognized_voices"]).alias("pos", "v"))
    voice = F.trim(F.col("v.id"))
    own = F.coalesce(F.filter("segments", lambda s: s["speaker_id"] == voice), F.filter("segments", lambda s: F.lit(False)))
    bound = lambda agg, name: agg(F.transform(own, lambda s: s[name]))
    segments = F.coalesce(F.when(F.col("segments").isNotNull(), F.size(own)), F.lit(0))
    rows = voices.where(F.coalesce(voice != "", F.lit(False))).select(
        voice.alias("voice_id"), F.col("id").alias("media_id"), "relative_path", *scene, "pos", F.col("v.label").alias("label"), F.col("v.segment_count").alias("said"),
        F.col("v.total_seconds").alias("seconds"), F.col("v.confidence").cast("double").alias("c"), segments.alias("n"),
        bound(F.array_min, "start_seconds").alias("start"), bound(F.array_max, "end_seconds").alias("end"),
    )
    return rows.groupBy("voice_id", "media_id", "relative_path", *scene).agg(
        F.sum(F.greatest("n", "said", F.lit(1))).alias("occurrences"),
        F.min("start").alias("start_seconds"),
        F.max("end").alias("end_seconds"),
        F.max("c").alias("confidence"),
        F.sum("said").alias("segment_count"),
        F.sum("seconds").alias("total_seconds"),
        F.sum("c").alias("c_sum"),
        F.count("*").alias("c_n"),
        F.min_by("label", F.when(F.col("label").isNotNull(), F.col("pos"))).alias("label"),
    )


def speakers_of_media(media: DataFrame) -> DataFrame:
    """Per voice: segments, seconds, mean confidence, media, and the first label by media id; its places are `speaker_locations`."""
    return (
        speaker_locations(media)
        .groupBy("voice_id")
        .agg(
            F.sum("segment_count").alias("segment_count"),
            F.sum("total_seconds").alias("total_seconds"),
            average(F.sum("c_sum"), F.sum("c_n")).alias("confidence"),
            F.count("*").alias("media_count"),
            F.sum("occurrences").alias("occurrences"),
            F.min_by("label", F.when(F.col("label").isNotNull(), F.col("media_id"))).alias("label"),
        )
        .orderBy("voice_id")
    )


def speakers_index(voices: DataFrame) -> DataFrame:
    """Per voice over rows (voice_id, media_id, segment_count, total_seconds, confidence, start_seconds, end_seconds)."""
    per_media = voices.groupBy("voice_id", "media_id").agg(
        F.sum("segment_count").alias("segments"),
        F.sum("total_seconds").alias("seconds"),
        F.sum("confidence").alias("c"),
        F.count("*").alias("n"),
        F.min("start_seconds").alias("first_second"),
        F.max("end_seconds").alias("last_second"),
    )
    return (
        per_media.groupBy("voice_id")
        .agg(
            F.sum("segments").alias("segment_count"),
            F.sum("seconds").alias("total_seconds"),
            average(F.sum("c"), F.sum("n")).alias("confidence"),
            F.count("*").alias("media_count"),
            F.sum(F.greatest("segments", "n", F.lit(1))).alias("occurrences"),
            F.min("first_second").alias("first_second"),
            F.max("last_second").alias("last_second"),
        )
        .orderBy("voice_id")
    )


def merge_voices(voices: DataFrame, keys: list[str]) -> DataFrame:
    """Voices of equal keys: summed counts and seconds, mean confidence weighted by count (1 for none)."""
    w = F.greatest(F.col("segment_count"), F.lit(1))
    return voices.groupBy(*keys).agg(
        F.sum("segment_count").alias("segment_count"),
        F.round(F.sum("total_seconds"), 3).alias("total_seconds"),
        (F.sum(F.col("confidence") * w) / F.sum(w)).alias("confidence"),
    )
