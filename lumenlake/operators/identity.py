"""Renaming and merging of people and speakers, as rewrites of nested arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.operators.faces import summarise_people
from lumenlake.operators.filters import has_speaker


def check_label(label: str) -> str:
    label = label.strip()
    if not label or len(label) > 80 or any(ord(c) < 32 or ord(c) == 127 for c in label):
        raise ValueError("a label has 1 to 80 characters, none of them control characters")
    return label


def _relabel(items: Column, key: str, name: str, wanted: str, label: str) -> Column:
    return F.transform(items, lambda x: F.when(x[key] == wanted, x.withField(name, F.lit(label))).otherwise(x))


def rename_person(media: DataFrame, person_id: str, label: str) -> DataFrame:
    """Media with the person's label in faces and people; ``changed`` tells rows that differ."""
    label = check_label(label)
    faces = _relabel(F.col("faces"), "person_id", "person_label", person_id, label)
    people = _relabel(F.col("people"), "person_id", "label", person_id, label)
    changed = ~(faces.eqNullSafe(F.col("faces")) & people.eqNullSafe(F.col("people")))
    return media.withColumns({"changed": changed, "faces": faces, "people": people})


def merge_people(media: DataFrame, sources: list[str], target: str, label: str | None) -> DataFrame:
    """Media with the source people remapped to the target and people rebuilt from faces.

    People of whom a medium has no face stay, remapped, unless the target is there already.
    """
    wanted = list(dict.fromkeys(s.strip() for s in sources if s.strip() and s.strip() != target))
    if not wanted:
        raise ValueError("there is no source to merge")
    remap = lambda x, name: F.when(
        x["person_id"].isin(*wanted, target),
        x.withField("person_id", F.lit(target)).withField(name, F.coalesce(F.lit(label), x[name])),
    ).otherwise(x)
    faces = F.transform("faces", lambda f: remap(f, "person_label"))
    touched = F.exists("faces", lambda f: f["person_id"].isin(*wanted)) | F.exists("people", lambda p: p["person_id"].isin(*wanted))
    rows = media.withColumns({"changed": F.coalesce(touched, F.lit(False)), "faces": faces})
    built = summarise_people(F.col("faces"))
    legacy = F.transform("people", lambda p: remap(p, "label"))
    legacy = F.filter(legacy, lambda p: ~F.exists(built, lambda b: b["person_id"] == p["person_id"]))
    kind = media.schema["people"].dataType
    return rows.withColumn("people", F.when(F.col("changed"), F.concat(built.cast(kind), legacy)).otherwise(F.col("people")))


def missing_sources(faces: DataFrame, sources: list[str]) -> DataFrame:
    """Requested people of whom there is no face."""
    asked = faces.sparkSession.createDataFrame([(s,) for s in sources], "person_id string")
    return asked.join(faces.select("person_id").distinct(), "person_id", "left_anti")


def rename_faces(faces: DataFrame, person_id: str, label: str) -> DataFrame:
    """Face rows with the person's label; ``changed`` tells rows that differ."""
    mine = F.col("person_id").eqNullSafe(F.lit(person_id))
    label = F.lit(check_label(label))
    return faces.withColumns({"changed": mine & ~F.col("person_label").eqNullSafe(label), "person_label": F.when(mine, label).otherwise(F.col("person_label"))})


def require_person(media: DataFrame, faces: DataFrame, person_id: str) -> None:
    """An error if neither a medium nor a face knows the person."""
    known = F.exists("faces", lambda f: f["person_id"] == person_id) | F.exists("people", lambda p: p["person_id"] == person_id)
    if media.where(known).isEmpty() and faces.where(F.col("person_id") == person_id).isEmpty():
        raise LookupError(f"person {person_id} was not found")


def rename_speaker(media: DataFrame, speaker_id: str, label: str) -> DataFrame:
    """Media with the speaker's label in recognised voices and segments; ``changed`` tells rows that differ."""
    label = check_label(label)
    audio = F.col("audio_analysis")
    voices = _relabel(audio["recognized_voices"], "id", "label", speaker_id, label)
    segments = _relabel(audio["audio_segments"], "speaker_id", "speaker_label", speaker_id, label)
    new = audio.withField("recognized_voices", voices).withField("audio_segments", segments)
    return media.withColumns({"changed": ~new.eqNullSafe(audio), "audio_analysis": new})


def first_person_label(media: DataFrame, faces: DataFrame, person_id: str) -> str | None:
    """A person's first label that isn't blank: of the media's people by media id, or of their faces, or of face rows."""
    def labels(items: Column, name: str) -> Column:
        mine = F.filter(items, lambda x: (x["person_id"] == person_id) & (F.coalesce(F.trim(x[name]), F.lit("")) != ""))
        return F.try_element_at(F.transform(mine, lambda x: F.trim(x[name])), F.lit(1))

    first = lambda c, order: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order)))
    found = media.select("id", labels(F.col("people"), "label").alias("person"), labels(F.col("faces"), "person_label").alias("face"))
    row = found.agg(first("person", "id").alias("person"), first("face", "id").alias("face")).first()
    own = faces.where(F.col("person_id") == person_id).select("face_id", F.nullif(F.trim("person_label"), F.lit("")).alias("label"))
    return row.person or row.face or own.agg(first("label", "face_id").alias("label")).first().label


def first_label(media: DataFrame, speaker_id: str) -> str | None:
    """A speaker's first label that isn't blank by media id: of the recognised voices, or else of the segments."""
    audio, blank = F.col("audio_analysis"), F.lit("")

    def labels(items: Column, key: str, name: str) -> Column:
        mine = F.filter(items, lambda x: (x[key] == speaker_id) & (F.coalesce(F.trim(x[name]), blank) != ""))
        return F.try_element_at(F.transform(mine, lambda x: F.trim(x[name])), F.lit(1))

    found = media.select(
        "id", labels(audio["recognized_voices"], "id", "label").alias("voice"), labels(audio["audio_segments"], "speaker_id", "speaker_label").alias("segment")
    )
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("id")))
    row = found.agg(first("voice").alias("voice"), first("segment").alias("segment")).first()
    return row.voice or row.segment


def has_speaker_anywhere(media: DataFrame, speaker_id: str, registry: DataFrame | None = None) -> bool:
    if registry is not None and not registry.where(F.col("id") == speaker_id).isEmpty():
        return True
    return not media.where(has_speaker(speaker_id)).isEmpty()


def merge_speakers(media: DataFrame, sources: list[str], target: str, label: str | None = None) -> DataFrame:
    """Media with the source speakers remapped to the target; ``changed`` tells rows that differ.

    The voices of one medium that become the same are one: counts and seconds summed, confidence weighted
    by the counts (1 for none), in the place of the first.  The label is the target's first one, or its id.
    """
    wanted = list(dict.fromkeys(s.strip() for s in sources if s.strip() and s.strip() != target))
    if not wanted:
        raise ValueError("there is no source to merge")
    name = F.lit(label or first_label(media, target) or target)
    audio = F.col("audio_analysis")
    segments = F.transform(audio["audio_segments"], lambda s: F.when(
        s["speaker_id"].isin(*wanted), s.withField("speaker_id", F.lit(target)).withField("speaker_label", name)).otherwise(s))
    voices = audio["recognized_voices"]
    hit = lambda v: v["id"].isin(*wanted, target)
    mine = F.filter(voices, hit)
    weight = lambda v: F.greatest(v["segment_count"], F.lit(1))
    total = lambda f: F.aggregate(mine, F.lit(0.0), lambda acc, v: acc + f(v))
    kind = media.schema["audio_analysis"].dataType["recognized_voices"].dataType
    one = F.struct(
        F.lit(target).alias("id"), name.alias("label"), total(lambda v: v["segment_count"]).cast("int").alias("segment_count"),
        F.round(total(lambda v: v["total_seconds"]), 3).alias("total_seconds"),
        (total(lambda v: v["confidence"].cast("double") * weight(v)) / total(weight)).alias("confidence"),
    ).cast(kind.elementType)
    place = F.array_position(F.transform(voices, hit), F.lit(True))
    rest = F.filter(F.transform(voices, lambda v, i: F.when(i + 1 == place, one).when(~hit(v), v)), lambda v: v.isNotNull())
    touched = F.coalesce(F.exists(voices, lambda v: v["id"].isin(*wanted)), F.lit(False))
    new = audio.withField("audio_segments", segments).withField("recognized_voices", F.when(touched, rest).otherwise(voices))
    return media.withColumns({"changed": audio.isNotNull() & ~new.eqNullSafe(audio), "audio_analysis": new})


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """(id, label, embeddings) of a registry of voices saved as JSON rows; rows that aren't JSON or lack an id are left out."""
    rows = spark.read.schema("id string, label string, embeddings array<array<double>>").json(path)
    return rows.where("id IS NOT NULL")


def rename_registry(voices: DataFrame, speaker_id: str, label: str) -> DataFrame:
    return voices.withColumn("label", F.when(F.col("id") == speaker_id, F.lit(check_label(label))).otherwise(F.col("label")))


def merge_registry(voices: DataFrame, sources: list[str], target: str) -> DataFrame:
    """The voice registry with the sources' embeddings moved to the target and the sources gone."""
    name = F.when(F.col("id").isin(*sources), F.lit(target)).otherwise(F.col("id"))
    return voices.withColumn("_to", name).groupBy(F.col("_to").alias("id")).agg(
        F.min_by("label", F.when((F.col("id") == F.col("_to")) & F.col("label").isNotNull(), F.col("id"))).alias("label"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("id", "embeddings"))), lambda x: x["embeddings"])).alias("embeddings"),
    )
