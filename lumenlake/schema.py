"""The media and face tables: types, defaults for missing fields, and derived fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlake.functions.temporal import rfc3339_epoch

SEGMENT = "struct<start_seconds:double,end_seconds:double,confidence:float>"
FACE = (
    "struct<face_id:string,media_id:string,frame_index:int,bbox:struct<x:float,y:float,width:float,height:float>,"
    "confidence:float,person_id:string,person_label:string>"
)
PERSON = "struct<person_id:string,label:string,face_count:int,media_count:int,confidence:float>"

#: Fixed field names of the catalogue's payload.
MEDIA_FIELDS = {
    "id": "string", "path": "string", "relative_path": "string", "filename": "string", "width": "int", "height": "int",
    "size_bytes": "bigint", "modified_at": "double", "phash": "string", "thumbnail_url": "string",
    "animated_thumbnail_url": "string", "media_kind": "string", "frame_count": "int", "duration_ms": "int",
    "full_video_url": "string", "full_audio_url": "string", "full_pdf_url": "string", "pdf_page_url": "string",
    "pdf_document_id": "string", "pdf_page_index": "int", "pdf_page_number": "int", "pdf_page_count": "int",
    "audio_analysis": (
        f"struct<speech_detected:boolean,speech_ratio:float,speech_segments:array<{SEGMENT}>,"
        "audio_segments:array<struct<segment_index:int,kind:string,start_seconds:double,end_seconds:double,confidence:float,"
        "speaker_id:string,speaker_label:string>>,"
        "recognized_voices:array<struct<id:string,label:string,segment_count:int,total_seconds:double,confidence:float>>,"
        "transcript_text:string,transcript_language:string,"
        "transcript_segments:array<struct<segment_index:bigint,start_seconds:double,end_seconds:double,text:string,confidence:float>>,"
        "tempo_bpm:float,tempo_confidence:float,tempo_onset_count:int>"
    ),
    "ocr_text": "string", "ocr_frames": "array<struct<frame_index:int,text:string>>", "visual_embedding_model": "string",
    "faces": f"array<{FACE}>", "people": f"array<{PERSON}>", "artifacts": "array<struct<kind:string,url:string>>",
    "tags": "array<string>",
    "photo_metadata": (
        "struct<capture_time:string,camera_make:string,camera_model:string,lens_model:string,orientation:string,"
        "gps:struct<latitude:double,longitude:double,altitude_meters:double>,rating:float,keywords:array<string>,title:string,"
        "description:string,creator:string,copyright:string,raw:array<struct<namespace:string,key:string,label:string,value:string>>>"
    ),
    "scene_clip_url": "string", "scene_index": "int", "scene_start_frame": "bigint", "scene_end_frame": "bigint",
    "scene_start_seconds": "double", "scene_end_seconds": "double", "source_type": "string", "source_item_uri": "string",
    "indexing_profile": "string", "source_uri": "string", "visual": "array<float>",
}
MEDIA_KINDS = ("static_image", "animated_gif", "video_scene", "audio", "pdf_page", "pdf_document")
DEFAULTS = {"media_kind": "static_image", "ocr_text": "", "source_type": "local"}
EMPTY_ARRAYS = ("ocr_frames", "faces", "people", "artifacts", "tags")


def media_schema() -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in MEDIA_FIELDS.items()))


def read_payloads(rows: DataFrame, column: str = "payload", corrupt: str = "skip") -> DataFrame:
    """Media rows from JSON payloads.  Missing fields take defaults and unknown ones are ignored.

    ``corrupt``: ``fail`` raises on a payload that is not JSON, ``skip`` leaves it out, ``keep``
    keeps the row with the payload in ``corrupt_payload``.
    """
    schema = media_schema()
    if corrupt == "fail":
        parsed = rows.withColumn("_m", F.from_json(column, schema, {"mode": "FAILFAST"}))
        return with_defaults(parsed.select("_m.*"))
    wide = schema.add("corrupt_payload", "string")
    parsed = rows.select(F.from_json(column, wide, {"columnNameOfCorruptRecord": "corrupt_payload"}).alias("_m")).select("_m.*")
    if corrupt == "skip":
        parsed = parsed.where("corrupt_payload IS NULL AND id IS NOT NULL").drop("corrupt_payload")
    return with_defaults(parsed)


def complete(media: DataFrame) -> DataFrame:
    """Rows with all fields of the payload, in their order and types: missing ones are null or their defaults."""
    have = {c.lower() for c in media.columns}
    columns = [(F.col(f"`{n}`") if n.lower() in have else F.lit(None)).cast(kind).alias(n) for n, kind in MEDIA_FIELDS.items()]
    return with_defaults(media.select(*columns))


def with_defaults(media: DataFrame) -> DataFrame:
    filled = {c: F.coalesce(c, F.lit(v)) for c, v in DEFAULTS.items()}
    filled |= {c: F.coalesce(c, F.array().cast(MEDIA_FIELDS[c])) for c in EMPTY_ARRAYS}
    return media.withColumns(filled)


def with_derived(media: DataFrame) -> DataFrame:
    """Fields that filters push down: GPS flag, capture time, camera text and keywords."""
    meta = F.col("photo_metadata")
    camera = F.concat_ws(" ", meta["camera_make"], meta["camera_model"], meta["lens_model"])
    return media.withColumns(
        {
            "point_kind": F.lit("media"),
            "photo_has_gps": F.coalesce(meta["gps"].isNotNull(), F.lit(False)),
            "photo_capture_time_epoch": rfc3339_epoch(meta["capture_time"]),
            "photo_camera_text": F.lower(camera),
            "photo_keywords": F.coalesce(meta["keywords"], F.array().cast("array<string>")),
        }
    )
