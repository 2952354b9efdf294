"""Registry of queries and the projections that bind the catalogue's concepts to the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.schema import MEDIA_FIELDS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of a table loader under its own name."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def media(t) -> DataFrame:
    """Documents as media rows: recognised text, sizes and dates by arithmetic, a hash of the text.

    The hash's last digit follows the id, so that exact copies are near duplicates.
    """
    d = t("documents")
    i = F.col("doc_id")
    return d.select(
        i.alias("id"),
        F.format_string("img-%05d.jpg", i).alias("filename"),
        F.format_string("set%d/img-%05d.jpg", i % 7, i).alias("relative_path"),
        F.format_string("/images/set%d/img-%05d.jpg", i % 7, i).alias("path"),
        F.col("source").alias("source_type"),
        F.concat(F.lit("s3://bucket/"), "source").alias("source_uri"),
        F.format_string("s3://bucket/%s/%d#part=%d", F.col("source"), i, i % 3).alias("source_item_uri"),
        (640 + 32 * (i % 5)).cast("int").alias("width"),
        (640 + 24 * (i % 7)).cast("int").alias("height"),
        F.col("n_chars").alias("size_bytes"),
        (F.lit(1.7e9) + i).alias("modified_at"),
        F.concat(F.substring(F.md5("text"), 1, 15), F.lower(F.hex(i % 16))).alias("phash"),
        F.when(i % 2 == 0, F.lit(1.6e9) + i * 86400.0).alias("photo_capture_time_epoch"),
        (i % 2 == 0).alias("photo_has_gps"),
        F.element_at(F.array(*map(F.lit, ("static_image", "animated_gif", "video_scene", "audio", "pdf_page"))), (i % 5 + 1).cast("int")).alias("media_kind"),
        F.array("lang", F.concat(F.lit("tag"), (i % 8).cast("string"))).alias("tags"),
        F.struct(
            F.element_at(F.array(F.lit("Canon"), F.lit("Nikon"), F.lit(None)), (i % 3 + 1).cast("int")).alias("camera_make"),
            F.format_string("Model %d", i % 4).alias("camera_model"),
            F.lit(None).cast("string").alias("lens_model"),
            F.array(F.concat(F.lit("key"), (i % 5).cast("string"))).alias("keywords"),
        ).alias("photo_metadata"),
        F.col("text").alias("ocr_text"),
        F.array().cast(MEDIA_FIELDS["ocr_frames"]).alias("ocr_frames"),
        F.lit(None).cast(MEDIA_FIELDS["audio_analysis"]).alias("audio_analysis"),
        F.col("lang"),
    )


#: The same projection for the oracle.
MEDIA_SQL = """
media AS (SELECT doc_id AS id, printf('img-%05d.jpg', doc_id) AS filename, printf('set%d/img-%05d.jpg', doc_id % 7, doc_id) AS relative_path,
  source AS source_type, 's3://bucket/' || source AS source_uri,
  CAST(640 + 32 * (doc_id % 5) AS INT) AS width, CAST(640 + 24 * (doc_id % 7) AS INT) AS height, n_chars AS size_bytes,
  1.7e9::DOUBLE + doc_id AS modified_at, substr(md5(text), 1, 15) || lower(to_hex(doc_id % 16)) AS phash,
  CASE WHEN doc_id % 2 = 0 THEN 1.6e9::DOUBLE + doc_id * 86400.0::DOUBLE END AS photo_capture_time_epoch, doc_id % 2 = 0 AS photo_has_gps,
  (['static_image', 'animated_gif', 'video_scene', 'audio', 'pdf_page'])[doc_id % 5 + 1] AS media_kind,
  [lang, 'tag' || (doc_id % 8)] AS tags, (['Canon', 'Nikon', NULL])[doc_id % 3 + 1] AS camera_make, 'Model ' || (doc_id % 4) AS camera_model,
  ['key' || (doc_id % 5)] AS keywords, text AS ocr_text, lang FROM documents)
"""


def rounded(c, places: int = 6):
    return F.round(c, places)
