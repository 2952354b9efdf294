"""Projections: media rows from parsed files, places in responses, status of sources, client views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.functions.ids import uuid5
from lumenlake.functions.text import scene_name, time_fragment

#: How an item's parts are named.
PART_MARKS = {"video_scene": "#scene=", "audio": "#audio-bit=", "pdf_page": "#page="}


def media_parts(items: DataFrame) -> DataFrame:
    """One media row per part of an item: id, uri, path with its time range, file name.

    ``items`` is (item_uri, path, stem, extension, media_kind, parts array<struct<start_seconds,
    end_seconds>>); images have one part without times.  A PDF also gets a row for the document.
    """
    part = items.withColumn("_p", F.explode(F.filter(F.transform("parts", lambda p, i: F.struct(i.alias("n"), p["start_seconds"].alias("a"), p["end_seconds"].alias("b"))), lambda x: x["n"] >= 0)))
    kind, n = F.col("media_kind"), F.col("_p.n")
    mark = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in PART_MARKS.items()], F.lit(""))
    uri = F.when(mark == "", F.col("item_uri")).otherwise(F.concat("item_uri", mark, n.cast("string")))
    timed = kind.isin("video_scene", "audio")
    name = (
        F.when(kind == "video_scene", scene_name(F.col("stem"), "scene", n + 1))
        .when(kind == "audio", scene_name(F.col("stem"), "segment", n + 1))
        .when(kind == "pdf_page", scene_name(F.col("stem"), "page", n + 1))
        .otherwise(F.concat("stem", "extension"))
    )
    rows = part.select(
        uuid5(uri).alias("id"), uri.alias("uri"), F.col("item_uri").alias("source_item_uri"), kind.alias("media_kind"), n.alias("part"), name.alias("filename"),
        F.when(timed, time_fragment(F.col("path"), F.col("_p.a"), F.col("_p.b"))).otherwise(F.col("path")).alias("path"),
    )
    whole = items.where("media_kind = 'pdf_page'").select(
        uuid5(F.concat("item_uri", F.lit("#document"))).alias("id"), F.concat("item_uri", F.lit("#document")).alias("uri"), F.col("item_uri").alias("source_item_uri"),
        F.lit("pdf_document").alias("media_kind"), F.lit(None).cast("int").alias("part"), F.concat("stem", "extension").alias("filename"), "path",
    )
    return rows.unionByName(whole)


def place(media: DataFrame) -> DataFrame:
    """Where a medium is shown: the first thumbnail and the first file address that exist."""
    some = lambda *cols: F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols])
    return media.select(
        "id",
        some("animated_thumbnail_url", "thumbnail_url").alias("thumbnail"),
        some("scene_clip_url", "full_video_url", "full_audio_url", "pdf_page_url", "full_pdf_url", "path").alias("media_url"),
    )


def source_status(sources: DataFrame) -> DataFrame:
    """ready, unavailable, not_implemented or unsupported for (spec, reachable)."""
    scheme = F.lower(F.regexp_extract("spec", r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    known = scheme.isin("", "file", "local", "s3", "s3a", "minio")
    status = (
        F.when(scheme.isin("video", "camera"), "not_implemented")
        .when(~known, "unsupported")
        .when(F.coalesce(F.col("reachable"), F.lit(False)), "ready")
        .otherwise("unavailable")
    )
    return sources.select("spec", status.alias("status"))


def rolled_up(checks: DataFrame) -> DataFrame:
    """One row: not_ready if any check is an error, and how many are ok."""
    bad = F.bool_or(F.col("status") == "error")
    return checks.agg(F.when(bad, "not_ready").otherwise("ready").alias("status"), F.count_if(F.col("status") == "ok").alias("ok"), F.count("*").alias("checks"))


def newest(rows: DataFrame, time: str, id_column: str, count: int = 8) -> DataFrame:
    """The last few rows, the newest first; ties by the higher id."""
    return rows.orderBy(F.desc(time), F.desc(id_column)).limit(count)


def response_parts(results: DataFrame, limit: int = 50) -> DataFrame:
    """Per query part: its hash, the number of results and the results, best first, ``limit`` at most."""
    row = F.struct((-F.col("score")).alias("order"), "id", "score")
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("score"), "id"))
    best = results.withColumn("_n", rank).where(F.col("_n") <= limit)  # each task passes on no more than ``limit`` a part
    return best.groupBy("part").agg(
        F.min("phash").alias("phash"), F.count("*").alias("count"), F.transform(F.sort_array(F.collect_list(row)), lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"))).alias("results")
    )


def first_analysis(parts: DataFrame, by: str, order: str, analysis: str) -> DataFrame:
    """The analysis of the first part that has one."""
    return parts.groupBy(by).agg(F.min_by(analysis, F.when(F.col(analysis).isNotNull(), F.col(order))).alias(analysis))


def client_order(sort: str) -> list[Column]:
    """The seven orders of a result list; missing values last, ties by distance, name and path."""
    first = {
        "captured": F.desc_nulls_last("photo_capture_time_epoch"),
        "filename": F.asc_nulls_last(F.lower("filename")),
        "modified": F.desc_nulls_last("modified_at"),
        "distance": F.asc_nulls_last("phash_distance"),
        "relevance": F.desc_nulls_last("relevance_score"),
        "size": F.desc_nulls_last("size_bytes"),
        "vector": F.desc_nulls_last("vector_score"),
    }
    if sort not in first:
        raise ValueError(f"sort must be one of {', '.join(first)}")
    return [first[sort], F.asc_nulls_last("phash_distance"), F.asc_nulls_last(F.lower("filename")), F.asc_nulls_last(F.lower("relative_path")), F.asc("id")]


def registry_order(rows: DataFrame, counts: list[str], name: str) -> DataFrame:
    return rows.orderBy(*[F.desc(c) for c in counts], F.lower(name), name)


def first_by_content(files: DataFrame, count: int) -> DataFrame:
    """The first files of distinct content (file_id, content), ``count`` at most."""
    w = Window.partitionBy(F.sha2("content", 256)).orderBy("file_id")
    return files.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").orderBy("file_id").limit(count)
