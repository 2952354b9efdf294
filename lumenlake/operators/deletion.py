"""Deletion of media with the faces and generated files that belong to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.functions.text import before_fragment


def matching_media(media: DataFrame, media_id=None, source_uri=None, source_item_uri=None) -> DataFrame:
    given = {"id": media_id, "source_uri": source_uri, "source_item_uri": source_item_uri}
    wanted = {k: v for k, v in given.items() if v is not None}
    if not wanted:
        raise ValueError("at least one of media_id, source_uri and source_item_uri is needed")
    for k, v in wanted.items():
        media = media.where(F.col(k) == v)
    return media


def cascade(media: DataFrame, faces: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Media and faces that remain after the doomed media (id) are gone."""
    gone = doomed.select("id").distinct()
    return (
        media.join(gone, "id", "left_anti"),
        faces.join(gone.withColumnRenamed("id", "media_id"), "media_id", "left_anti"),
    )


def deleted_points(faces: DataFrame, doomed: DataFrame) -> DataFrame:
    """(point_id): the doomed media and their faces, each once."""
    gone = doomed.select("id").distinct()
    own = faces.join(gone.withColumnRenamed("id", "media_id"), "media_id", "left_semi")
    return gone.select(F.col("id").cast("string").alias("point_id")).union(own.select(F.col("face_id").cast("string"))).distinct()


def artifact_manifest(*named: tuple[str, Column]) -> Column:
    """(kind, url) of the generated files that exist, without fragments."""
    rows = F.array(*[F.struct(F.lit(kind).alias("kind"), before_fragment(url).alias("url")) for kind, url in named])
    return F.filter(rows, lambda a: a["url"].isNotNull() & (F.trim(a["url"]) != ""))


def safe_artifacts(urls: DataFrame, root: str) -> DataFrame:
    """Distinct relative files below ``root``; paths that climb out of it are refused."""
    path = before_fragment(F.col("url"))
    inside = F.startswith(path, F.lit(root)) & ~F.array_contains(F.split(path, "/"), "..")
    return urls.where(inside).select(F.substr(path, F.lit(len(root) + 1)).alias("file")).distinct()
