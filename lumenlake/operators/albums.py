"""Smart albums: saved criteria with a sort and pages, and the total before paging."""

from __future__ import annotations

import json
import posixpath
import unicodedata
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.operators.duplicates import only_duplicates, with_group, without_duplicates
from lumenlake.operators.filters import SearchFilters, conjunction, pushed, residual
from lumenlake.operators.order import numbered

SORTS = ("captured_newest", "duplicate_group_size", "filename", "modified_newest", "size_largest")


def album_order(sort: str) -> list[Column]:
    """A total order: every sort ends with file name and id."""
    first = {
        "captured_newest": F.desc(F.floor(F.coalesce("photo_capture_time_epoch", F.lit(0.0)))),
        "duplicate_group_size": F.desc("duplicate_group_size"),
        "filename": F.asc(F.lower("filename")),
        "modified_newest": F.desc("modified_at"),
        "size_largest": F.desc("size_bytes"),
    }
    if sort not in first:
        raise ValueError(f"sort must be one of {', '.join(SORTS)}")
    return [first[sort], *([] if sort == "filename" else [F.asc("filename")]), F.asc("id")]


def matching(media: DataFrame, criteria: SearchFilters, members: DataFrame | None = None) -> DataFrame:
    """The rows of an album; ``members``, the table of classes, is needed for duplicate criteria only."""
    rows = media.where(conjunction([*pushed(criteria), *residual(criteria, album=True)]))
    if criteria.near_duplicates == "all":
        return rows
    if members is None:
        raise ValueError("duplicate criteria need the table of classes")
    return (only_duplicates if criteria.near_duplicates == "only" else without_duplicates)(rows, members)


def page(rows: DataFrame, sort: str, offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*album_order(sort)).offset(max(0, offset)).limit(min(max(limit, 1), 500))


class PageDirectory:
    """An album in its order, in blocks of places: a page at any depth reads the block or two that it is in.

    `build` sorts the album once (a range shuffle), numbers its rows and writes a folder for each ``block`` places;
    it is to be built anew when the album changes.  `page` needs no sort and no count, however deep.
    """

    def __init__(self, spark: SparkSession, path: str, block: int = 10_000):
        self.spark, self.path, self.block = spark, path, block

    def build(self, rows: DataFrame, sort: str) -> None:
        """``rows`` are those of `matching`, with their groups' sizes for the sort by them."""
        placed = numbered(rows, [], album_order(sort), "_place")
        blocks = placed.withColumn("_block", F.floor(F.col("_place") / self.block))
        blocks.hint("rebalance", "_block").write.partitionBy("_block").parquet(posixpath.join(self.path, "rows"))
        self.rows().groupBy().agg(F.count("*").alias("total")).write.parquet(posixpath.join(self.path, "total"))

    def rows(self) -> DataFrame:
        """All rows with their places (_place)."""
        return self.spark.read.parquet(posixpath.join(self.path, "rows")).drop("_block")

    def total(self) -> DataFrame:
        return self.spark.read.parquet(posixpath.join(self.path, "total"))

    def page(self, offset: int, limit: int) -> DataFrame:
        first, limit = max(0, offset), min(max(limit, 1), 500)
        every = self.spark.read.parquet(posixpath.join(self.path, "rows"))
        inside = every.where(F.col("_block").isin(list(range(first // self.block, (first + limit - 1) // self.block + 1))))
        return inside.where((F.col("_place") >= first) & (F.col("_place") < first + limit)).orderBy("_place").drop("_block", "_place")


def album_results(
    media: DataFrame, criteria: SearchFilters, members: DataFrame | None = None, sort: str = "captured_newest", offset: int = 0, limit: int = 60
) -> tuple[DataFrame, DataFrame]:
    """The page, and the number of all matching rows as one row (total).

    With ``members`` the page has each row's class and its size.  Only the sort by size joins them
    to all matching rows; other sorts are paged first, and the page, 500 rows at most, is joined.
    """
    rows = matching(media, criteria, members)
    total = rows.agg(F.count("*").alias("total"))
    if sort == "duplicate_group_size":
        if members is None:
            raise ValueError("the sort by group size needs the table of classes")
        return page(with_group(rows, members), sort, offset, limit), total
    found = page(rows, sort, offset, limit)
    if members is not None:
        found = with_group(found, members).orderBy(*album_order(sort))
    return found, total


#: The longest texts of an album.
TEXT_LIMITS = {
    "name": 80, "description": 500, "source_type": 80, "name_query": 160, "camera_query": 160, "keyword_query": 160,
    "text_query": 240, "person_id": 120, "speaker_id": 120,
}


def checked_text(field: str, value: str | None) -> str | None:
    """A text without white space around it; None if nothing is left."""
    value = (value or "").strip()
    if any(unicodedata.category(c) == "Cc" for c in value):
        raise ValueError(f"{field} cannot contain control characters")
    if len(value) > TEXT_LIMITS[field]:
        raise ValueError(f"{field} must be {TEXT_LIMITS[field]} characters or fewer")
    return value or None


@dataclass(frozen=True)
class SmartAlbum:
    """An album as it is saved: checked when it is made."""

    name: str
    criteria: SearchFilters = field(default_factory=SearchFilters)
    description: str | None = None
    sort: str = "captured_newest"
    limit: int = 60

    def __post_init__(self):
        c = self.criteria
        texts = {"source_type": c.source_type, "name_query": c.name, "camera_query": c.camera, "keyword_query": c.keyword, "text_query": c.text, "person_id": c.person_id, "speaker_id": c.speaker_id}
        for name, value in texts.items():
            checked_text(name, value)
        name = checked_text("name", self.name)
        if name is None:
            raise ValueError("name is required")
        object.__setattr__(self, "name", name)
        object.__setattr__(self, "description", checked_text("description", self.description))
        if not 1 <= self.limit <= 500:
            raise ValueError("limit must be between 1 and 500")
        album_order(self.sort)

    def results(self, media: DataFrame, members: DataFrame | None = None, offset: int = 0) -> tuple[DataFrame, DataFrame]:
        return album_results(media, self.criteria, members, self.sort, offset, self.limit)


def load_albums(text: str | None) -> list[SmartAlbum]:
    """Albums of a JSON file's text, ``{"albums": [...]}``; none of a file that is missing or blank.

    An album is an object of name, description, sort, limit and criteria (names of `SearchFilters`); unknown fields are ignored.
    """
    if not (text or "").strip():
        return []
    own, known = ({f.name for f in fields(c)} for c in (SmartAlbum, SearchFilters))
    out = []
    for album in json.loads(text)["albums"]:
        criteria = SearchFilters(**{k: v for k, v in (album.get("criteria") or {}).items() if k in known})
        out.append(SmartAlbum(**{k: v for k, v in album.items() if k in own and k != "criteria"}, criteria=criteria))
    return out
