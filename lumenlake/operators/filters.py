"""Search filters and album criteria: validated on the driver, one conjunction of columns on the cluster."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenlake.functions.text import any_contains, contains_any
from lumenlake.schema import MEDIA_KINDS

ORIENTATIONS = ("landscape", "portrait", "square")
STATUSES = ("all", "only", "exclude")


def _text(value: str | None) -> str | None:
    value = (value or "").strip()
    return value or None


def _check_range(name: str, low: float | None, high: float | None) -> None:
    for v in (low, high):
        if v is not None and (not math.isfinite(v) or v < 0):
            raise ValueError(f"{name} must be finite and not negative")
    if low is not None and high is not None and low > high:
        raise ValueError(f"{name}: the lower bound exceeds the upper")


@dataclass(frozen=True)
class SearchFilters:
    """Blank texts and the value ``all`` filter nothing; bounds are inclusive."""

    source_type: str | None = None
    media_kind: str | None = None
    has_gps: bool | None = None
    width_min: float | None = None
    width_max: float | None = None
    height_min: float | None = None
    height_max: float | None = None
    size_min: float | None = None
    size_max: float | None = None
    modified_from: float | None = None
    modified_to: float | None = None
    captured_from: float | None = None
    captured_to: float | None = None
    near_duplicates: str = "all"
    orientation: str | None = None
    name: str | None = None
    camera: str | None = None
    keyword: str | None = None
    person_id: str | None = None
    speaker_id: str | None = None
    text: str | None = None

    def __post_init__(self):
        for f in fields(self):
            if f.type == "str | None":
                object.__setattr__(self, f.name, _text(getattr(self, f.name)))
        for name in ("source_type", "media_kind", "orientation"):
            if getattr(self, name) == "all":
                object.__setattr__(self, name, None)
        if self.media_kind is not None and self.media_kind not in MEDIA_KINDS:
            raise ValueError(f"media_kind must be one of {', '.join(MEDIA_KINDS)}")
        if self.orientation is not None and self.orientation not in ORIENTATIONS:
            raise ValueError(f"orientation must be one of {', '.join(ORIENTATIONS)}")
        if self.near_duplicates not in STATUSES:
            raise ValueError(f"near_duplicates must be one of {', '.join(STATUSES)}")
        for name in ("width", "height", "size"):
            _check_range(name, getattr(self, f"{name}_min"), getattr(self, f"{name}_max"))
        for name in ("modified", "captured"):
            _check_range(name, getattr(self, f"{name}_from"), getattr(self, f"{name}_to"))


def bounds(column: Column, low, high) -> list[Column]:
    return [*([column >= low] if low is not None else []), *([column <= high] if high is not None else [])]


def whole_bounds(name: str, low, high) -> list[Column]:
    """Bounds of an integer field as integers, so that no cast of the field keeps them from the scan."""
    whole = lambda x, up: x if x is None else math.ceil(x) if up else math.floor(x)
    return bounds(F.col(name), whole(low, True), whole(high, False))


def conjunction(parts: list[Column]) -> Column:
    """All of the predicates, for ``where``: a null predicate drops the row there, as false does.

    The predicates stay bare, so that those on stored fields reach the Parquet scan.
    """
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def orientation(width: Column, height: Column) -> Column:
    return F.when(width == height, "square").when(width > height, "landscape").otherwise("portrait")


def pushed(f: SearchFilters) -> list[Column]:
    """Equalities and ranges on stored fields, which reach the Parquet scan."""
    out = []
    if f.source_type is not None:
        out.append(F.col("source_type") == f.source_type)
    if f.media_kind is not None:
        out.append(F.col("media_kind") == f.media_kind)
    if f.has_gps is not None:
        out.append(F.col("photo_has_gps") == f.has_gps)
    out += whole_bounds("width", f.width_min, f.width_max)
    out += whole_bounds("height", f.height_min, f.height_max)
    out += whole_bounds("size_bytes", f.size_min, f.size_max)
    out += bounds(F.col("modified_at"), f.modified_from, f.modified_to)
    return out + bounds(F.col("photo_capture_time_epoch"), f.captured_from, f.captured_to)


def name_matches(name: str, album: bool = False) -> Column:
    columns = ["filename", "relative_path", "path", "source_uri", *(["source_item_uri"] if album else [])]
    return contains_any(name, *map(F.col, columns))


def camera_matches(camera: str) -> Column:
    meta = F.col("photo_metadata")
    return contains_any(camera, meta["camera_make"], meta["camera_model"], meta["lens_model"])


def keyword_matches(keyword: str, tags_too: bool = True) -> Column:
    own = any_contains(F.col("photo_metadata.keywords"), keyword)
    return own | any_contains(F.col("tags"), keyword) if tags_too else own


def has_person(person_id: str) -> Column:
    return F.exists("people", lambda p: p["person_id"] == person_id)


def has_speaker(speaker_id: str) -> Column:
    heard = lambda part, key: F.coalesce(F.exists(F.col("audio_analysis")[part], lambda v: v[key] == speaker_id), F.lit(False))
    return heard("recognized_voices", "id") | heard("audio_segments", "speaker_id")


def album_text_matches(text: str) -> Column:
    """Raw lower-case substring of recognised or spoken text, without splitting into terms."""
    audio = F.col("audio_analysis")
    frames = F.transform("ocr_frames", lambda x: x["text"])
    spoken = F.transform(audio["transcript_segments"], lambda x: x["text"])
    return contains_any(text, F.col("ocr_text"), audio["transcript_text"]) | any_contains(frames, text) | any_contains(spoken, text)


def residual(f: SearchFilters, distance: Column | None = None, threshold: int = 8, album: bool = False) -> list[Column]:
    """Predicates that are decided after scoring; without a distance, only near duplicates: none."""
    out = []
    if f.near_duplicates != "all" and not album:
        if distance is None:
            out.append(F.lit(f.near_duplicates == "exclude"))
        else:
            out.append(distance <= threshold if f.near_duplicates == "only" else distance > threshold)
    if f.orientation is not None:
        out.append(orientation(F.col("width"), F.col("height")) == f.orientation)
    if f.name is not None:
        out.append(name_matches(f.name, album))
    if f.camera is not None:
        out.append(camera_matches(f.camera))
    if f.keyword is not None:
        out.append(keyword_matches(f.keyword))
    if f.person_id is not None:
        out.append(has_person(f.person_id))
    if f.speaker_id is not None:
        out.append(has_speaker(f.speaker_id))
    if f.text is not None and album:
        out.append(album_text_matches(f.text))
    return out


def same_size_time_profile(size: Column, size2: Column, mtime: Column, mtime2: Column, profile: Column, profile2: Column) -> Column:
    """A stored record describes a file as it is now: equal size and profile, times within a millisecond."""
    return F.coalesce((size == size2) & (F.abs(mtime - mtime2) <= 0.001) & (profile == profile2), F.lit(False))


def analysis_complete(
    kind: Column, scene_index: Column, scene_start: Column, scene_end: Column, audio: Column, transcription: bool
) -> Column:
    """Whether nothing is left to analyse: a scene has its number and bounds, and with transcription on
    audio has an analysis, and detected speech in audio and scenes a transcript."""
    placed = (kind != "video_scene") | (scene_index.isNotNull() & scene_start.isNotNull() & scene_end.isNotNull())
    if not transcription:
        return F.coalesce(placed, F.lit(True))
    blank = F.coalesce(F.trim(audio["transcript_text"]), F.lit("")) == ""
    silent = F.when(audio.isNull(), kind == "video_scene").otherwise(~(F.coalesce(audio["speech_detected"], F.lit(False)) & blank))
    return F.coalesce(placed & (~kind.isin("audio", "video_scene") | silent), F.lit(True))


def client_bounds(day_from: str | None, day_to: str | None, time: Column) -> list[Column]:
    """Bounds of a time in seconds by days of the session's zone: from midnight to the last millisecond; a bad day bounds nothing."""

    def midnight(day: str | None) -> date | None:
        try:
            return date.fromisoformat((day or "").strip())
        except ValueError:
            return None

    first, last = midnight(day_from), midnight(day_to)
    start = lambda d: F.unix_micros(F.lit(f"{d.isoformat()} 00:00:00").cast("timestamp")) / F.lit(1e6)
    return [
        *([time >= start(first)] if first else []),
        *([time <= start(last + timedelta(days=1)) - F.lit(0.001)] if last else []),
    ]


def positive(text: str | None) -> float | None:
    """The number that a field holds if it is above zero, else no bound."""
    try:
        value = float((text or "").strip())
    except ValueError:
        return None
    return value if math.isfinite(value) and value > 0 else None


def client_filters(fields_: dict[str, str]) -> list[Column]:
    """A result list's own filters, from text fields: sizes in MB, days of the session's zone, positive numbers only.

    Keys are those of a result page: min_width, max_width, min_height, max_height, min_size_mb, max_size_mb,
    capture_from, capture_to, date_from, date_to, and has_gps, which is yes, no or all.
    """
    get = fields_.get
    megabytes = lambda name: None if (mb := positive(get(name))) is None else mb * 1024 * 1024
    out = [
        *whole_bounds("width", positive(get("min_width")), positive(get("max_width"))),
        *whole_bounds("height", positive(get("min_height")), positive(get("max_height"))),
        *whole_bounds("size_bytes", megabytes("min_size_mb"), megabytes("max_size_mb")),
        *client_bounds(get("capture_from"), get("capture_to"), F.col("photo_capture_time_epoch")),
        *client_bounds(get("date_from"), get("date_to"), F.col("modified_at")),
    ]
    if get("has_gps") in ("yes", "no"):
        out.append(F.col("photo_has_gps") == (get("has_gps") == "yes"))
    return out
