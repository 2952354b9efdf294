"""Times, intervals and sampling positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def rfc3339_epoch(s: Column) -> Column:
    """Seconds since 1970 of a full date, time and offset; null for anything less."""
    plain = F.regexp_replace(F.regexp_replace(F.upper(s), " ", "T"), "Z$", "+00:00")
    return F.when(s.rlike(RFC3339), F.unix_micros(F.try_to_timestamp(plain)) / F.lit(1e6))


def overlaps(start: Column, end: Column, window_start: Column, window_end: Column) -> Column:
    """Strict overlap with a window; an open end of the segment matches by the other end alone."""
    return (
        F.when(start.isNull() & end.isNull(), F.lit(True))
        .when(end.isNull(), start < window_end)
        .when(start.isNull(), end > window_start)
        .otherwise(F.least(end, window_end) - F.greatest(start, window_start) > 0)
    )


def overlap_seconds(spans: Column, start: Column, end: Column) -> Column:
    """Seconds of an array of spans inside a window."""
    return F.aggregate(
        spans,
        F.lit(0.0),
        lambda acc, s: acc + F.greatest(F.lit(0.0), F.least(s["end_seconds"], end) - F.greatest(s["start_seconds"], start)),
    )


def speech_ratio(spans: Column, duration: Column) -> Column:
    total = F.aggregate(spans, F.lit(0.0), lambda acc, s: acc + F.greatest(F.lit(0.0), s["end_seconds"] - s["start_seconds"]))
    return F.when(duration > 0, F.least(F.lit(1.0), total / duration)).otherwise(F.lit(0.0))


def points_inside(points: Column, start: Column, end: Column) -> Column:
    return F.size(F.filter(points, lambda p: (p >= start) & (p < end)))


def even_sample(items: Column, limit: int) -> Column:
    """At most ``limit`` elements at evenly spread positions, ends included."""
    last = F.size(items) - 1
    if limit == 1:
        return F.slice(items, 1, 1)
    at = lambda i: F.try_element_at(items, (F.floor((i * last + F.lit((limit - 1) // 2)) / F.lit(limit - 1)) + 1).cast("int"))
    return F.when(F.size(items) <= limit, items).otherwise(F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), at))


def total_delay_ms(delays: Column, default_ms: int = 100) -> Column:
    return F.aggregate(delays, F.lit(0).cast("long"), lambda acc, d: acc + F.when(F.coalesce(d, F.lit(0)) > 0, d).otherwise(default_ms))


def dms_to_decimal(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    value = degrees + minutes / 60.0 + seconds / 3600.0
    return F.when(F.upper(ref).isin("S", "W"), -value).otherwise(value)


def thinned(times: Column, apart: float) -> Column:
    """Sorted times without those less than ``apart`` after the last one kept."""
    return F.aggregate(
        F.array_sort(times),
        F.array().cast("array<double>"),
        lambda acc, x: F.when(
            (F.size(acc) == 0) | (x - F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) >= apart),
            F.array_append(acc, x),
        ).otherwise(acc),
    )


def speech_boundaries(duration: Column, speech: Column, onsets: Column, gap: float = 8.0, apart: float = 0.25) -> Column:
    """Cut points of an audio file: 0, its length, starts and ends of speech, and onsets a gap apart, thinned out.

    Both thinnings depend on the last point kept, so they are folds.
    """
    kept = F.aggregate(
        F.array_sort(F.filter(onsets, lambda o: (o > 0) & (o < duration))),
        F.array().cast("array<double>"),
        lambda acc, o: F.when(
            o - F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) >= gap, F.array_append(acc, o)
        ).otherwise(acc),
    )
    inside = lambda x: F.greatest(F.lit(0.0), F.least(duration, x))
    starts = F.transform(speech, lambda s: inside(s["start_seconds"]))
    ends = F.transform(speech, lambda s: inside(s["end_seconds"]))
    return thinned(F.concat(F.array(F.lit(0.0), duration), starts, ends, kept), apart)


def frame_delay_ms(fps: Column, default_ms: int = 100) -> Column:
    """Milliseconds a frame lasts at a rate, at least 1; the default for a rate that is none."""
    return F.when((fps > 0) & (fps < F.lit(float("inf"))), F.greatest(F.lit(1), F.round(F.lit(1000.0) / fps).cast("int"))).otherwise(default_ms)


def seconds_to_ms(seconds: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), seconds) * 1000).cast("long")


def rational(s: Column) -> Column:
    """A number, or a quotient ``a/b``; null for anything else and for a zero divisor."""
    number = r"[+-]?\d+(?:\.\d+)?"
    top = F.regexp_extract(s, rf"^\s*({number})\s*(?:/\s*{number}\s*)?$", 1).try_cast("double")
    below = F.regexp_extract(s, rf"^\s*{number}\s*/\s*({number})\s*$", 1)
    divisor = F.when(below == "", F.lit(1.0)).otherwise(below.try_cast("double"))
    return F.when(divisor != 0, top / divisor)


def dms_text_to_decimal(s: Column, ref: Column) -> Column:
    """Degrees, minutes and seconds as numbers or quotients, parted by spaces, commas or marks."""
    parts = F.transform(F.filter(F.split(s, "[\\s,;°'\"]+"), lambda x: x != ""), rational)
    at = lambda n: F.coalesce(F.try_element_at(parts, F.lit(n)), F.lit(0.0))
    return F.when(F.size(parts).between(1, 3) & ~F.exists(parts, lambda x: x.isNull()), dms_to_decimal(at(1), at(2), at(3), ref))


def lenient_epoch(s: Column) -> Column:
    """Seconds since 1970 of a full time, or of a time or date without an offset in the session's zone; else null."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(s), r"^(\d{4}):(\d{2}):(\d{2})", "$1-$2-$3"), "[Tt]", " ")
    local = plain.rlike(r"^\d{4}-\d{2}-\d{2}( \d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$")
    return F.coalesce(rfc3339_epoch(F.trim(s)), F.when(local, F.unix_micros(F.try_to_timestamp(plain)) / F.lit(1e6)))
