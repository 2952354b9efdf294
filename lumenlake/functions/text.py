"""Text normalisation, matching and formatting."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse_whitespace(s: Column) -> Column:
    """Runs of any Unicode white space become one space; none at either end."""
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def blank_to_null(s: Column) -> Column:
    return F.nullif(F.trim(s), F.lit(""))


def contains_any(needle: str, *columns: Column) -> Column:
    """Case-insensitive substring of at least one column; nulls don't match."""
    text = needle.lower()
    return F.exists(F.array(*columns), lambda x: F.coalesce(F.contains(F.lower(x), F.lit(text)), F.lit(False)))


def any_contains(items: Column, needle: str) -> Column:
    """Case-insensitive substring of at least one element of an array of strings."""
    return F.coalesce(F.exists(items, lambda x: F.coalesce(F.contains(F.lower(x), F.lit(needle.lower())), F.lit(False))), F.lit(False))


def match_score(query: str, text: Column) -> Column:
    """1 if the text holds the query, or all its distinct terms, as substrings; else null.

    A blank query scores 0.  There is no partial credit.  A text that holds the whole query holds all
    its terms, and a term has no white space, so the terms in the text as it is decide.
    """
    if not query.split():
        return F.lit(0.0)
    return F.when(holds_terms(query, text), F.lit(1.0))


def holds_terms(query: str, text: Column) -> Column:
    """Whether all terms of a query are substrings of the text, whatever their case; null for a null text."""
    lowered = F.lower(text)
    return reduce(lambda a, b: a & b, [F.contains(lowered, F.lit(t)) for t in dict.fromkeys(query.lower().split())])


def keep_first(items: Column, key: Callable[[Column], Column] = F.lower) -> Column:
    """Distinct elements by key, keeping the first of each, in order."""
    return F.aggregate(
        items,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(F.exists(acc, lambda y: key(y) == key(x)), acc).otherwise(F.array_append(acc, x)),
    )


def normalise_tags(tags: Column, most: int = 64, longest: int = 80) -> Column:
    trimmed = F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: (t != "") & (F.length(t) <= longest))
    return F.slice(keep_first(trimmed), 1, most)


def split_keywords(text: Column) -> Column:
    parts = F.transform(F.split(text, "[,;|]"), lambda p: F.trim(p))
    return keep_first(F.filter(parts, lambda p: p != ""))


def ocr_text(frames: Column) -> Column:
    """Frame texts: normalised, without blanks and case-insensitive repeats, joined by spaces."""
    clean = F.filter(F.transform(frames, collapse_whitespace), lambda t: t.isNotNull() & (t != ""))
    return F.array_join(keep_first(clean), " ")


def merge_page_text(native: Column, ocr: Column) -> Column:
    """A page's own text, with the recognised text after it unless that is part of it."""
    a = F.coalesce(collapse_whitespace(native), F.lit(""))
    b = F.coalesce(collapse_whitespace(ocr), F.lit(""))
    return F.when((b == "") | F.contains(F.lower(a), F.lower(b)), a).when(a == "", b).otherwise(F.concat(a, F.lit(" "), b))


def before_fragment(uri: Column) -> Column:
    return F.split_part(uri, F.lit("#"), F.lit(1))


def scene_name(stem: Column, kind: str, number: Column) -> Column:
    return F.format_string(f"%s {kind} %03d", stem, number.cast("int"))


def time_fragment(path: Column, start: Column, end: Column) -> Column:
    return F.format_string("%s#t=%.3f,%.3f", path, start.cast("double"), end.cast("double"))


def file_size(size_bytes: Column) -> Column:
    """B, KB, MB or GB with one decimal from KB on."""
    b = size_bytes.cast("double")
    one = lambda unit, name: F.format_string(f"%.1f {name}", b / unit)
    return (
        F.when(b < 1024, F.format_string("%d B", size_bytes.cast("long")))
        .when(b < 1024**2, one(1024.0, "KB"))
        .when(b < 1024**3, one(1024.0**2, "MB"))
        .otherwise(one(1024.0**3, "GB"))
    )


def compact_list(items: Column, shown: int = 4) -> Column:
    """The first few items, and how many more there are."""
    more = F.size(items) - shown
    head = F.array_join(F.slice(items, 1, shown), ", ")
    return F.when(more > 0, F.concat(head, F.lit(" +"), more.cast("string"))).otherwise(head)


def plain_key(s: Column) -> Column:
    return F.lower(F.regexp_replace(s, "[^A-Za-z0-9]", ""))


def json_field(json: Column, path: str, kind: str) -> Column:
    """A field of a JSON text by its path; null if it is missing or of another type."""
    return F.get_json_object(json, path).try_cast(kind)


def unescape_xml(s: Column) -> Column:
    """The five named entities of XML as characters; the ampersand last, so that nothing is unescaped twice."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        s = F.replace(s, F.lit(f"&{name};"), F.lit(char))
    return s


def duration_text(milliseconds: Column) -> Column:
    """Seconds with one decimal below a minute, else minutes and seconds."""
    seconds = milliseconds / F.lit(1000.0)
    whole = F.round(seconds).cast("long")
    long = F.format_string("%d:%02d", F.floor(whole / 60), whole % 60)
    return F.when(seconds < 60, F.format_string("%.1fs", seconds)).otherwise(long)


def percent_text(ratio: Column) -> Column:
    return F.format_string("%d%%", F.round(ratio * 100).cast("long"))


def gps_text(latitude: Column, longitude: Column) -> Column:
    return F.when(latitude.isNotNull() & longitude.isNotNull(), F.format_string("%.5f, %.5f", latitude, longitude))


def camera_label(make: Column, model: Column) -> Column:
    """Make and model, the make only once if the model begins with it; null if both are blank."""
    a, b = F.coalesce(F.trim(make), F.lit("")), F.coalesce(F.trim(model), F.lit(""))
    named = F.when(F.startswith(F.lower(b), F.lower(a)), b).otherwise(F.trim(F.concat(a, F.lit(" "), b)))
    return F.nullif(named, F.lit(""))
