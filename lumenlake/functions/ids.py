"""Deterministic identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the URL namespace of RFC 4122.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


#: Fixed value: the namespace of new people's ids.
PERSON_NAMESPACE = "2f26cf002f654df18a469b0d5fc7e4d3"


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """The version-5 UUID of a name in a namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("long").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )


def group_id(sorted_members: Column) -> Column:
    """A duplicate group's name: it changes when a member comes or goes."""
    whole = F.regexp_replace(uuid5(F.array_join(sorted_members, "\n")), "-", "")
    return F.concat(F.lit("duplicate-"), F.substring(whole, 1, 12))
