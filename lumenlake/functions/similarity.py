"""Distances and scores as Catalyst expressions, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def cosine_to(a: Column, query: list[float]) -> Column:
    """Cosine to a constant vector whose norm is folded on the driver."""
    length = sum(x * x for x in query) ** 0.5
    unit = [x / length if length else 0.0 for x in query]
    size = norm(a)
    return F.when(size == 0, 0.0).otherwise(dot(a, F.array(*[F.lit(float(x)) for x in unit])) / size)


def valid_phash(h: Column) -> Column:
    return F.coalesce(h.rlike("^[0-9a-fA-F]{16}$"), F.lit(False))


def phash_halves(h: Column) -> tuple[Column, Column]:
    """The high and low 32 bits of a 16-digit hash; a cast of all 64 would overflow."""
    half = lambda at: F.conv(F.substring(h, at, 8), 16, 10).cast("long")
    return F.when(valid_phash(h), half(1)), F.when(valid_phash(h), half(9))


def hamming(hi1: Column, lo1: Column, hi2: Column, lo2: Column) -> Column:
    return F.bit_count(hi1.bitwiseXOR(hi2)) + F.bit_count(lo1.bitwiseXOR(lo2))


def hamming_hex(a: Column, b: Column) -> Column:
    """Null where either hash is not 16 hexadecimal digits."""
    return hamming(*phash_halves(a), *phash_halves(b))


def relevance(score: Column, distance: Column, threshold: int) -> Column:
    """Near duplicates rank above every other result, closer ones first."""
    near = F.lit(2.0) + (F.lit(threshold) - distance + 1) / F.lit(threshold + 1.0)
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    return F.when(distance.isNull() | (distance > threshold), score).otherwise(near + bounded * 0.01)


def weighted_mean(vectors: Column, weights: Column, width: int) -> Column:
    """The weighted sum of an array of vectors, scaled to length 1 (zeros stay zeros)."""
    zero = F.array_repeat(F.lit(0.0), width)
    total = F.aggregate(
        F.arrays_zip(vectors.alias("v"), weights.alias("w")),
        zero,
        lambda acc, x: F.zip_with(acc, x["v"], lambda a, y: a + y * x["w"]),
    )
    size = norm(total)
    return F.when(size == 0, total).otherwise(F.transform(total, lambda x: x / size))
