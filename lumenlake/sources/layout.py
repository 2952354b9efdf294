"""Files laid out so that filters on several fields read few of them.

Rows are put in the order of interleaved bits of their fields (the first bit of each field, then the second of
each, ...), so rows that are close in every field are close in the files, and each file and row group has narrow
bounds in all of them.  A field's bits are its place among quantiles of the field, so skewed values are
spread; texts are placed by a hash, so equal ones are together.  Fields that are searched by equality can have Bloom
filters, which Parquet keeps by row group.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def interleaved(df: DataFrame, fields: list[str], bits: int = 6) -> tuple[DataFrame, Column]:
    """``df`` with a place per field (_at0, _at1, ...), and the number of their interleaved bits.  Nulls come first."""
    kinds = {f.name: f.dataType for f in df.schema}
    steps = 1 << bits
    numbers = [f for f in fields if isinstance(kinds[f], (T.NumericType, T.BooleanType))]
    doubles = df.select(*[F.col(f"`{f}`").cast("double").alias(f) for f in numbers])
    cuts = doubles.approxQuantile(numbers, [i / steps for i in range(1, steps)], 1 / (4 * steps)) if numbers else []  # ``steps`` numbers a field
    by_field = dict(zip(numbers, cuts))
    for i, f in enumerate(fields):
        if f in by_field:
            edges = sorted(set(by_field[f]))
            value = F.col(f"`{f}`").cast("double")
            df = df.withColumn("_in", F.when(~F.isnan(value), value))
            if edges:
                splits = [float("-inf"), *edges, float("inf")]
                df = Bucketizer(splits=splits, inputCol="_in", outputCol="_out", handleInvalid="keep").transform(df)
                df = df.withColumn(f"_at{i}", F.when(F.col("_in").isNull(), 0).otherwise(F.least(F.col("_out").cast("int"), F.lit(steps - 1)))).drop("_in", "_out")
            else:
                df = df.withColumn(f"_at{i}", F.lit(0)).drop("_in")
        else:
            text = F.col(f"`{f}`").cast("string")
            df = df.withColumn(f"_at{i}", F.when(text.isNull(), 0).otherwise(F.pmod(F.xxhash64(text), F.lit(steps)).cast("int")))
    z = F.lit(0).cast("long")
    for bit in range(bits):
        for i in range(len(fields)):
            one = F.shiftright(F.col(f"_at{i}"), bit).bitwiseAND(F.lit(1)).cast("long")
            z = z.bitwiseOR(F.shiftleft(one, bit * len(fields) + len(fields) - 1 - i))
    return df, z


def write_clustered(df: DataFrame, path: str, fields: list[str], files: int, bloom: tuple[str, ...] = (), bits: int = 6, group_bytes: int = 32 << 20) -> None:
    """Write ``df`` to Parquet files in the order of the fields' interleaved bits (63 at most)."""
    if not 0 < len(fields) * bits <= 63:
        raise ValueError("1 to 63 bits can be interleaved")
    placed, z = interleaved(df, fields, bits)
    ordered = placed.withColumn("_z", z).repartitionByRange(files, "_z", F.xxhash64(*[F.col(f"`{c}`") for c in fields]))
    writer = ordered.sortWithinPartitions("_z").select(*[F.col(f"`{c}`") for c in df.columns]).write.option("parquet.block.size", group_bytes)
    for f in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{f}", "true")
    writer.parquet(path)
