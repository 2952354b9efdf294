"""Clustered files: the same rows, and how much a filter reads."""

import random

import pyarrow.parquet as pq
import pytest

from lumenlake.sources import layout

SCHEMA = "id long, width int, size long, kind string, taken double, name string"


def rows(n=6_000):
    rng = random.Random(1)
    return [
        (i, rng.choice([None, *range(100, 4_000, 7)]), int(rng.expovariate(1e-6)), rng.choice(["image", "video", "audio", None]), rng.choice([None, float("nan"), rng.uniform(0, 1e9)]), f"{rng.getrandbits(64):016x}")
        for i in range(n)
    ]


def files_within(path, field, low, high):
    """Files one of whose row groups can hold a value of the field in the range."""
    out = 0
    for p in path.glob("*.parquet"):
        meta = pq.ParquetFile(p).metadata
        at = meta.schema.names.index(field)
        stats = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
        out += any(s is None or not s.has_min_max or (s.min <= high and s.max >= low) for s in stats)
    return out


def scanned(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    return plan.collectLeaves().head().metrics().apply("numOutputRows").value()


def test_filters_read_few_files_and_all_rows_are_there(spark, tmp_path):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    df.repartition(32).write.parquet(str(tmp_path / "plain"))
    layout.write_clustered(df, str(tmp_path / "z"), ["width", "size", "kind"], files=32, bloom=("name",))
    z = spark.read.parquet(str(tmp_path / "z"))
    assert sorted(map(str, z.collect())) == sorted(map(str, df.collect())) and z.columns == df.columns
    few = {f: (files_within(tmp_path / "plain", f, a, b), files_within(tmp_path / "z", f, a, b)) for f, a, b in (("width", 3_000, 3_200), ("size", 0, 50_000))}
    assert all(plain == 32 and clustered <= 20 for plain, clustered in few.values())
    # both fields at once: a file must be in both ranges
    picked = z.where("width BETWEEN 3000 AND 3200 AND size < 50000")
    assert picked.count() == sum(r[1] is not None and 3_000 <= r[1] <= 3_200 and r[2] < 50_000 for r in data)
    plain = spark.read.parquet(str(tmp_path / "plain")).where("width BETWEEN 3000 AND 3200 AND size < 50000")
    assert scanned(picked) * 3 < scanned(plain) <= len(data)


def test_bloom_filters_find_the_row_group(spark, tmp_path):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    for name, bloom in (("with", ("name",)), ("without", ())):
        layout.write_clustered(df, str(tmp_path / name), ["width"], files=16, bloom=bloom)
    read = {n: scanned(spark.read.parquet(str(tmp_path / n)).where(f"name = '{data[17][5]}'")) for n in ("with", "without")}
    assert read["with"] * 4 < read["without"]
    assert spark.read.parquet(str(tmp_path / "with")).where(f"name = '{data[17][5]}'").count() == 1


def test_edges(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    layout.write_clustered(df, str(tmp_path / "none"), ["width", "kind"], files=2)
    same = spark.createDataFrame([(1, None, 5, None, None, "a")] * 50, SCHEMA)
    layout.write_clustered(same, str(tmp_path / "same"), ["width", "size", "kind", "taken"], files=2)
    assert spark.read.parquet(str(tmp_path / "same")).count() == 50
    with pytest.raises(ValueError):
        layout.write_clustered(same, str(tmp_path / "x"), ["width"] * 20, files=2)
