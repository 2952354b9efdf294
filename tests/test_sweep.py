"""Sorted sweeps against products."""

import random

import pytest
from pyspark.sql import functions as F

from lumenlake.operators import segments, sweep


def spans(rng, n, keys=(1, 2, None)):
    out = []
    for i in range(n):
        a = rng.choice([None, *range(-5, 60)])
        out.append((rng.choice(keys), i, a, None if a is None or rng.random() < 0.05 else a + rng.choice([-3, 0, 1, 2, 7, 30])))
    return out


@pytest.mark.parametrize("seed,parts", [(1, 4), (2, 1), (3, 9)])
def test_points_and_segments_match_products(spark, seed, parts):
    rng = random.Random(seed)
    scenes = spans(rng, 60)
    frames = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *range(-8, 95)]), i) for i in range(300)]
    s = spark.createDataFrame(scenes, "video_id long, scene long, start long, end long")
    f = spark.createDataFrame(frames, "video_id long, frame long, kind long")  # a column named like one of the sweep's own
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = sorted((r.kind, r.scene) for r in sweep.covered(f, s, "video_id", "frame", "start", "end").collect())
        segs = spark.createDataFrame([(k, i, None if a is None else a + 0.5, None if b is None else b + 0.25) for k, i, a, b in spans(rng, 80)], "key long, piece long, start double, end double")
        wins = s.selectExpr("video_id AS key", "scene AS w", "cast(start AS double) AS window_start", "cast(end AS double) AS window_end")
        wins = wins.where("window_start IS NOT NULL AND window_end IS NOT NULL")
        ways = [sorted(map(str, segments.join_overlapping(segs, wins, "key", swept=swept).collect())) for swept in (False, True)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    want = [(i, scene) for v, at, i in frames for k, scene, a, b in scenes if None not in (v, at, a, b) and v == k and a <= at < b]
    assert got == sorted(want) and want
    assert ways[0] == ways[1] and ways[0]


def test_one_long_video_is_no_product(spark):
    n = 60_000
    frames = spark.range(n).select(F.lit("v").alias("video_id"), F.col("id").alias("frame"))
    scenes = spark.range(n // 10).select(F.lit("v").alias("video_id"), F.col("id").alias("scene"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 10).alias("end"))
    swept = sweep.covered(frames, scenes, "video_id", "frame", "start", "end")
    assert swept.where("frame - start BETWEEN 0 AND 9").count() == n == swept.count()
    assert segments.scene_frames(frames, scenes, 4, 2).count() == 2 * (n // 10)


def test_empty_sides(spark):
    frames = spark.createDataFrame([], "video_id long, frame long")
    scenes = spark.createDataFrame([(1, 1, 0, 5)], "video_id long, scene long, start long, end long")
    assert segments.scene_frames(frames, scenes, 1, 1).collect() == []
    assert segments.scene_frames(spark.createDataFrame([(1, 2)], frames.schema), scenes.where("start > 9"), 1, 1).collect() == []


@pytest.mark.parametrize("bounds", [(100_000, 64), (90, 1_000), (0, 0), (1_000, 15)])
def test_few_points_and_spans_meet_without_a_sweep(spark, monkeypatch, bounds):
    monkeypatch.setattr(sweep, "POINTS", bounds[0])
    monkeypatch.setattr(sweep, "SPANS", bounds[1])
    swept, sort = [], sweep.carried_last
    monkeypatch.setattr(sweep, "carried_last", lambda *a: swept.append(a) or sort(*a))
    rng = random.Random(5)
    scenes = spans(rng, 60)
    frames = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *range(-8, 95)]), i) for i in range(300)]
    s = spark.createDataFrame([*scenes, scenes[0]], "video_id long, scene long, start long, end long")
    f = spark.createDataFrame(frames, "video_id long, frame long, kind long")
    found = sweep.covered(f, s, "video_id", "frame", "start", "end")
    want = [(v, at, i, scene, a, b) for v, at, i in frames for k, scene, a, b in [*scenes, scenes[0]] if None not in (v, at, a, b) and v == k and a <= at < b]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want) and want
    assert found.columns == ["video_id", "frame", "kind", "scene", "start", "end"] and bool(swept) == (bounds != (100_000, 64))
