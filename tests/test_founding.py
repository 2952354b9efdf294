"""Founding in rounds against the plain fold."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.operators import faces, founding, order, voices


def plain(rows, least):
    """{(group, id, at): (founder, score)} by a loop over sorted rows of one length each."""
    founders, out = {}, []
    for g, i, v in rows:
        if v is None or any(e is None or not math.isfinite(e) for e in v):
            out.append((g, i, None, None))
            continue
        x = founding.units([v])[0]
        own = founders.setdefault((g, len(v)), [])
        best = max(((float((x * f).sum()), -k) for k, (_, f) in enumerate(own)), default=(-2.0, 0))
        if best[0] >= least:
            out.append((g, i, own[-best[1]][0], round(best[0], 9)))
        else:
            own.append((i, x))
            out.append((g, i, i, 1.0))
    return sorted(out, key=str)


def people(n, width, spread, seed, centres=12):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, width))
    return [(c[rng.integers(centres)] + spread * rng.normal(size=width)).tolist() for _ in range(n)]


@pytest.mark.parametrize("spread,least,seed", [(0.3, 0.8, 1), (1.5, 0.5, 2), (0.0, 0.9, 3), (5.0, 0.99, 4)])
def test_rounds_match_the_fold(spark, spread, least, seed):
    rng = np.random.default_rng(seed)
    vectors = people(700, 6, spread, seed)
    rows = [(1 if k < 500 else int(rng.integers(2, 30)), int(i), v) for k, (i, v) in enumerate(zip(rng.permutation(700), vectors))]
    rows += [(1, 5_000, None), (1, 5_001, [0.0] * 6), (1, 5_002, [1.0, None]), (1, 5_003, [1.0, 0.0]), (1, 5_004, [0.0] * 6), (None, 1, vectors[0]), (2, 9_000, [float("nan")] * 6), (2, 9_001, [])]
    df = spark.createDataFrame(rows, "media_id long, face_id long, vector array<double>").withColumn("score", F.lit("x"))
    params = founding.FoundingParams(small=40, slice_rows=64, chunk=16, tile=32)
    found = founding.founded(df, "media_id", "face_id", "vector", least, params).collect()
    want = plain(sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1])), least)
    assert sorted(((r.media_id, r.face_id, r.founder, None if r.score is None else round(r.score, 9)) for r in found), key=str) == want
    assert all(r.founds == (r.founder == r.face_id) for r in found if r.founder is not None)
    whole = founding.founded(df, "media_id", "face_id", "vector", least).collect()
    assert sorted(((r.media_id, r.face_id, r.founder, None if r.score is None else round(r.score, 9)) for r in whole), key=str) == want


def test_known_founders_come_first(spark):
    rng = np.random.default_rng(9)
    rows = [(int(i % 3), int(i), v) for i, v in enumerate(people(400, 5, 1.0, 8))]
    schema = "g long, i long, v array<double>"
    for params in (founding.FoundingParams(), founding.FoundingParams(small=20, slice_rows=32, chunk=8, tile=16)):
        first = founding.founded(spark.createDataFrame(rows[:150], schema), "g", "i", "v", 0.7, params)
        known = first.where("founds").join(spark.createDataFrame(rows, schema), ["g", "i"]).select("g", F.col("i").alias("n"), "i", "v")
        second = founding.founded(spark.createDataFrame(rows[150:], schema), "g", "i", "v", 0.7, params, known=known)
        got = sorted(((r.g, r.i, r.founder, round(r.score, 9)) for r in [*first.collect(), *second.collect()]), key=str)
        assert got == plain(sorted(rows), 0.7)
    assert rng is not None


def test_a_hundred_thousand_in_one_registry(spark):
    """Three rounds of windows; the loop below is the fold with a matrix of founders."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(9_000, 16))
    x = (centres[rng.integers(9_000, size=100_000)] + 0.15 * rng.normal(size=(100_000, 16))).astype(np.float32)
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(x.tolist())], "registry int, segment_id int, embedding array<float>")
    found = founding.founded(df, "registry", "segment_id", "embedding", 0.9).select("segment_id", "founder").toPandas().sort_values("segment_id")
    unit = founding.units(x.astype(np.float64))
    kept, ids, want = np.empty_like(unit), [], np.empty(len(unit), dtype=np.int64)
    for i, v in enumerate(unit):
        s = kept[: len(ids)] @ v
        best = int(s.argmax()) if len(ids) else -1
        if best >= 0 and s[best] >= 0.9:
            want[i] = ids[best]
        else:
            kept[len(ids)] = v
            ids.append(i)
            want[i] = i
    assert len(ids) > 8_192 and (found["founder"].to_numpy() == want).all()


def test_voices_without_vectors_and_numbers(spark):
    rows = [(1, 3, [1.0, 0.0]), (1, 4, None), (1, 5, [0.0, 1.0]), (1, 6, [1.0, 0.1]), (2, 1, [0.0, None]), (2, 2, [1.0]), (2, 2, [1.0])]
    found = voices.enrol(spark.createDataFrame(rows, "registry long, segment_id long, embedding array<double>"), "registry", 0.9, 7).collect()
    got = sorted(((r.registry, r.segment_id, r.voice, r.label, r.score and round(r.score, 4)) for r in found), key=str)
    assert got == sorted([
        (1, 3, "voice-0007", "Voice 7", 1.0), (1, 4, None, None, None), (1, 5, "voice-0008", "Voice 8", 1.0), (1, 6, "voice-0007", "Voice 7", 0.995),
        (2, 1, None, None, None), (2, 2, "voice-0007", "Voice 7", 1.0), (2, 2, "voice-0007", "Voice 7", 1.0),
    ], key=str)
    empty = spark.createDataFrame([], "registry long, segment_id long, embedding array<double>")
    assert voices.enrol(empty, "registry").collect() == []
    assert faces.cluster_in_order(empty.toDF("media_id", "face_id", "vector"), 0.5).collect() == []


def test_positions_over_partitions(spark):
    df = spark.range(5_000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), F.when(F.col("id") % 5 > 0, F.hash("id")).alias("k"), "id")
    got = order.numbered(df, ["g"], [F.col("k"), F.col("id")], "pos").collect()
    groups = {}
    for r in got:
        groups.setdefault(r.g, []).append(r)
    for of in groups.values():
        ordered = sorted(of, key=lambda r: (r.k is not None, r.k or 0, r.id))
        assert [r.pos for r in ordered] == list(range(len(of)))
