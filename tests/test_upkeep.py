"""Classes kept up to date, album pages by place, and scene cuts."""

import random

import pytest
from pyspark.sql import functions as F

from lumenlake.operators import albums, duplicates, segments
from lumenlake.operators.filters import SearchFilters


def hashes(rng, n):
    """Families of close hashes, equal ones, far ones and invalid ones."""
    roots = [rng.getrandbits(64) for _ in range(max(1, n // 6))]
    out = []
    for _ in range(n):
        h = rng.choice(roots)
        for _ in range(rng.choice([0, 0, 2, 5, 9])):
            h ^= 1 << rng.randrange(64)
        out.append(rng.choice([None, "xyz"]) if rng.random() < 0.05 else f"{h:016x}"[:16].upper() if rng.random() < 0.1 else f"{h:016x}")
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_after_any_changes_are_those_of_one_computation(spark, tmp_path, seed):
    rng = random.Random(seed)
    index = duplicates.DuplicateIndex(spark, f"file://{tmp_path}/d", 8, id_type="long", buckets=2)
    pool, now = hashes(rng, 240), {}
    for step in range(5):
        if step == 3:
            drop = rng.sample(sorted(now), len(now) // 3)
            index.remove(spark.createDataFrame([(i,) for i in drop], "id long"))
            now = {i: h for i, h in now.items() if i not in drop}
        else:
            new = {rng.randrange(200): rng.choice(pool) for _ in range(60)}  # some change their hash
            index.add(spark.createDataFrame(list(new.items()), "id long, phash string"))
            now |= new
        want = duplicates.membership(spark.createDataFrame(list(now.items()), "id long, phash string"), 8)
        assert sorted(map(tuple, index.membership().collect())) == sorted(map(tuple, want.collect()))


def test_a_refresh_finishes_what_a_dead_job_left(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    media = spark.createDataFrame(list(enumerate(hashes(rng, 80))), "id long, phash string")
    index = duplicates.DuplicateIndex(spark, f"file://{tmp_path}/d", 8, id_type="long", buckets=2)
    index.add(media.where("id < 40"))

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(index.hashes, "upsert", lost)
        with pytest.raises(RuntimeError):
            index.add(media)
    index.refresh()
    assert sorted(map(tuple, index.membership().collect())) == sorted(map(tuple, duplicates.membership(media, 8).collect()))


@pytest.mark.parametrize("sort", albums.SORTS)
def test_pages_by_place_are_those_of_a_sort(spark, tmp_path, sort):
    rng = random.Random(3)
    rows = [(f"i{i:04d}", f"F{rng.randrange(40)}.jpg", rng.choice([None, 1.5e9 + rng.randrange(5)]), float(rng.randrange(9)), rng.choice([None, *range(5)]), rng.randrange(1, 4)) for i in range(730)]
    df = spark.createDataFrame(rows, "id string, filename string, photo_capture_time_epoch double, modified_at double, size_bytes long, duplicate_group_size long")
    directory = albums.PageDirectory(spark, str(tmp_path / "pages"), block=100)
    directory.build(df, sort)
    assert directory.total().first().total == 730
    for offset, limit in ((0, 60), (90, 20), (699, 500), (730, 10), (5_000, 5)):
        assert [r.id for r in directory.page(offset, limit).collect()] == [r.id for r in albums.page(df, sort, offset, limit).collect()]
    plan = directory.page(690, 10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_block" in plan or "PartitionFilters: [_block" in plan
    # a page at any depth reads a block's files
    assert albums.matching(df.withColumns({"width": F.lit(1), "height": F.lit(1)}), SearchFilters()).count() == 730


def plain_cuts(frames, threshold=27.0, least=15):
    out, last_cut, before = [], {}, {}
    for v, f, *c in sorted(x for x in frames if None not in x):
        if v not in before:
            last_cut[v] = f
        else:
            score = sum(abs(a - b) for a, b in zip(c, before[v])) / 3
            if score >= threshold and f - last_cut[v] >= least:
                out.append((v, f, round(score, 6)))
                last_cut[v] = f
        before[v] = c
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_cuts_match_a_loop(spark, parts):
    rng = random.Random(parts)
    frames = []
    for v, n in ((1, 400), (2, 30), (3, 1)):
        colour = [90.0, 100.0, 100.0]
        for f in range(n):
            if rng.random() < 0.15:
                colour = [rng.uniform(0, 255) for _ in range(3)]
            frames.append((v, f * rng.choice([1, 1, 1]) + 3, *[x + rng.uniform(-3, 3) for x in colour]))
    frames += [(None, 5, 1.0, 1.0, 1.0), (1, None, 1.0, 1.0, 1.0), (1, 1_000, None, 1.0, 1.0)]
    df = spark.createDataFrame(frames, "video_id long, frame long, hue double, saturation double, value double")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = sorted((r.video_id, r.frame, round(r.score, 6)) for r in segments.content_cuts(df).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == plain_cuts(frames) and got
    assert segments.content_cuts(df.limit(0)).collect() == []
