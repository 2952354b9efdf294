"""Merge-on-read tables against a dictionary, and what a change writes."""

import random

import pytest
from pyspark.sql import functions as F

from lumenlake.sources import merge
from lumenlake.sources.tables import ConcurrentChange

SCHEMA = "id string, tags array<string>, n int, `a b` double"


def rows_of(table):
    return {r.id: (r.tags, r.n, r["a b"]) for r in table.read().collect()}


@pytest.mark.parametrize("broadcast", [32 << 20, -1])
def test_any_changes_match_a_dictionary(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(merge, "BROADCAST_BYTES", broadcast)
    t = merge.MergeTable(spark, f"file://{tmp_path}/t", "id", SCHEMA, buckets=4)
    rng, want = random.Random(7), {}
    assert t.read().count() == 0 and t.version() == 0
    names = [None, *"abcdefghijkl"]
    for step in range(14):
        some = rng.sample(names, rng.randrange(1, 6))
        kind = rng.choice(["upsert", "upsert", "delete", "set", "set", "insert", "compact"])
        if kind in ("upsert", "insert"):
            new = {k: (["x", None], rng.randrange(9), float(step)) for k in some}
            df = spark.createDataFrame([(k, *v) for k, v in new.items()], SCHEMA)
            (t.upsert if kind == "upsert" else t.insert_missing)(df)
            want = {**want, **new} if kind == "upsert" else {**new, **want}
        elif kind == "delete":
            t.delete(spark.createDataFrame([(k,) for k in some], "id string"))
            want = {k: v for k, v in want.items() if k not in some}
        elif kind == "set":
            t.set_fields(spark.createDataFrame([(k, step if k != "a" else None) for k in some], "id string, n int"))
            want = {k: (v[0], (step if k != "a" else None) if k in some else v[1], v[2]) for k, v in want.items()}
        else:
            t.compact(rng.choice([0, 2]), 0.5)
        assert rows_of(t) == want
        asked = rng.sample(names, 3)
        assert {r.id for r in t.get(asked).collect()} == {k for k in asked if k in want}
    t.compact(0)
    assert rows_of(t) == want and not t.manifest()["deltas"]
    t.forget_before(t.version())
    assert rows_of(t) == want and len(t.log.numbers()) == 1


def test_a_change_of_one_row_writes_one_small_file(spark, tmp_path):
    t = merge.MergeTable(spark, f"file://{tmp_path}/t", "id", "id long, tags array<string>, text string", buckets=8)
    t.upsert(spark.range(4_000).select("id", F.array(F.lit("old")).alias("tags"), F.repeat(F.md5(F.col("id").cast("string")), 20).alias("text")))
    t.compact(0)
    before, data = set(tmp_path.rglob("*.parquet")), sum(p.stat().st_size for p in tmp_path.rglob("*.parquet"))
    t.set_tags(17, [" New ", "new", ""])
    new = set(tmp_path.rglob("*.parquet")) - before
    assert len(new) == 1 and sum(p.stat().st_size for p in new) < data / 100
    (r,) = t.get([17]).collect()
    assert r.tags == ["New"] and t.read().where("tags[0] = 'old'").count() == 3_999
    assert len(t.files()) == 9
    # the bucket of a key alone is read, and untouched buckets take pushed filters
    read = [p for p in t.get([17]).inputFiles() if "base-" in p]
    assert {p.split("_bucket=")[1].split("/")[0] for p in read} == {p.parent.name.split("=")[1] for p in new}
    plan = t.read().where("id > 5").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,5)" in plan


def test_a_job_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    t = merge.MergeTable(spark, f"file://{tmp_path}/t", "id", "id long, n int")
    t.upsert(spark.createDataFrame([(1, 1), (2, 0)], "id long, n int"))
    t.set_fields(spark.createDataFrame([(2, 2)], "id long, n int"))
    change = spark.createDataFrame([(1, 9)], "id long, n int")

    def dies(*_, **__):
        raise RuntimeError("lost")

    for step in ("_written", "_commit"):
        with monkeypatch.context() as m:
            m.setattr(merge.MergeTable, step, dies)
            for act in (lambda: t.upsert(change), lambda: t.set_fields(change), lambda: t.delete(change), lambda: t.compact(0)):
                with pytest.raises(RuntimeError):
                    act()
        assert {r.id: r.n for r in t.read().collect()} == {1: 1, 2: 2} and t.version() == 2
    t.upsert(change)
    assert {r.id: r.n for r in t.read_version(2).collect()} == {1: 1, 2: 2}
    assert {r.id: r.n for r in t.read().collect()} == {1: 9, 2: 2}


def test_two_writers(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    one, two = (merge.MergeTable(spark, path, "id", "id long, n int") for _ in range(2))
    one.upsert(spark.createDataFrame([(1, 1)], "id long, n int"))
    # a change that depends on what is there fails if that has changed meanwhile
    taken = one._written

    def meanwhile(rows, kind, **how):
        one._written = taken
        two.upsert(spark.createDataFrame([(2, 2)], "id long, n int"))
        return taken(rows, kind, **how)

    one._written = meanwhile
    with pytest.raises(ConcurrentChange):
        one.insert_missing(spark.createDataFrame([(2, 7)], "id long, n int"))
    # one that doesn't takes the next place, a compaction too, and loses nothing
    one._written = meanwhile
    one.set_fields(spark.createDataFrame([(2, 5)], "id long, n int"))
    one._written = meanwhile
    one.compact(0)
    assert {r.id: r.n for r in one.read().collect()} == {1: 1, 2: 2}
    two.set_fields(spark.createDataFrame([(2, 6)], "id long, n int"))
    assert {r.id: r.n for r in one.read().collect()} == {1: 1, 2: 6}


def test_two_first_writers(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    one, two = (merge.MergeTable(spark, path, "id", "id long, n int") for _ in range(2))
    taken = one._written

    def meanwhile(rows, kind, **how):
        one._written = taken
        two.upsert(spark.createDataFrame([(1, 1), (2, 2)], "id long, n int"))
        return taken(rows, kind, **how)

    one._written = meanwhile
    one.upsert(spark.createDataFrame([(2, 7)], "id long, n int"))
    assert {r.id: r.n for r in two.read().collect()} == {1: 1, 2: 7}


def test_repeated_keys_and_unknown_columns(spark, tmp_path):
    t = merge.MergeTable(spark, f"file://{tmp_path}/t", "id", "id long, n int")
    t.upsert(spark.createDataFrame([(1, 5, 1), (1, 3, 9), (1, 4, 2)], "id long, n int, at int"), latest_by="at")
    assert t.read().first().n == 3
    t.upsert(spark.createDataFrame([(1, 5), (1, 3), (1, None)], "id long, n int"))
    assert t.read().first().n is None  # the JSON text that is last
    t.set_fields(spark.createDataFrame([(1, 5, 1), (1, 8, 0)], "id long, n int, at int"), latest_by="at")
    assert t.read().first().n == 5
    with pytest.raises(ValueError):
        t.set_fields(spark.createDataFrame([(1, 5)], "id long, m int"))
    t.set_fields(spark.createDataFrame([(9, 5)], "id long, n int"))
    t.delete(spark.createDataFrame([(9,)], "id long"))
    assert t.read().count() == 1


def test_the_first_rows_are_a_base_and_rows_are_computed_once(spark, tmp_path):
    t = merge.MergeTable(spark, f"file://{tmp_path}/t", "id", "id long, n long", buckets=2)
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    rows = spark.range(50).selectExpr("id", "id * 2 AS n").coalesce(1).mapInArrow(counted, "id long, n long")
    t.insert_missing(rows)
    assert runs.value == 50 and not t.manifest()["deltas"] and len(t.manifest()["base"]) == 2
    t.insert_missing(rows.unionByName(spark.range(60, 62).selectExpr("id", "id AS n")))
    t.set_fields(rows.selectExpr("id", "n + 1 AS n"))
    assert runs.value == 150 and t.read().count() == 52
    t.insert_missing(spark.createDataFrame([(70, 1), (70, 3), (None, 2), (None, 4)], "id long, n long"))
    found = {r.id: r.n for r in t.read().collect()}
    assert len(found) == t.read().count() == 54 and found[70] == 3 and found[None] == 4 and found[7] == 15
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if p.name != "_log") == sorted({x["folder"] for x in (*t.manifest()["base"].values(), *t.manifest()["deltas"])})
