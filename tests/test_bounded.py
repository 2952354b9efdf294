"""What the driver, a task or a worker holds does not grow with the tables."""

import pytest
from pyspark.sql import functions as F

from lumenlake.operators import components as linked
from lumenlake.operators import duplicates
from lumenlake.plans.scratch import materialised
from lumenlake.queries import QUERIES


@pytest.fixture
def hashes(spark):
    i = F.col("id")
    media = spark.range(300).select("id", F.concat(F.substring(F.md5((i % 250).cast("string")), 1, 15), F.lower(F.hex(i % 16))).alias("phash"))
    return media, materialised(duplicates.distinct_hashes(media), "hashes")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("rows", [lambda h: duplicates.hash_links(h, 8, 2), lambda h: duplicates.hash_pairs(h, 8)])
def test_keys_of_hashes_are_not_broadcast(hashes, rows):
    # a hash has 45 keys or more, of which Spark's estimate by the files of the hashes knows nothing
    assert "BroadcastExchange" not in plan(rows(hashes[1]))


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("documents"))
    rows = spark.range(300).selectExpr("id AS doc_id", "concat('text ', id % 250) AS text", "'en' AS lang", "concat('src', id % 4) AS source", "id AS n_chars")
    rows.write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("name", ["duplicate_membership", "album_sort_duplicate_group_size", "duplicate_membership_left", "duplicate_exclude_anti", "duplicate_only_semi"])
def test_tables_of_classes_are_not_broadcast(spark, documents, name):
    # they have a row for each medium, hash or class, and Spark would broadcast them up to 10 MB, by then whole tables of members
    found = QUERIES[name](spark, documents)
    assert found.collect()
    assert "isFinalPlan=true" in plan(found) and "BroadcastExchange" not in plan(found)


@pytest.mark.parametrize("name", ["duplicate_membership", "album_sort_duplicate_group_size", "duplicate_membership_left", "duplicate_exclude_anti", "duplicate_only_semi"])
def test_media_are_hashed_once(spark, documents, name):
    # else the last plan scans and hashes all texts again
    found = plan(QUERIES[name](spark, documents))
    assert "md5" not in found and (name != "duplicate_membership_left" or found.count("SortMergeJoin") == 2)


def test_classes_are_the_same_with_links_that_are_not_broadcast(hashes, monkeypatch):
    media, _ = hashes
    found = {tuple(r) for r in duplicates.membership(media, 8).collect()}
    monkeypatch.setattr(linked, "HELD", 0)
    assert {tuple(r) for r in duplicates.membership(media, 8).collect()} == found
    first = {r.phash: r.id for r in media.orderBy(F.desc("id")).collect()}
    assert len(found) == 300 and all(root <= id for id, root in found) and len({r for _, r in found}) <= len(first)


@pytest.mark.parametrize("kind", ["long", "string", "double"])
def test_few_links_are_joined_without_rounds(spark, monkeypatch, kind):
    ends = [(1, 2), (2, 3), (3, 1), (10, 11), (12, 11), (12, 30), (7, 7), (None, 4), (100, 21), (21, 9)]
    links = spark.createDataFrame(ends, "a long, b long").select(F.col("a").cast(kind), F.col("b").cast(kind))
    rounds = []
    monkeypatch.setattr(linked, "discard", lambda spark, path: rounds.append(path))
    once = {tuple(r) for r in linked.components(links).collect()}
    assert kind == "double" or len(rounds) == 1  # the links themselves
    monkeypatch.setattr(linked, "HELD", -1)
    found = linked.components(links)
    assert {tuple(r) for r in found.collect()} == once and len(once) == 10 and dict(found.dtypes)["node"] == dict(links.dtypes)["a"]
    assert linked.components(links.where("a IS NULL")).count() == 0


def test_ends_of_links_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(linked, "HELD", -1)
    plans, empty = [], type(spark.range(0)).isEmpty
    monkeypatch.setattr(type(spark.range(0)), "isEmpty", lambda df: plans.append(plan(df)) or empty(df))
    links = spark.range(300).selectExpr("id AS a", "id % 7 AS b")
    assert linked.components(links).where("component < 7").count() == 300
    assert plans and not any("BroadcastExchange" in p for p in plans)


def test_no_links_give_no_rows(spark):
    assert linked.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_scores_of_a_batch_are_never_all_in_memory():
    import tracemalloc

    import numpy as np

    from lumenlake.operators import search

    rng = np.random.default_rng(5)
    x, units = rng.normal(size=(10_000, 16)), rng.normal(size=(1_024, 16))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    x[7_000:7_400] = x[:400]  # equal scores: ties go by id
    held = [[] for _ in units]
    tracemalloc.start()
    search._keep_best(held, x, list(range(len(x))), units, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6  # all scores at once are 82 MB, and were held several times
    for k in range(0, 1_024, 50):
        scores = np.round(x @ units[k] / np.linalg.norm(x, axis=1), 9)
        best = np.lexsort((np.arange(len(x)), -scores))[:10]
        assert np.allclose([s for s, _ in held[k]], scores[best]) and {i for _, i in held[k][:9]} <= {*best.tolist(), *np.nonzero(scores >= scores[best[-1]])[0].tolist()}
