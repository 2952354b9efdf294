"""Trigram postings against scans."""

import random

import pytest
from pyspark.sql import functions as F

from lumenlake.functions.text import contains_any, holds_terms
from lumenlake.operators import trigrams

WORDS = ["alpha", "Beta", "gamma", "ÉMILE", "日本語の本", "straße", "İstanbul", "x" * 40, "ab", "a", "  ", "tab\tnew\nline", "😀😀😀smile"]


def indexed(spark, tmp_path, n=900, files=6, seed=1, **how):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = rng.choices(WORDS, k=rng.randrange(0, 6))
        rows.append((i, None if i % 17 == 0 else " ".join([*words, f"id{i:05d}"]), f"/set{i % 7}/IMG-{i:04d}.jpg"))
    rows.append((n, "the only needle in a haystack", "/odd/needle.jpg"))
    path = str(tmp_path / "a table")
    spark.createDataFrame(rows, "id long, text string, name string").repartitionByRange(files, "id").write.parquet(path)
    table = spark.read.parquet(path)
    index = trigrams.TextIndex(spark, str(tmp_path / "an index"), **how)
    index.build(table, lambda: F.array("text", "name"), partitions=8)
    return table, index


@pytest.mark.parametrize("chunk,size", [(4_096, 8_000_000), (64, 300)])
def test_searches_are_those_of_a_scan(spark, tmp_path, chunk, size):
    table, index = indexed(spark, tmp_path, chunk_rows=chunk, chunk_grams=size)
    for query in ("needle", "the needle", "NEEDLE hay", "émile", "本語の", "STRASSE", "istanbul", "i̇stanbul", "ab", "a", "x" * 20, "beta alpha gamma", "id00017", "id00018 a", "nowhere", "😀smile", "line", "", "id0"):
        matches = holds_terms(query, F.col("text")) if query.split() else F.lit(True)
        want = sorted(r.id for r in table.where(matches).collect())
        assert sorted(r.id for r in index.search(table, query.lower().split(), matches).collect()) == want, query
    for needle in ("IMG-0123", "/set3/", "needle.jpg", "g-08"):
        matches = contains_any(needle, F.col("name"))
        assert sorted(r.id for r in index.search(table, [needle.lower()], matches).collect()) == sorted(r.id for r in table.where(matches).collect())


def test_a_rare_term_reads_few_files(spark, tmp_path):
    table, index = indexed(spark, tmp_path, n=3_000, files=12)
    matches = holds_terms("needle", F.col("text"))
    wanted = index.chosen(["needle"])
    every = len(spark.read.parquet(str(tmp_path / "an index" / "postings")).inputFiles())
    assert wanted and len(index.posting_files(wanted)) < every
    assert len(table.inputFiles()) == 12 and len([f for f in index.search(table, ["needle"], matches).inputFiles() if "a%20table" in f]) == 1
    assert index.chosen(["nowhere"]) == [] and index.chosen(["ab"]) is None and index.chosen(["/set"]) is None


def test_empty_tables(spark, tmp_path):
    path = str(tmp_path / "table")
    spark.createDataFrame([], "id long, text string").write.parquet(path)
    table = spark.read.parquet(path)
    index = trigrams.TextIndex(spark, str(tmp_path / "index"))
    index.build(table, lambda: F.array("text"))
    assert index.search(table, ["needle"], holds_terms("needle", F.col("text"))).collect() == []
