"""Hot keys, many blocks, unclosed markup and file sizes of the training-data operators."""

import random
import re
import time
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lumenlake.llm import decontam, langid, mixing, ranking, sharding, simhash, warc
from lumenlake.llm.common import scratch_dir

DROPPED = re.compile(r"(?is)<!--.*?-->|<(script|style|nav)\b.*?</\1\s*>|<[^>]*>")
DECLARED = re.compile(r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})")


def test_visible_text_and_declared_language_are_those_of_the_patterns():
    rng = random.Random(2)
    parts = ["<!--", "-->", "<script>", "</script >", "<STYLE a=1>", "</style>", "<nav", "</nav>", "<p>", "<", ">", "</scripty>", "text ", "<html ", "lang=", "'de'", "LANG = en", " ", "<htmlx lang=fr>", "é", "\n", "xlang=it"]
    for _ in range(6_000):
        page = "".join(rng.choices(parts, k=rng.randrange(14)))
        assert langid.visible_text(page) == DROPPED.sub(" ", page), page
        found = DECLARED.search(page)
        assert langid.declared_language(page) == (found[1].lower() if found else ""), page


@pytest.mark.parametrize("mark", ["<!--", "<script ", "<script>", "<nav>", "<style>", "<html ", "<html lang ", "<", "</script", "<!-- -->", "lang= "])
def test_unclosed_markup_takes_one_scan(mark):
    page = mark * (2_000_000 // len(mark))
    began = time.process_time()
    langid.visible_text(page)
    langid.declared_language(page)
    assert time.process_time() - began < 4


def test_more_languages_than_a_table_holds(spark):
    rng = random.Random(4)
    words = {f"l{i}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(12)] for i in range(9)}
    docs = spark.createDataFrame([(i, lang, " ".join(rng.choices(words[lang], k=30))) for i, lang in enumerate(sorted(words) * 8)], "doc_id long, lang string, text string")
    pages = spark.createDataFrame([(i, f"http://h{i}.x/", f"<html lang='de'>{' '.join(rng.choices(words[lang], k=20))}") for i, lang in enumerate(sorted(words) * 2)], "page_id long, url string, html string")
    runs = [sorted(map(str, langid.identify(pages, docs, langid.LanguageParams(block_languages=n)).collect())) for n in (64, 4, 1)]
    assert runs[0] == runs[1] == runs[2]
    right = [(r.page_id, r.text_lang) for r in langid.identify(pages, docs).collect()]
    assert sum(t == sorted(words)[i % 9] for i, t in right) >= 17
    none = langid.identify(pages, docs.limit(0)).collect()
    assert {(r.lang, r.probability, r.text_lang, r.declared) for r in none} == {(None, None, None, "de")} and {r.host for r in none} == {f"h{i}.x" for i in range(18)}


def test_null_and_repeated_ids_are_no_hot_chunk(spark, monkeypatch):
    monkeypatch.setattr(ranking, "CHUNK_ROWS", 500)
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.col("id")).when(F.col("id") % 3 == 1, F.lit(7)).alias("doc_id"), F.lit("same").alias("text"), (F.col("id") % 2).alias("source"))
    seen = {}
    real = ranking.Window.partitionBy

    def watched(*by):
        seen["by"] = by
        return real(*by)

    monkeypatch.setattr(ranking.Window, "partitionBy", staticmethod(watched))
    numbered = ranking.numbered(rows, "source", F.col("doc_id"), [], "n")
    assert seen["by"] == ("source", "_chunk")
    got = {}
    for r in numbered.collect():
        got.setdefault(r.source, []).append(r.n)
    assert {k: sorted(v) for k, v in got.items()} == {0: list(range(15_000)), 1: list(range(15_000))}
    # the largest window is a chunk of a few hundred rows
    plan = numbered.select("n")._jdf.queryExecution().analyzed().toString()
    assert "_spread" in plan
    placed = sharding.placed(rows).collect()
    assert {s: sorted(r.slot for r in placed if r.shard == s) == list(range(n)) for s, n in Counter(r.shard for r in placed).items()} == dict.fromkeys({r.shard for r in placed}, True)
    assert mixing.schedule(rows.select("doc_id", "source")).count() >= 30_000


def test_many_blocks_leave_hits_and_one_copy(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    bench = [(i, " ".join(rng.choices(words, k=14))) for i in range(40)] + [(None, " ".join(rng.choices(words, k=12)))]
    docs = [(i, " ".join([*rng.choices(words, k=200), *(rng.choice(bench)[1].split() if i % 9 == 0 else []), *rng.choices(words, k=100)])) for i in range(300)] + [(300, None), (300, bench[-1][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    scratch = Path(re.sub("^file:/*", "/", scratch_dir(spark, "x"))).parent
    before = set(scratch.glob("*"))
    many, one = decontam.DecontamParams(max_windows=10), decontam.DecontamParams()
    for texts in (False, True):
        got = [decontam.with_hits(d, b, p, texts_too=texts).selectExpr("row.doc_id", "found").collect() for p in (many, one)]
        assert sorted(map(str, got[0])) == sorted(map(str, got[1])) and any(r.found.items for r in got[0])
    assert sorted(map(str, decontam.decontaminate(d, b, many).collect())) == sorted(map(str, decontam.decontaminate(d, b, one).collect()))
    new = [p for p in scratch.glob("*") if p not in before]
    assert len([p for p in new if p.name.startswith("windows")]) == 2 and len([p for p in new if p.name.startswith("clean")]) == 1


def test_archives_are_of_the_size_asked_for(spark, tmp_path):
    rng = random.Random(8)
    sizes = [1_500] * 1_200 + [rng.randrange(200, 6_000) for _ in range(300)] + [90_000] * 3 + [400_000]
    pages = spark.createDataFrame([(i, f"http://a/{i}", rng.randbytes(n // 2).hex()) for i, n in enumerate(sizes)], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"), warc.WarcParams(archive_bytes=1 << 20))
    files = list((tmp_path / "w").rglob("*.gz"))
    assert sum(sizes) // (1 << 20) <= len(files) <= sum(sizes) // (1 << 20) + 6
    assert len(warc.read_archives(spark, str(tmp_path / "w")).collect()) == len(sizes)


def test_fingerprint_pieces_are_those_of_the_whole_text():
    rng = random.Random(9)
    for _ in range(400):
        text = "".join(rng.choices(["a", "Bc", "déf", " ", "  ", "\n", "\t\x0b", "\x1c"], k=rng.randrange(60))).encode()
        for words in (1, 2, 4, 5):
            whole = simhash.shingle_hashes(text, words, 42).tolist()
            for piece in (1, 3, 10, 50, 1_000):
                assert [h for part in simhash.shingle_pieces(text, words, 42, piece) for h in part.tolist()] == whole
    long = b" ".join(rng.randbytes(4).hex().encode() for _ in range(400_000))
    assert simhash.fingerprint(long, 4, 42) == simhash.majority([simhash.shingle_hashes(long, 4, 42)])
