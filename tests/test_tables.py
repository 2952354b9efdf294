"""Sources, versioned tables, planning, chains, duplicates, identities and streams on fixtures."""


import pytest
from pyspark.sql import functions as F

from lumenlake import schema
from lumenlake.operators import albums, components, deletion, duplicates, identity, search
from lumenlake.operators.filters import SearchFilters
from lumenlake.plans import planning, processors
from lumenlake.sources import scan, tables
from lumenlake.streaming import watch


def test_transitive_duplicates(spark):
    rows = [("b", "0" * 15 + "1"), ("a", "0" * 16), ("c", "0" * 15 + "3"), ("d", "f" * 16), ("x", "bad"), ("n", None)]
    m = spark.createDataFrame(rows, "id string, phash string")
    (g,) = duplicates.groups(duplicates.membership(m, 1)).collect()
    assert (g.ids, g.size, g.representative) == (["a", "b", "c"], 3, "a")


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30))


def test_album_pages(spark):
    rows = [(f"item-{i}", f"item-{i}", 1.7e9 + i, h, "s") for i, h in enumerate(["0" * 16, "0" * 15 + "1", "0" * 15 + "3", *["f" * 16] * 3])]
    m = spark.createDataFrame(rows, "id string, filename string, modified_at double, phash string, source_type string")
    members = duplicates.membership(m, 1)
    page, total = albums.album_results(m, SearchFilters(near_duplicates="only"), members, "modified_newest", 0, 2)
    assert [r.id for r in page.collect()] == ["item-5", "item-4"] and total.first().total == 6
    page, _ = albums.album_results(m, SearchFilters(near_duplicates="only"), members, "modified_newest", 2, 2)
    assert page.first().id == "item-3" and {r["size"] for r in duplicates.groups(members).collect()} == {3}


def test_payload_defaults_and_corrupt_rows(spark):
    rows = spark.createDataFrame([('{"id":"a","width":3,"unknown":1}',), ("{oops",)], "payload string")
    (r,) = schema.with_derived(schema.read_payloads(rows)).collect()
    assert (r.media_kind, r.ocr_text, r.tags, r.photo_has_gps) == ("static_image", "", [], False)
    assert schema.read_payloads(rows, corrupt="keep").where("corrupt_payload IS NOT NULL").count() == 1


def test_nested_text_search(spark):
    rows = spark.createDataFrame([('{"id":"a","filename":"x","audio_analysis":{"transcript_segments":[{"text":"Quarterly budget  review"}]}}',)], "payload string")
    m = schema.with_derived(schema.read_payloads(rows))
    assert search.search_text(m, "budget review", SearchFilters(), 5).count() == 1
    assert search.search_text(m, "missing phrase", SearchFilters(), 5).count() == 0


def test_search_media_window_and_exact(spark):
    rows = [(i, [1.0, i / 100.0], f"{i:016x}", "k", "x", i, i) for i in range(100)]
    m = spark.createDataFrame(rows, "id int, visual array<float>, phash string, source_type string, ocr_text string, width int, height int")
    m = m.withColumns({c: F.lit("n") for c in ("filename", "relative_path", "path", "source_uri")}).withColumn("filename", F.concat(F.lit("f"), F.col("id").cast("string")))
    near = search.search_media(m, [1.0, 0.0], "0" * 16, SearchFilters(name="f9"), 2)
    assert [r.id for r in near.collect()] == [9]
    exact = search.search_media(m, [1.0, 0.0], "0" * 16, SearchFilters(name="f9"), 2, exact=True)
    assert [r.id for r in exact.collect()] == [9, 90]


def test_versioned_table(spark, tmp_path):
    t = tables.VersionedTable(spark, f"file://{tmp_path}/t", "id", "id string, tags array<string>, n int")
    assert t.read().count() == 0
    t.upsert(spark.createDataFrame([("a", ["x"], 1), ("b", ["y"], 2)], "id string, tags array<string>, n int"))
    t.upsert(spark.createDataFrame([("b", ["z"], 3)], "id string, tags array<string>, n int"))
    t.set_fields(spark.createDataFrame([("a", ["new"])], "id string, tags array<string>"))
    assert sorted(map(tuple, t.read().collect())) == [("a", ["new"], 1), ("b", ["z"], 3)]
    t.delete(spark.createDataFrame([("a",)], "id string"))
    assert [r.id for r in t.read().collect()] == ["b"]
    assert tables.check_schema(t.read(), t.schema) == []


def test_local_scan(spark, tmp_path):
    for name in ("a.JPG", "sub/b.mp4", ".hidden/c.png", "d.txt"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"12345")
    got = {r.item_uri.rsplit("/", 1)[1]: (r.media_kind, r.size_bytes) for r in scan.scan(spark, str(tmp_path)).collect()}
    assert got == {"a.JPG": ("image", 5), "b.mp4": ("video", 5)}
    rows, skipped = scan.scan_all(spark, [str(tmp_path), "camera://1", str(tmp_path / "none")])
    assert rows.count() == 2 and [s for s, _ in skipped] == ["camera://1", str(tmp_path / "none")]


def test_source_lists():
    assert scan.parse_sources("a;b,c") == ["a", "b,c"] and scan.parse_sources('["x", "$H/y"]', {"H": "/h"}) == ["x", "/h/y"]
    assert scan.parse_extensions("jpg, .PNG") == {".jpg", ".png"} and scan.source_kind("s3://b/p") == "object"
    with pytest.raises(ValueError):
        scan.parse_extensions(" ,")


def test_plan_follows_the_ledger(spark):
    cols = "uri string, size_bytes bigint, modified_at double, profile string"
    files = spark.createDataFrame([(u, 42, 100.0, "p") for u in ("running", "done", "missing", "none", "changed")], cols)
    idx = spark.createDataFrame([(u, f"{u}-1", 42 + (u == "changed"), 100.0005, "p", True) for u in ("running", "done", "none", "changed")], "uri string, point_id string, size_bytes bigint, modified_at double, profile string, complete boolean")
    led = spark.createDataFrame([("running", 42, 100.0, "p", "running", ["running-1"]), ("done", 42, 100.0, "p", "completed", ["done-1"]), ("missing", 42, 100.0, "p", "completed", ["missing-1"])], cols + ", status string, point_ids array<string>")
    got = {r.uri: r.status for r in planning.planned(files, idx, led).collect()}
    assert got == {"running": "pending", "done": "current", "missing": "pending", "none": "current", "changed": "pending"}


def test_people_merge(spark):
    faces_ = [(f"f{i}", "m", 0, None, 0.5, p, None) for i, p in enumerate("ab")]
    people = [("a", "Ann", 1, 1, 0.5), ("b", None, 1, 1, 0.5)]
    m = spark.createDataFrame([("m", faces_, people)], f"id string, faces {schema.MEDIA_FIELDS['faces'].replace(':', ' ', 0)}, people {schema.MEDIA_FIELDS['people']}")
    r = identity.merge_people(m, ["b"], "a", "Ann").first()
    assert [(p.person_id, p.label, p.face_count, p.media_count) for p in r.people] == [("a", "Ann", 2, 1)] and r.changed
    assert identity.rename_person(m, "a", "Eve").first().people[0].label == "Eve"
    with pytest.raises(ValueError):
        identity.check_label("a\nb")


def test_delete_keeps_other_sources(spark):
    m = spark.createDataFrame([(1, "s1"), (2, "s2")], "id long, source_uri string")
    f = spark.createDataFrame([("f1", 1), ("f2", 2)], "face_id string, media_id long")
    media, faces_ = deletion.cascade(m, f, deletion.matching_media(m, source_uri="s1"))
    assert [r.id for r in media.collect()] == [2] and [r.face_id for r in faces_.collect()] == ["f2"]
    urls = spark.createDataFrame([("/root/a.gif#t=1",), ("/root/../b",), ("/else/c",)], "url string")
    assert [r.file for r in deletion.safe_artifacts(urls, "/root/").collect()] == ["a.gif"]


def test_processor_chain(spark):
    node = lambda i, p, **k: processors.Node(i, p, **k)
    flow = processors.Workflow((node("s", "load"), node("a", "add", config={"n": 2}), node("i", "index")), (("s", "a"), ("a", "i")))
    known = {"load", "add", "index"}
    assert processors.problems(flow, known, ["load"], "index") == []
    loop = processors.Workflow(flow.nodes, (*flow.edges, ("i", "a")))
    assert "cycle" in processors.problems(loop, known, ["load"], "index")
    assert "unknown_processor" in processors.problems(flow, {"load"}, [], "index")
    registry = {"load": lambda d, c: d, "add": lambda d, c: d.withColumn("id", F.col("id") + c["n"]), "index": lambda d, c: d.limit(0)}
    assert processors.apply(spark.range(1), flow, registry, without=["index"]).first().id == 2


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jpg").write_bytes(b"x")
    seen: list[str] = []
    handle = lambda df, n: seen.extend(r.path for r in df.collect())
    for _ in range(2):  # the second run resumes and sees nothing new
        watch.watch_new_files(spark, str(tmp_path / "in"), str(tmp_path / "cp"), handle).awaitTermination(60)
    assert len(seen) == 1


def test_debounce_on_a_stream(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "a"), ("2024-01-01 00:00:01", "b"), ("2024-01-01 00:10:00", "c")]
    e = spark.createDataFrame(rows, "ts string, path string").withColumn("ts", F.to_timestamp("ts")).withColumn("root", F.lit("r"))
    e.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    q = watch.debounced(stream, ["root"], "ts", "path", "2 seconds", "1 second").writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.paths for r in spark.table("bursts").collect()][0] == ["a", "b"]


