"""Pushed filters, versioned tables and the ledger under crashes, scans, searches and folds against plain loops."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake import schema
from lumenlake.functions import temporal, text
from lumenlake.operators import albums, enrichment, faces, filters, identity, inverse, search, segments, voices
from lumenlake.plans import ledger, planning, processors, profile
from lumenlake.sources import scan, tables
from lumenlake.streaming import watch

MEDIA = "id string, source_type string, media_kind string, width int, height int, size_bytes bigint, modified_at double, photo_has_gps boolean, photo_capture_time_epoch double, filename string"


def test_filters_reach_the_scan(spark, tmp_path):
    rows = [(f"m{i}", "s3" if i % 2 else None, "audio", i, i, i * 1000, 1.0 * i, i % 3 == 0, None if i % 4 else 5.0, "f") for i in range(50)]
    spark.createDataFrame(rows, MEDIA).write.parquet(str(tmp_path / "m"))
    f = filters.SearchFilters(source_type="s3", media_kind="audio", has_gps=True, width_min=2.5, height_max=40.5, size_min=1500.0, modified_from=1.0, captured_to=9.0)
    found = spark.read.parquet(str(tmp_path / "m")).where(filters.conjunction(filters.pushed(f)))
    plan = found._jdf.queryExecution().explainString(found._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    for part in ("EqualTo(source_type,s3)", "EqualTo(media_kind,audio)", "EqualTo(photo_has_gps,true)", "GreaterThanOrEqual(width,3)", "LessThanOrEqual(height,40)", "GreaterThanOrEqual(size_bytes,1500)", "GreaterThanOrEqual(modified_at,1.0)", "LessThanOrEqual(photo_capture_time_epoch,9.0)"):
        assert part in pushed or part.replace("EqualTo(photo_has_gps,true)", "photo_has_gps") in pushed, (part, pushed)
    assert sorted(r.id for r in found.collect()) == sorted(r[0] for r in rows if r[1] and r[7] and r[3] >= 3 and r[4] <= 40 and r[5] >= 1500 and r[8] is not None)


def table(spark, path):
    return tables.VersionedTable(spark, f"file://{path}/t", "id", "id string, n int, `a.b` string")


def test_a_table_survives_a_crash_after_every_step(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    put = lambda *rows: t.upsert(spark.createDataFrame(rows, "id string, n int"))
    rows = lambda: sorted((r.id, r.n) for r in table(spark, tmp_path).read().collect())
    assert rows() == [] and put(("a", 1), ("b", 2)) == 1 and rows() == [("a", 1), ("b", 2)]
    point = tables.VersionedTable._point
    monkeypatch.setattr(tables.VersionedTable, "_point", lambda *a: (_ for _ in ()).throw(OSError("died")))
    with pytest.raises(OSError):  # after the folder, before the pointer
        put(("c", 3))
    assert rows() == [("a", 1), ("b", 2)]
    monkeypatch.setattr(tables.VersionedTable, "_point", point)
    (tmp_path / "t/_pointers/.half").write_text("v-nothing")  # a pointer that was never renamed
    assert put(("c", 3)) == 2 and rows() == [("a", 1), ("b", 2), ("c", 3)]
    assert t.set_fields(spark.createDataFrame([("a", 7, "x"), ("a", 7, "x"), ("z", 1, "y")], "id string, n int, `a.b` string")) == 3
    assert rows() == [("a", 7), ("b", 2), ("c", 3)]
    t.forget_before(3)
    assert rows() == [("a", 7), ("b", 2), ("c", 3)] and t.version() == 3 and len(list((tmp_path / "t").glob("v-*"))) == 2  # and the crashed one's


def test_the_second_of_two_writers_gets_an_error(spark, tmp_path):
    one = table(spark, tmp_path)
    one.upsert(spark.createDataFrame([("a", 1)], "id string, n int"))

    def meanwhile(old):
        table(spark, tmp_path).upsert(spark.createDataFrame([("b", 2)], "id string, n int"))
        return old

    with pytest.raises(tables.ConcurrentChange):
        one._change(meanwhile)
    assert sorted(r.id for r in one.read().collect()) == ["a", "b"]


def test_tags_of_a_row(spark, tmp_path):
    t = tables.VersionedTable(spark, f"file://{tmp_path}/t", "id", "id string, tags array<string>")
    t.upsert(spark.createDataFrame([("a", ["x"]), ("b", ["y"])], t.schema))
    t.set_tags("a", [" travel ", "Travel", "", "archive"])
    assert sorted((r.id, r.tags) for r in t.read().collect()) == [("a", ["travel", "archive"]), ("b", ["y"])]


def test_a_run_that_dies_is_resumed(spark, tmp_path):
    book = ledger.IndexLedger(spark, f"file://{tmp_path}/l")
    kinds = "uri string, source string, size_bytes bigint, modified_at double, profile string"
    items = spark.createDataFrame([(u, "s", 42, 100.0, "p") for u in ("one", "two", "three")], kinds)
    assert book.load()[0].count() == 0 and book.load()[1] is None
    book.register(items)
    points = lambda *rows: spark.createDataFrame(rows, "uri string, point_id string")
    book.commit(points(("one", "one-1"), ("two", "two-1")))
    book.commit(points(("one", "one-2"), ("one", "one-1")))
    book.complete(spark.createDataFrame([("one", ["one-1", "one-2"])], "uri string, point_ids array<string>"))
    # the run dies here: a new one plans from what is written
    again = ledger.IndexLedger(spark, f"file://{tmp_path}/l")
    entries, why = again.load()
    idx = spark.createDataFrame([("one", "one-1", 42, 100.0, "p", True), ("one", "one-2", 42, 100.0, "p", True), ("two", "two-1", 42, 100.0, "p", True)], "uri string, point_id string, size_bytes bigint, modified_at double, profile string, complete boolean")
    plan = {r.uri: r.status for r in planning.planned(items.drop("source"), idx, entries).collect()}
    assert why is None and plan == {"one": "current", "two": "pending", "three": "pending"}
    assert {r.uri: r.point_ids for r in again.unfinished().collect()} == {"two": ["two-1"], "three": []}
    again.start(items.where("uri = 'two'"))
    again.fail(spark.createDataFrame([("two", "broken")], "uri string, error string"))
    again.cancel(items.select("uri"))
    assert {r.uri: (r.status, r.error, r.point_ids) for r in again.load()[0].where("uri <> 'one'").collect()} == {"two": ("failed", "broken", []), "three": ("cancelled", "cancelled", [])}
    for p in (tmp_path / "l").rglob("*.parquet"):
        p.write_bytes(b"not a table")
    entries, why = ledger.IndexLedger(spark, f"file://{tmp_path}/l").load()
    assert entries.count() == 0 and why


def png(width, height, rgb):
    raw = b"".join(b"\0" + rgb[y * width * 3 : (y + 1) * width * 3] for y in range(height))
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_a_source_below_a_hidden_folder_is_scanned_and_its_pictures_decoded(spark, tmp_path):
    root = tmp_path / ".media"
    rgb = bytes(range(4 * 3 * 3))
    for name, data in {"a.png": png(4, 3, rgb), "sub/b.OPUS": b"x", ".no/c.png": b"x", "sub/.no/d.wma": b"x", "e.png": b"broken"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    for spec in (str(root), f"file://{root}", f"{root}/"):
        assert sorted(r.item_uri.rsplit("/", 1)[1] for r in scan.scan(spark, spec).collect()) == ["a.png", "b.OPUS", "e.png"]
    found = scan.images(spark, str(root)).where("item_uri LIKE '%a.png'")
    (r,) = enrichment.with_hashes(enrichment.with_color_vectors(found, 9)).collect()
    assert bytes(r.data) == rgb and (r.width, r.height) == (4, 3) and len(r.phash) == 16
    assert np.allclose(r.visual, enrichment.color_vector(np.frombuffer(rgb, np.uint8), 9), atol=1e-6)


def test_open_ended_segments_join_by_bucket_too(spark):
    s = spark.createDataFrame([("k", None, 1.5), ("k", 0.5, None), ("k", None, None), ("k", 1.0, 3.0), (None, 0.0, 9.0), ("k", 3.0, 3.0)], "key string, start double, end double")
    w = spark.createDataFrame([("k", 0.0, 1.0), ("k", 1.0, 2.0), ("k", 5.0, 6.0), (None, 0.0, 9.0)], "key string, window_start double, window_end double")
    runs = [sorted(map(str, segments.join_overlapping(s, w, "key", b).collect())) for b in (None, 0.7, 100.0)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 9


@pytest.mark.parametrize("ids", ["long", "string"])
@pytest.mark.parametrize("block", [3, 1_024])
def test_many_queries_against_brute_force(spark, monkeypatch, ids, block):
    monkeypatch.setattr(search, "QUERY_BLOCK", block)
    r = np.random.default_rng(0)
    v = r.integers(-2, 3, (120, 4)).astype(float)
    name = (lambda i: i) if ids == "long" else (lambda i: f"id-{i}")
    rows = [(name(i), x.tolist()) for i, x in enumerate(v)] + [(name(500), None), (name(501), [1.0]), (name(502), [1.0, None, 0.0, 0.0])]
    df = spark.createDataFrame(rows, f"id {ids}, v array<double>").repartition(5)
    asked = df.where(F.col("id").isin([name(i) for i in range(0, 120, 10)])).withColumnRenamed("id", "query_id")
    got = {}
    for x in search.batch_top_vectors(df, asked, 7, "id", "v").collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.id, round(x.score, 9)))
    size = np.linalg.norm(v, axis=1)
    for q in range(0, 120, 10):
        score = [float(v[q] @ v[i] / (size[q] * size[i])) if size[q] * size[i] else 0.0 for i in range(120)]
        best = sorted(range(120), key=lambda i: (-round(score[i], 12), name(i)))[:7]
        assert [(n, s) for n, _, s in sorted(got[name(q)])] == [(k + 1, round(score[i], 9)) for k, i in enumerate(best)]
    assert search.batch_top_vectors(df, asked.limit(0), 7, "id", "v").count() == 0


def test_faces_are_clustered_as_by_a_plain_loop(spark):
    r = np.random.default_rng(1)
    rows = [(m, f"f{m}-{i:02d}", r.standard_normal(4).tolist()) for m in ("x", "y") for i in range(20)]
    df = spark.createDataFrame(rows, "media_id string, face_id string, vector array<double>")
    got = {x.face_id: x.person for x in faces.cluster_in_order(df, 0.4).collect()}
    for m in ("x", "y"):
        founders = []
        for _, face, v in sorted(x for x in rows if x[0] == m):
            near = sorted(((1 - np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w), k) for k, (_, w) in enumerate(founders)))
            if near and near[0][0] <= 0.4:
                assert got[face] == founders[near[0][1]][0]
            else:
                assert got[face] == face
                founders.append((face, v))
    assert len(set(got.values())) < len(got)


def test_voices_are_enrolled_as_by_a_plain_loop(spark):
    r = np.random.default_rng(2)
    rows = [(i % 2, i, r.standard_normal(3).tolist(), 0.0, 0.2 if i % 5 == 0 else 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "registry int, segment_id int, embedding array<double>, start double, end double")
    got = {x.segment_id: x.voice for x in voices.enrol(df, "registry", 0.8).collect()}
    assert set(got) == {i for i in range(60) if i % 5}
    for registry in (0, 1):
        known = []
        for _, i, v, _, end in (x for x in rows if x[0] == registry and x[4] > 0.25):
            unit = np.array(v) / np.linalg.norm(v)
            best = max(((unit @ p, -k) for k, p in enumerate(known)), default=(-1, 0))
            if best[0] >= 0.8:
                assert got[i] == f"voice-{1 - best[1]:04d}"
            else:
                known.append(unit)
                assert got[i] == f"voice-{len(known):04d}"
    assert voices.usable_segments(df, 0.1, 0.5).count() == 12


def test_loud_runs_become_speech(spark):
    rate = 1_000
    wave = np.zeros(3 * rate)
    wave[500:1000], wave[1050:1500], wave[2000:2050] = 0.5, 0.5, 0.5  # a short gap is bridged, a short run left out
    df = spark.createDataFrame([(1, wave.tolist()), (2, [])], "media_id int, samples array<double>")
    (r,) = enrichment.speech_spans(df, rate).collect()
    assert r.media_id == 1 and abs(r.start_seconds - 0.5) < 0.04 and abs(r.end_seconds - 1.5) < 0.04


def test_clicks_have_a_tempo(spark):
    rate, wave = 1_000, np.zeros(10_000)
    for k in range(20):
        wave[200 + 500 * k : 260 + 500 * k] = 0.8
    df = spark.createDataFrame([(1, wave.tolist()), (2, []), (3, None)], "media_id int, samples array<double>")
    got = {r.media_id: r for r in enrichment.with_tempo(df, rate).collect()}
    assert (got[1].tempo_bpm, got[1].tempo_onset_count) == (120.0, 20) and got[1].tempo_confidence == 1.0
    assert np.allclose(np.diff(got[1].onsets), 0.5) and (got[2].tempo_bpm, got[2].onsets, got[3].tempo_onset_count) == (None, [], 0)


def test_events_that_may_change_the_index(spark):
    rows = [("modify_data", "/images/cat.JPG"), ("modify_data", "/images/readme.txt"), ("rename", "/images/album"), ("modify_data", "/images/album"), ("access", "/images/cat.jpg"), ("remove_folder", "/images/.cache"), ("any", None)]
    e = spark.createDataFrame(rows, "kind string, path string")
    assert {tuple(r) for r in watch.relevant(e).collect()} == {rows[0], rows[2], rows[5], rows[6]}


def test_files_of_workflows_and_voices(spark, tmp_path):
    flow = processors.load_workflow('{"nodes": [{"id": "a", "processor": "load", "x": 1}, {"id": "b", "processor": "index", "config": {"n": 2}}], "edges": [["a", "b"]]}')
    assert flow.nodes[1].config == {"n": 2} and processors.problems(flow, {"load", "index"}, ["load"], "index") == []
    (tmp_path / "v.json").write_text('{"id": "voice-0001", "label": "Ann", "embeddings": [[1, 2]]}\nnot json\n{"label": "nobody"}\n')
    assert [(r.id, r.label, r.embeddings) for r in identity.load_registry(spark, str(tmp_path / "v.json")).collect()] == [("voice-0001", "Ann", [[1.0, 2.0]])]


def test_faces_of_a_medium_apart_and_keywords_in_order(spark):
    f = spark.createDataFrame([([(1, [1.0, 0.0]), (2, [0.99, 0.1]), (3, [0.0, 1.0])],)], "faces array<struct<face_id:int,vector:array<double>>>")
    assert [x.face_id for x in f.select(faces.first_apart(F.col("faces"), 0.1).alias("f")).first().f] == [1, 3]
    raw = spark.createDataFrame([(1, 2, "travel"), (1, 1, "Travel"), (1, 3, "Sunrise")], "media_id int, place int, keyword string")
    assert enrichment.collected_keywords(raw).first().keywords == ["Travel", "Sunrise"]


def test_face_search_joins_media_that_pass(spark):
    f = spark.createDataFrame([(f"f{i}", f"m{i // 2}", f"p{i % 3}", None if i < 3 else f"L{i}", [1.0, i / 10]) for i in range(8)], "face_id string, media_id string, person_id string, person_label string, vector array<double>")
    m = spark.createDataFrame([(f"m{i}", "a" if i < 3 else "b", f"z{9 - i}") for i in range(4)], "id string, source_type string, filename string")
    people, media = faces.face_search(f, m, [1.0, 0.0], filters.SearchFilters(source_type="a"), 2)
    assert [(r.person_id, r.label, r.face_count) for r in people.collect()] == [("p0", "L3", 2), ("p1", "L4", 2)]
    assert [(r.id, r.matched_person_id, r.face_ids) for r in media.collect()] == [("m0", "p1", ["f0", "f1"]), ("m1", "p0", ["f2", "f3"])]


def test_albums_are_checked_and_loaded():
    with pytest.raises(ValueError, match="name is required"):
        albums.SmartAlbum("  ")
    with pytest.raises(ValueError, match="control"):
        albums.SmartAlbum("a\nb")
    with pytest.raises(ValueError, match="80"):
        albums.SmartAlbum("a" * 81)
    with pytest.raises(ValueError, match="limit"):
        albums.SmartAlbum("a", limit=501)
    with pytest.raises(ValueError, match="camera_query"):
        albums.SmartAlbum("a", filters.SearchFilters(camera="c" * 161))
    with pytest.raises(ValueError):
        albums.SmartAlbum("a", sort="colour")
    saved = {"albums": [{"name": " Trips ", "limit": 5, "unknown": 1, "criteria": {"keyword": " sea ", "x": 1}}]}
    (album,) = albums.load_albums(json.dumps(saved))
    assert (album.name, album.limit, album.criteria.keyword) == ("Trips", 5, "sea") and albums.load_albums(None) == []


def test_profile_follows_every_setting():
    base = profile.indexing_profile({"vector_size": 512, "gif_motion_weight": 0.2})
    assert base.startswith("v6:") and len(base) == 67 and base == profile.indexing_profile({"gif_motion_weight": 0.2, "vector_size": 512, "other": 1})
    assert base != profile.indexing_profile({"vector_size": 512, "gif_motion_weight": 0.25})


def cuts(spark, duration, speech, onsets):
    span = "array<struct<start_seconds:double,end_seconds:double>>"
    df = spark.createDataFrame([(duration, speech, onsets)], f"d double, s {span}, o array<double>")
    d, s, o = F.col("d"), F.col("s"), F.col("o")
    return [tuple(x) for x in df.select(segments.audio_bits(d, temporal.speech_boundaries(d, s, o), s, o).alias("x")).first().x]


def test_audio_is_cut_at_speech_onsets_and_thirty_seconds(spark):
    assert cuts(spark, 60.0, [(10.0, 20.0)], []) == [(10.0, 20.0, "speech", 1.0)]
    assert cuts(spark, 70.0, [], []) == [(0.0, 30.0, "audio", 0.25), (30.0, 60.0, "audio", 0.25), (60.0, 70.0, "audio", 0.25)]
    assert cuts(spark, 20.0, [], [3.0, 9.0, 9.5, 18.0]) == [(0.0, 9.0, "music_or_sound", 0.25), (9.0, 18.0, "music_or_sound", 2 / 6), (18.0, 20.0, "music_or_sound", 0.25)]
    assert cuts(spark, 0.5, [], []) == [(0.0, 0.5, "audio", 0.25)] and cuts(spark, 0.0, [], []) == []
    assert cuts(spark, 12.0, [(2.0, 5.0), (5.1, 20.0)], []) == [(2.0, 5.0, "speech", 1.0), (5.0, 12.0, "speech", 6.9 / 7.0)]


def test_spoken_identities(spark):
    audio = {"recognized_voices": [("b", "Bo", 1, 1.0, 0.9), ("c", None, 0, 2.0, 0.5), ("a", "An", 2, 3.5, 0.75)], "audio_segments": [(0, "speech", 0.0, 1.0, 0.5, "b", "Bo"), (1, "speech", 1.0, 2.0, 0.5, None, None)]}
    m = spark.createDataFrame([("m", json.dumps({"id": "m"}))], "id string, j string")
    kind = "struct<audio_segments:array<struct<segment_index:int,kind:string,start_seconds:double,end_seconds:double,confidence:float,speaker_id:string,speaker_label:string>>,recognized_voices:array<struct<id:string,label:string,segment_count:int,total_seconds:double,confidence:double>>>"
    m = spark.createDataFrame([("m", "m.mp3", (audio["audio_segments"], audio["recognized_voices"])), ("n", "n.mp3", None)], f"id string, relative_path string, audio_analysis {kind}")
    (r,) = identity.merge_speakers(m, ["b"], "a").where("changed").collect()
    assert [(v.id, v.label, v.segment_count, v.total_seconds, round(v.confidence, 9)) for v in r.audio_analysis.recognized_voices] == [("a", "An", 3, 4.5, 0.8), ("c", None, 0, 2.0, 0.5)]
    assert [(s.speaker_id, s.speaker_label) for s in r.audio_analysis.audio_segments] == [("a", "An"), (None, None)]
    assert identity.first_label(m, "c") is None and identity.has_speaker_anywhere(m, "c") and not identity.has_speaker_anywhere(m, "q")
    assert identity.rename_speaker(m, "a", "Al").where("changed").count() == 1
    got = {x.voice_id: x for x in inverse.speaker_locations(m).collect()}
    assert (got["b"].occurrences, got["b"].start_seconds, got["b"].end_seconds, got["c"].occurrences) == (1, 0.0, 1.0, 1)
    registry = spark.createDataFrame([("a", "An", [[1.0]]), ("b", "Bo", [[2.0]])], "id string, label string, embeddings array<array<double>>")
    assert [(x.id, x.label, x.embeddings) for x in identity.merge_registry(registry, ["b"], "a").collect()] == [("a", "An", [[1.0], [2.0]])]
    assert {x.id: x.label for x in identity.rename_registry(registry, "b", "Ben").collect()} == {"a": "An", "b": "Ben"}
    f = spark.createDataFrame([("f", "p", None), ("g", None, None)], "face_id string, person_id string, person_label string")
    assert [(x.face_id, x.person_label) for x in identity.rename_faces(f, "p", "Pat").where("changed").collect()] == [("f", "Pat")]


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_numbers_dates_and_displays(spark):
    q, e = (lambda s: temporal.rational(F.lit(s))), (lambda s: temporal.lenient_epoch(F.lit(s)))
    r = one(spark, a=q("3/4"), b=q(" 2.5 "), c=q("1/0"), d=q("x"), e=temporal.dms_text_to_decimal(F.lit("52, 30 0"), F.lit("N")), f=temporal.dms_text_to_decimal(F.lit("13/1 24/1 0/1"), F.lit("W")), g=temporal.dms_text_to_decimal(F.lit("a b"), F.lit("N")))
    assert tuple(r)[:4] == (0.75, 2.5, None, None) and (r.e, round(r.f, 9), r.g) == (52.5, -13.4, None)
    r = one(spark, a=e("2024-03-12T10:30:00Z"), b=e("2024:03:12 10:30:00"), c=e("2024-03-12"), d=e("soon"))
    assert tuple(r) == (1710239400.0, 1710239400.0, 1710201600.0, None)
    r = one(spark, a=temporal.frame_delay_ms(F.lit(25.0)), b=temporal.frame_delay_ms(F.lit(0.0)), c=temporal.seconds_to_ms(F.lit(1.2345)))
    assert tuple(r) == (40, 100, 1235)
    r = one(spark, a=text.unescape_xml(F.lit("&lt;b&gt; &amp;lt; &quot;&apos;")), b=text.duration_text(F.lit(1500)), c=text.duration_text(F.lit(61_000)), d=text.percent_text(F.lit(0.256)), e=text.gps_text(F.lit(1.0), F.lit(-2.5)), f=text.camera_label(F.lit("Canon"), F.lit("Canon X")), g=text.camera_label(F.lit("Nikon"), F.lit(" Z ")), h=text.camera_label(F.lit(None).cast("string"), F.lit(" ")))
    assert tuple(r) == ("<b> &lt; \"'", "1.5s", "1:01", "26%", "1.00000, -2.50000", "Canon X", "Nikon Z", None)
    f = spark.createDataFrame([(1, 100, 5.0), (2, 50, 1e9)], "id int, width int, modified_at double")
    assert [r.id for r in f.where(filters.conjunction(filters.client_filters({"min_width": "60", "date_to": "1970-01-01", "max_width": "0"}))).collect()] == [1]


def test_payloads_have_all_fields(spark):
    m = spark.createDataFrame([("a", 5, "x")], "id string, width bigint, other string")
    full = schema.complete(m)
    r = full.first()
    assert full.columns == list(schema.MEDIA_FIELDS) and dict(full.dtypes)["width"] == "int" and (r.id, r.width, r.media_kind, r.tags, r.phash) == ("a", 5, "static_image", [], None)
    assert tables.check_schema(full, schema.media_schema()) == []


def test_labels_of_people(spark):
    face = "array<struct<person_id:string,person_label:string>>"
    m = spark.createDataFrame([("a", [("p", " ")], [("p", None), ("q", "Quin")]), ("b", [("q", None)], [("p", "Pat")])], f"id string, people array<struct<person_id:string,label:string>>, faces {face}")
    f = spark.createDataFrame([("f1", "r", ""), ("f2", "r", "Rae")], "face_id string, person_id string, person_label string")
    assert [identity.first_person_label(m, f, p) for p in "pqrx"] == ["Pat", "Quin", "Rae", None]
    with pytest.raises(LookupError):
        identity.require_person(m, f, "x")
    identity.require_person(m, f, "r")


def test_responses(spark):
    m = spark.createDataFrame([("a", "f", 1.0)], "id string, filename string, score double")
    r = search.response(m, text=True).first()
    assert (r.vector_score, r.relevance_score, r.text_score, r.phash_distance, r.near_duplicate) == (1.0, 1.0, 1.0, None, False)
    parts = [spark.createDataFrame(rows, "id string, score double") for rows in ([("a", 0.5), ("b", 0.2)], [("a", 0.5), ("b", 0.9)])]
    assert [(x.id, x.part, x.score) for x in search.merged_parts(parts, "id", "score").collect()] == [("b", 1, 0.9), ("a", 0, 0.5)]


def test_queries_of_unequal_length_do_not_change_each_other(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0, 0.0]), (4, []), (5, None), (6, [1.0, None])], "id long, v array<double>")
    asked = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 0.0, 1.0]), (12, None), (13, [None, 1.0]), (14, []), (10, [1.0, 0.0])], "query_id long, v array<double>")
    found = search.batch_top_vectors(vectors, asked, 5, "id", "v")
    assert sorted((r.query_id, r["rank"], r.id, r.score) for r in found.collect()) == [(10, 1, 1, 1.0), (10, 2, 2, 0.0), (11, 1, 3, 0.0), (14, 1, 4, 0.0)]
    for q in (10, 11, 14):
        alone = search.batch_top_vectors(vectors, asked.where(f"query_id = {q}"), 5, "id", "v")
        assert {(r.id, r.score) for r in alone.collect()} == {(r.id, r.score) for r in found.collect() if r.query_id == q}
