"""Column functions and kernels against literal expectations."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.functions import ids, similarity, temporal, text
from lumenlake.operators import enrichment, faces, filters, inverse


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_relevance_prefers_near_duplicates(spark):
    r = one(
        spark,
        near=similarity.relevance(F.lit(0.2), F.lit(1), 8),
        far=similarity.relevance(F.lit(0.99), F.lit(32), 8),
        none=similarity.relevance(F.lit(0.75), F.lit(None).cast("int"), 8),
    )
    assert r.near > r.far == 0.99 and r.none == 0.75


def test_hamming(spark):
    h = lambda a, b: similarity.hamming_hex(F.lit(a), F.lit(b))
    r = one(spark, a=h("0" * 16, "f" * 16), b=h("8000000000000001", "0" * 16), bad=h("xyz", "0" * 16))
    assert (r.a, r.b, r.bad) == (64, 2, None)


def test_uuid5(spark):
    for name in ("s3://a/b.jpg", "", "ü"):
        assert one(spark, u=ids.uuid5(F.lit(name))).u == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_group_id_follows_members(spark):
    r = one(spark, a=ids.group_id(F.array(F.lit("a"), F.lit("b"))))
    assert r.a == "duplicate-" + uuid.uuid5(uuid.NAMESPACE_URL, "a\nb").hex[:12]


@pytest.mark.parametrize(
    "s, epoch",
    [
        ("2024-03-12T10:30:00Z", 1710239400.0),
        ("2024-03-12 10:30:00.5+01:00", 1710235800.5),
        ("2024-03-12", None),
        ("2024:03:12 10:30:00", None),
        ("2024-03-12T10:30:00", None),
        ("2024-13-12T10:30:00Z", None),
    ],
)
def test_rfc3339(spark, s, epoch):
    assert one(spark, e=temporal.rfc3339_epoch(F.lit(s))).e == epoch


@pytest.mark.parametrize("query, score", [("total due", 1.0), ("invoice total", 1.0), ("receipt", None), (" ", 0.0)])
def test_match_score(spark, query, score):
    assert one(spark, s=text.match_score(query, F.lit("Total  due invoice 2026"))).s == score


def test_texts(spark):
    tags = F.array(*map(F.lit, (" travel ", "Travel", "", "archive")))
    frames = F.array(F.lit(" A  b"), F.lit("a B"), F.lit(" "), F.lit("c"))
    r = one(
        spark,
        tags=text.normalise_tags(tags),
        ocr=text.ocr_text(frames),
        same=text.merge_page_text(F.lit("Invoice 123"), F.lit("invoice 123")),
        both=text.merge_page_text(F.lit("Invoice 123"), F.lit("Total due")),
        keys=text.split_keywords(F.lit("Travel, travel;Sunrise")),
        size=text.file_size(F.lit(1536)),
        more=text.compact_list(F.array(*map(F.lit, "abcdef"))),
    )
    assert r.tags == ["travel", "archive"] and r.ocr == "A b c"
    assert (r.same, r.both) == ("Invoice 123", "Invoice 123 Total due")
    assert r["keys"] == ["Travel", "Sunrise"] and r.size == "1.5 KB" and r.more == "a, b, c, d +2"


def test_gps(spark):
    r = one(
        spark,
        n=temporal.dms_to_decimal(F.lit(52), F.lit(30), F.lit(0), F.lit("N")),
        w=temporal.dms_to_decimal(F.lit(13), F.lit(24), F.lit(0), F.lit("W")),
    )
    assert (r.n, round(r.w, 9)) == (52.5, -13.4)


def test_even_sample(spark):
    items = F.array(*map(F.lit, range(10)))
    r = one(spark, a=temporal.even_sample(items, 4), b=temporal.even_sample(items, 1), c=temporal.even_sample(items, 20))
    assert r.a == [(i * 9 + 1) // 3 for i in range(4)] and r.b == [0] and len(r.c) == 10


def test_overlap_is_strict_and_open_ends_match(spark):
    o = lambda *v: temporal.overlaps(*[F.lit(x).cast("double") for x in v])
    r = one(spark, touch=o(0, 1, 1, 2), inside=o(0, 1.1, 1, 2), no_end=o(1.5, None, 1, 2), no_start=o(None, 1, 1, 2), none=o(None, None, 1, 2))
    assert tuple(r) == (False, True, True, False, True)


def test_scene_slice(spark):
    from lumenlake.operators.segments import transcript_slice

    spans = lambda *s: F.array(*[F.struct(F.lit(a).alias("start_seconds"), F.lit(b).alias("end_seconds"), F.lit(t).alias("text")) for a, b, t in s])
    speech = spans((0.2, 1.1, ""), (2.2, 2.8, ""))
    said = spans((0.1, 0.9, "a"), (1.2, 2.4, "b"), (3.0, 3.4, "c"))
    r = one(spark, s=transcript_slice(said, speech, F.lit(1.0), F.lit(2.5)), none=transcript_slice(said, speech, F.lit(9.0), F.lit(10.0)))
    assert r.s.text == "b" and len(r.s.speech) == 2 and round(r.s.speech_ratio, 9) == round(0.4 / 1.5, 9) and r.none is None


def test_gif_duration(spark):
    assert one(spark, d=temporal.total_delay_ms(F.array(*[F.lit(70)] * 4))).d == 280


def test_voice_merge(spark):
    v = spark.createDataFrame([("a", 1, 1.0, 0.9), ("a", 2, 3.5, 0.75)], "id string, segment_count int, total_seconds double, confidence double")
    r = inverse.merge_voices(v, ["id"]).first()
    assert (r.segment_count, r.total_seconds, round(r.confidence, 9)) == (3, 4.5, 0.8)


def test_vote_ties_go_to_the_last_person(spark):
    m = spark.createDataFrame([("f", "a", "A", 0.9, 0), ("f", "b", None, 0.9, 1), ("f", "c", None, 0.1, 2)], "face string, person_id string, person_label string, score double, ord int")
    r = faces.vote(m, "face", 0.38).first()
    assert (r.person_id, r.votes, r.confidence) == ("b", 1, 0.9)


def test_color_vector_is_unit_and_by_channel():
    v = enrichment.color_vector(np.tile(np.array([255, 0, 0], np.uint8), 16), 10)
    assert np.isclose(np.linalg.norm(v), 1) and v[:4].all() and not v[4:].any()
    assert enrichment.channel_ranges(10) == [(0, 4), (4, 3), (7, 3)]


def test_motion_keeps_its_weight_above_one():
    r = np.random.default_rng(0)
    frames = [r.integers(0, 256, (4, 4, 3)).astype(np.uint8) for _ in range(2)]
    move = enrichment.color_vector(np.abs(frames[1].astype(int) - frames[0].astype(int)).astype(np.uint8), 12)
    assert np.allclose(enrichment.motion_vector(frames, [10, 10], 12, 3.0), move)
    content = enrichment.unit(sum(enrichment.color_vector(f, 12) / 2 for f in frames))
    assert np.allclose(enrichment.motion_vector(frames, [10, 10], 12, 0.2), enrichment.unit(0.8 * content + 0.2 * move))


def test_motion_vector_without_motion_is_content():
    f = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    assert np.allclose(enrichment.motion_vector([f], [70], 12, 0.2), enrichment.color_vector(f, 12))


def test_hash_is_stable_under_brightness():
    g = np.random.default_rng(0).integers(0, 200, (64, 64)).astype(float)
    assert enrichment.dct_hash(g) == enrichment.dct_hash(g + 20) and len(enrichment.dct_hash(g)) == 16


def test_hash_is_that_of_a_transform_by_its_definition(spark):
    import math

    r = np.random.default_rng(3)
    for w, h in ((8, 8), (32, 32), (50, 41)):
        rgb = r.integers(0, 256, (h, w, 3)).astype(np.uint8)
        gray = rgb @ np.array([0.299, 0.587, 0.114])
        small = [[gray[y * h // 32][x * w // 32] for x in range(32)] for y in range(32)]
        low = [
            sum(small[y][x] * math.cos(math.pi * u * (2 * y + 1) / 64) * math.cos(math.pi * v * (2 * x + 1) / 64) for y in range(32) for x in range(32))
            for u in range(8) for v in range(8)
        ]
        middle = sorted(low[1:])[31]
        want = f"{int(''.join('1' if c > middle else '0' for c in low), 2):016x}"
        df = spark.createDataFrame([(bytearray(rgb.tobytes()), w, h), (None, 1, 1)], "data binary, width int, height int")
        assert [x.phash for x in enrichment.with_hashes(df).collect()] == [want, None]


def test_filters_validate():
    with pytest.raises(ValueError):
        filters.SearchFilters(media_kind="film")
    with pytest.raises(ValueError):
        filters.SearchFilters(width_min=5, width_max=2)
    assert filters.SearchFilters(source_type=" all ", name="  ").name is None
