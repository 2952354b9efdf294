"""Text search, normalisation, segments and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.functions import temporal
from lumenlake.functions import text as tx
from lumenlake.operators import deletion, enrichment, search, segments
from lumenlake.operators.filters import SearchFilters
from lumenlake.operators.trigrams import TextIndex
from lumenlake.plans.scratch import scratch_dir
from lumenlake.queries.registry import MEDIA_SQL, media, query, rounded


@query(f"WITH {MEDIA_SQL} SELECT id, filename, 1.0::DOUBLE AS score FROM media WHERE contains(lower(trim(regexp_replace(ocr_text, '\\s+', ' ', 'g'))), 'of the') OR (contains(lower(ocr_text), 'of') AND contains(lower(ocr_text), 'the')) ORDER BY filename, id LIMIT 30")
def text_search_topk(t) -> DataFrame:
    return search.search_text(media(t), "of the", SearchFilters(), 30).select("id", "filename", "score")


def _indexed_search(t, needle: str) -> DataFrame:
    """The rows of a text search by trigram postings of the documents' files."""
    docs = t("documents")
    index = TextIndex(docs.sparkSession, scratch_dir(docs.sparkSession, "trigrams"))
    index.build(docs, lambda: F.array("text"))
    return index.search(docs, needle.lower().split(), tx.holds_terms(needle, F.col("text")))


@query("SELECT doc_id, length(text) AS size FROM documents WHERE contains(lower(text), 'tion') AND contains(lower(text), 'able') AND contains(lower(text), 'zu')")
def trigram_search(t) -> DataFrame:
    return _indexed_search(t, "TION able  zu").select("doc_id", F.length("text").cast("long").alias("size"))


@query(f"WITH {MEDIA_SQL} SELECT id FROM media WHERE contains(lower(ocr_text), 'tion') AND contains(lower(ocr_text), 'able') AND contains(lower(ocr_text), 'ing')")
def text_terms_all_match(t) -> DataFrame:
    return media(t).where(tx.match_score("TION able  ing", F.col("ocr_text")).isNotNull()).select("id")


@query("SELECT doc_id, md5(trim(regexp_replace(text, '[\\s\\x0B\\x85\\p{Z}]+', ' ', 'g'))) AS clean FROM documents")
def whitespace_normalise(t) -> DataFrame:
    return t("documents").select("doc_id", F.md5(tx.collapse_whitespace(F.col("text"))).alias("clean"))


@query("""
WITH l AS (SELECT conv_id, turn, lower(role) AS k, min(turn) OVER (PARTITION BY conv_id, lower(role)) AS first, role FROM conversations)
SELECT conv_id, string_agg(upper(role), ' ' ORDER BY turn) AS roles FROM l WHERE turn = first GROUP BY conv_id""")
def ocr_keep_first_distinct(t) -> DataFrame:
    frames = t("conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.concat(F.lit("  "), F.upper("role")).alias("s")))).alias("f"))
    return frames.select("conv_id", tx.ocr_text(F.transform("f", lambda x: x["s"])).alias("roles"))


@query("SELECT doc_id, lang AS first, CASE WHEN doc_id % 2 = 0 THEN lang || ', Tag' || (doc_id % 8) ELSE lang || ', tag' || (doc_id % 8) END AS tags FROM documents")
def tags_normalised(t) -> DataFrame:
    i = F.col("doc_id")
    number = (i % 8).cast("string")
    raw = F.array(F.concat(F.lit(" "), "lang"), F.upper("lang"), F.lit(" "), F.when(i % 2 == 0, F.concat(F.lit("Tag"), number)).otherwise(F.concat(F.lit("tag"), number)), F.concat(F.lit("TAG"), number))
    tags = tx.normalise_tags(raw)
    return t("documents").select("doc_id", F.get(tags, F.lit(0)).alias("first"), F.array_join(tags, ", ").alias("tags"))


@query("SELECT page_id, split_part(url, '#', 1) AS uri, instr(url, '#') > 0 AS part FROM pages")
def legacy_uri_split(t) -> DataFrame:
    return t("pages").select("page_id", tx.before_fragment(F.col("url")).alias("uri"), F.contains("url", F.lit("#")).alias("part"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'preview=' || split_part(url, '#', 1) || ';page=/p/' || page_id ELSE 'page=/p/' || page_id END AS artifacts FROM pages")
def artifact_manifest(t) -> DataFrame:
    i = F.col("page_id")
    made = deletion.artifact_manifest(("preview", F.when(i % 2 == 0, F.col("url"))), ("clip", F.lit("")), ("page", F.format_string("/p/%d#x", i)))
    return t("pages").select("page_id", F.array_join(F.transform(made, lambda a: F.concat(a["kind"], F.lit("="), a["url"])), ";").alias("artifacts"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props_get(t) -> DataFrame:
    return t("events").select("event_id", tx.json_field(F.col("props"), "$.k", "bigint").alias("k"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(epoch(o_orderdate) AS DOUBLE) + CASE WHEN o_orderkey % 4 = 1 THEN 0 WHEN o_orderkey % 4 = 2 THEN -7200 ELSE 0.25 END END AS epoch FROM orders")
def rfc3339_epoch_of_orders(t) -> DataFrame:
    k, d = F.col("o_orderkey") % 4, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    s = F.when(k == 0, F.substring(d, 1, 10)).when(k == 1, F.concat(d, F.lit("Z"))).when(k == 2, F.concat(d, F.lit("+02:00"))).otherwise(F.concat(d, F.lit(".25z")))
    return t("orders").select("o_orderkey", temporal.rfc3339_epoch(s).alias("epoch"))


SEGMENTS_SQL = "seg AS (SELECT conv_id, turn, role, turn * 2.0::DOUBLE AS a, turn * 2.0::DOUBLE + 1 + (length(text) % 40) / 10.0::DOUBLE AS b FROM conversations), win AS (SELECT conv_id, w, w * 3.0::DOUBLE AS wa, w * 3.0::DOUBLE + 3 AS wb FROM (SELECT conv_id, unnest(range(0, CAST(floor(max(b) / 3) AS BIGINT) + 1)) AS w FROM seg GROUP BY conv_id))"


def _segments(t) -> DataFrame:
    return t("conversations").select("conv_id", "turn", "role", (F.col("turn") * 2.0).alias("start"), (F.col("turn") * 2.0 + 1 + (F.length("text") % 40) / 10.0).alias("end"))


def _windows(t) -> DataFrame:
    """Windows of three seconds over each conversation's whole length."""
    w = F.col("w")
    last = _segments(t).groupBy("conv_id").agg(F.floor(F.max("end") / 3).alias("last"))
    return last.withColumn("w", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last")))).select("conv_id", "w", (w * 3.0).alias("window_start"), (w * 3.0 + 3).alias("window_end"))


OVERLAP_SQL = f"WITH {SEGMENTS_SQL} SELECT s.conv_id, w, turn, round(least(b, wb) - greatest(a, wa), 6) AS seconds FROM seg s JOIN win USING (conv_id) WHERE least(b, wb) - greatest(a, wa) > 0"


@query(OVERLAP_SQL)
def interval_overlap_slice(t) -> DataFrame:
    return _overlap_seconds(segments.join_overlapping(_segments(t), _windows(t), "conv_id"))


@query(OVERLAP_SQL)
def interval_overlap_bucketed(t) -> DataFrame:
    return _overlap_seconds(segments.join_overlapping(_segments(t), _windows(t), "conv_id", bucket=2.0))


@query(OVERLAP_SQL)
def interval_overlap_swept(t) -> DataFrame:
    return _overlap_seconds(segments.join_overlapping(_segments(t), _windows(t), "conv_id", swept=True))


def _overlap_seconds(joined: DataFrame) -> DataFrame:
    return joined.select("conv_id", "w", "turn", rounded(F.least("end", "window_end") - F.greatest("start", "window_start")).alias("seconds"))


def _spans(t) -> DataFrame:
    span = F.struct(F.col("start").alias("start_seconds"), F.col("end").alias("end_seconds"), F.col("role").alias("text"))
    return _segments(t).groupBy("conv_id").agg(F.sort_array(F.collect_list(span)).alias("spans"), F.max("end").alias("duration"))


@query(f"WITH {SEGMENTS_SQL} SELECT conv_id, round(least(1.0, sum(b - a) / max(b)), 6) AS ratio FROM seg GROUP BY conv_id")
def speech_ratio(t) -> DataFrame:
    return _spans(t).select("conv_id", rounded(temporal.speech_ratio(F.col("spans"), F.col("duration"))).alias("ratio"))


@query(f"""WITH {SEGMENTS_SQL}, o AS (SELECT * FROM seg WHERE b > 1 AND a < 2.5)
SELECT conv_id, string_agg(role, ' ' ORDER BY a, b, role) AS text, round(least(1.0, sum(least(b, 2.5) - greatest(a, 1)) / 1.5), 6) AS ratio FROM o GROUP BY conv_id""")
def scene_transcript_slice(t) -> DataFrame:
    start, end = F.lit(1.0), F.lit(2.5)
    cut = segments.transcript_slice(F.col("spans"), F.col("spans"), start, end)
    return _spans(t).withColumn("s", cut).where("s IS NOT NULL").select("conv_id", "s.text", rounded(F.col("s.speech_ratio")).alias("ratio"))


@query(f"WITH {SEGMENTS_SQL} SELECT conv_id, CAST(count(*) FILTER (a >= 1 AND a < 5) AS INT) AS inside FROM seg GROUP BY conv_id")
def onset_point_in_segment(t) -> DataFrame:
    onsets = F.transform("spans", lambda s: s["start_seconds"])
    return _spans(t).select("conv_id", temporal.points_inside(onsets, F.lit(1.0), F.lit(5.0)).alias("inside"))


THIN_SQL = "list_reduce(list_transform(list_sort({0}), lambda x: [x]), lambda acc, x: CASE WHEN x[1] - acc[-1] >= {1} THEN acc || x ELSE acc END)"


@query(f"""
WITH {SEGMENTS_SQL}, c AS (SELECT conv_id, max(b) * 9 AS d, list({{'a': a * 9, 'b': b * 9}} ORDER BY a) FILTER (role = 'user') AS sp, list(a * 9 ORDER BY a) AS ons FROM seg GROUP BY conv_id),
k AS (SELECT conv_id, d, coalesce(sp, []) AS sp, ons, list_reduce(list_prepend([0.0::DOUBLE], list_transform(list_filter(ons, lambda o: o > 0 AND o < d), lambda o: [o])), lambda acc, o: CASE WHEN o[1] - acc[-1] >= 8 THEN acc || o ELSE acc END) AS kept FROM c),
cuts AS (SELECT *, {THIN_SQL.format("list_concat(list_concat([0.0::DOUBLE, d], kept), list_concat(list_transform(sp, lambda s: s.a), list_transform(sp, lambda s: s.b)))", 0.25)} AS cut FROM k),
pieces AS (SELECT *, {THIN_SQL.format("list_concat([cut[-1]], flatten(list_transform(range(1, len(cut)), lambda i: list_transform(range(0, greatest(1, CAST(ceil((cut[i + 1] - cut[i]) / 30) AS BIGINT))), lambda j: cut[i] + 30 * j))))", 0.25)} AS p FROM cuts),
e AS (SELECT conv_id, sp, ons, p[i] AS a, p[i + 1] AS b, i FROM (SELECT *, unnest(range(1, len(p))) AS i FROM pieces)),
h AS (SELECT *, coalesce(list_sum(list_transform(sp, lambda s: greatest(0, least(s.b, b) - greatest(s.a, a)))), 0) AS heard, len(list_filter(ons, lambda o: o >= a AND o < b)) AS hits FROM e),
kept AS (SELECT * FROM h WHERE b - a >= 0.75 AND NOT (heard <= 0 AND hits = 0 AND len(sp) > 0))
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1 AS INT) AS segment_index, round(a, 3) AS start_seconds, round(b, 3) AS end_seconds,
  CASE WHEN heard / (b - a) >= 0.35 THEN 'speech' WHEN hits > 0 THEN 'music_or_sound' ELSE 'audio' END AS kind,
  round(CASE WHEN heard / (b - a) >= 0.35 THEN least(1.0, heard / (b - a)) WHEN hits > 0 THEN greatest(0.25, least(0.85, hits / 6.0)) ELSE 0.25 END, 6) AS confidence FROM kept""")
def segment_boundaries(t) -> DataFrame:
    span = F.struct((F.col("start") * 9).alias("start_seconds"), (F.col("end") * 9).alias("end_seconds"))
    rows = _segments(t).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("role") == "user", span))).alias("speech"), F.sort_array(F.collect_list(F.col("start") * 9)).alias("onsets"), F.max(F.col("end") * 9).alias("duration")
    )
    duration, speech, onsets = F.col("duration"), F.col("speech"), F.col("onsets")
    bits = segments.audio_bits(duration, temporal.speech_boundaries(duration, speech, onsets), speech, onsets)
    cut = rows.select("conv_id", F.posexplode(bits).alias("segment_index", "s")).select("conv_id", "segment_index", "s.*")
    return cut.withColumn("confidence", rounded(F.col("confidence")))


@query("""
WITH c AS (SELECT conv_id, list({'t': trim(text), 'turn': turn} ORDER BY turn) FILTER (trim(text) <> '') AS s FROM conversations GROUP BY conv_id)
SELECT conv_id, md5(array_to_string(list_transform(s, lambda x: x.t), ' ')) AS text, CAST(len(s) AS INT) AS parts FROM c WHERE len(s) > 0""")
def transcript_mapping(t) -> DataFrame:
    part = F.struct(F.col("turn").alias("index"), F.col("turn").cast("double").alias("start_seconds"), (F.col("turn") + 1).cast("double").alias("end_seconds"), F.concat(F.lit(" "), "text").alias("text"), F.lit(0.5).alias("confidence"))
    rows = t("conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("segments"))
    spoken = F.struct(F.lit(None).cast("string").alias("text"), F.lit("en").alias("language"), "segments")
    mapped = rows.select("conv_id", segments.transcript(spoken).alias("m")).where("m IS NOT NULL")
    return mapped.select("conv_id", F.md5("m.text").alias("text"), F.size("m.segments").alias("parts"))


@query("""
WITH a AS (SELECT conv_id, list(turn ORDER BY turn) AS x, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id, array_to_string(CASE WHEN n <= 3 THEN x ELSE [x[1], x[(1 * (n - 1) + 1) // 2 + 1], x[(2 * (n - 1) + 1) // 2 + 1]] END, ',') AS picked FROM a""")
def even_sampling(t) -> DataFrame:
    turns = t("conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("x"))
    return turns.select("conv_id", F.array_join(F.transform(temporal.even_sample(F.col("x"), 3), lambda v: v.cast("string")), ",").alias("picked"))


@query("SELECT * FROM (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn FROM conversations) WHERE next_turn IS NOT NULL")
def lag_pairs(t) -> DataFrame:
    return segments.adjacent_pairs(t("conversations").select("conv_id", "turn"), "conv_id", "turn")


@query("""
WITH f AS (SELECT l_orderkey AS video_id, l_linenumber AS frame FROM lineitem), s AS (SELECT DISTINCT l_orderkey AS video_id, sc AS scene, sc * 3 + 1 AS a, sc * 3 + 4 AS b FROM lineitem, (SELECT unnest([0, 1, 2]) AS sc)),
r AS (SELECT f.video_id, scene, frame, row_number() OVER (PARTITION BY f.video_id, scene ORDER BY frame) AS n FROM f JOIN s ON f.video_id = s.video_id AND frame >= a AND frame < b AND (frame - a) % 2 = 0)
SELECT video_id, CAST(scene AS INT) AS scene, frame FROM r WHERE n <= 1""")
def scene_frame_stride(t) -> DataFrame:
    frames = t("lineitem").select(F.col("l_orderkey").alias("video_id"), F.col("l_linenumber").alias("frame"))
    sc = F.col("scene")
    scenes = frames.select("video_id").distinct().withColumn("scene", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select("video_id", "scene", (sc * 3 + 1).alias("start"), (sc * 3 + 4).alias("end"))
    return segments.scene_frames(frames, scenes, 2, 1).select("video_id", "scene", "frame")


CUTS_SQL = """
WITH RECURSIVE f AS (SELECT source AS video_id, doc_id AS frame, (doc_id // 8 * 37) % 180 AS h, (doc_id // 24 * 53) % 256 AS s, n_chars % 64 AS v FROM documents),
d AS (SELECT *, (abs(h - lag(h) OVER w) + abs(s - lag(s) OVER w) + abs(v - lag(v) OVER w)) / 3.0::DOUBLE AS score FROM f WINDOW w AS (PARTITION BY video_id ORDER BY frame)),
c AS (SELECT video_id, frame, score, row_number() OVER (PARTITION BY video_id ORDER BY frame) AS i FROM d WHERE score IS NULL OR score >= 27),
st AS (SELECT video_id, i, frame AS last, score, frame, true AS cut FROM c WHERE i = 1
  UNION ALL SELECT c.video_id, c.i, CASE WHEN c.frame - last >= 15 THEN c.frame ELSE last END, c.score, c.frame, c.frame - last >= 15 FROM st JOIN c ON c.video_id = st.video_id AND c.i = st.i + 1)
SELECT video_id, frame, round(score, 6) AS score FROM st WHERE cut AND score IS NOT NULL"""


@query(CUTS_SQL)
def scene_cuts(t) -> DataFrame:
    """Cuts of few and long videos, whose frames' mean colours follow the documents."""
    i = F.col("doc_id")
    frames = t("documents").select(F.col("source").alias("video_id"), i.alias("frame"), (F.floor(i / 8) * 37 % 180).alias("hue"), (F.floor(i / 24) * 53 % 256).alias("saturation"), (F.col("n_chars") % 64).alias("value"))
    return segments.content_cuts(frames).withColumn("score", rounded(F.col("score")))


@query("""
WITH f AS (SELECT source AS video_id, doc_id AS frame FROM documents), s AS (SELECT source AS video_id, doc_id AS scene, doc_id AS a, doc_id + 4 + n_chars % 30 AS b FROM documents WHERE doc_id % 10 = 0),
r AS (SELECT video_id, scene, frame, b - a AS length, row_number() OVER (PARTITION BY video_id, scene ORDER BY frame) AS n FROM f JOIN s USING (video_id) WHERE frame >= a AND frame < b AND (frame - a) % 3 = 0)
SELECT video_id, scene, frame, length FROM r WHERE n <= 4""")
def scene_frames_overlapping(t) -> DataFrame:
    """Scenes that overlap, of few and very long videos."""
    d, i = t("documents"), F.col("doc_id")
    frames = d.select(F.col("source").alias("video_id"), i.alias("frame"))
    scenes = d.where(i % 10 == 0).select(F.col("source").alias("video_id"), i.alias("scene"), i.alias("start"), (i + 4 + F.col("n_chars") % 30).alias("end"))
    return segments.scene_frames(frames, scenes, 3, 4).select("video_id", "scene", "frame", (F.col("end") - F.col("start")).alias("length"))


@query("""
WITH raw AS (SELECT doc_id AS media_id, 'exif' AS ns, 'Make' AS k, CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE 'E' || doc_id END AS v FROM documents
  UNION ALL SELECT doc_id, 'xmp', 'make', 'X' || doc_id FROM documents UNION ALL SELECT doc_id, 'iptc', 'Title', 'I' || doc_id FROM documents WHERE doc_id % 2 = 0
  UNION ALL SELECT doc_id, 'exif', 'GPSLatitude', '1' FROM documents UNION ALL SELECT doc_id, 'xmp', 'GPSLatitude', '2' FROM documents WHERE doc_id % 5 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY media_id, lower(k) ORDER BY CASE WHEN lower(k) LIKE 'gps%' AND ns = 'xmp' THEN -1 WHEN ns = 'exif' THEN 0 WHEN ns = 'iptc' THEN 1 ELSE 2 END) AS n FROM raw WHERE trim(v) <> '')
SELECT media_id, lower(k) AS key, v AS value FROM r WHERE n = 1""")
def metadata_first_priority(t) -> DataFrame:
    d = t("documents")
    i = F.col("doc_id")
    row = lambda ns, k, v: F.struct(F.lit(ns).alias("namespace"), F.lit(k).alias("key"), v.alias("value"))
    name = lambda p: F.concat(F.lit(p), i.cast("string"))
    raw = d.select(i.alias("media_id"), F.explode(F.array(
        row("exif", "Make", F.when(i % 3 == 0, " ").otherwise(name("E"))), row("xmp", "make", name("X")), row("iptc", "Title", F.when(i % 2 == 0, name("I"))),
        row("exif", "GPSLatitude", F.lit("1")), row("xmp", "GPSLatitude", F.when(i % 5 == 0, F.lit("2"))))).alias("r")).select("media_id", "r.*")
    return enrichment.first_metadata(raw)


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN -1 ELSE 1 END * round(s_suppkey % 90 + 24 / 60.0 + 36 / 3600.0, 6) AS degrees FROM supplier")
def gps_dms_decimal(t) -> DataFrame:
    k = F.col("s_suppkey")
    return t("supplier").select("s_suppkey", rounded(temporal.dms_to_decimal(k % 90, F.lit(24), F.lit(36), F.when(k % 2 == 0, "w").otherwise("E"))).alias("degrees"))


@query("SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', round(n / 1024.0, 1)) ELSE printf('%.1f MB', round(n / 1048576.0, 1)) END AS size, 'a, b, c, d' || CASE WHEN doc_id % 3 = 0 THEN ' +2' ELSE '' END AS list FROM (SELECT doc_id, n_chars * 32 AS n FROM documents)")
def display_formats(t) -> DataFrame:
    items = F.slice(F.array(*map(F.lit, "abcdef")), 1, F.when(F.col("doc_id") % 3 == 0, 6).otherwise(4))
    return t("documents").select("doc_id", tx.file_size(F.col("n_chars") * 32).alias("size"), tx.compact_list(items).alias("list"))


@query("SELECT item_id, CASE WHEN item_id % 2 = 0 THEN trim(regexp_replace(text, '\\s+', ' ', 'g')) ELSE trim(regexp_replace(text, '\\s+', ' ', 'g')) || ' Total due' END AS text FROM benchmark")
def pdf_text_merge(t) -> DataFrame:
    ocr = F.when(F.col("item_id") % 2 == 0, F.lower(F.substring("text", 1, 10))).otherwise(F.lit("Total  due"))
    return t("benchmark").select("item_id", tx.merge_page_text(F.col("text"), ocr).alias("text"))


@query("SELECT user_id, CAST(sum(CASE WHEN event_id % 4 = 0 THEN 100 ELSE event_id % 4 * 10 END) AS BIGINT) AS duration_ms FROM events GROUP BY user_id")
def gif_duration(t) -> DataFrame:
    delays = t("events").groupBy("user_id").agg(F.collect_list(F.col("event_id") % 4 * 10).alias("d"))
    return delays.select("user_id", temporal.total_delay_ms(F.col("d")).alias("duration_ms"))


COLOR_SQL = """
b AS (SELECT page_id, hex(encode(coalesce(url, ''))) AS h, strlen(coalesce(url, '')) AS n FROM pages),
p AS (SELECT page_id, h, n, unnest(range(0, greatest(1, (n + 2) // 3))) AS px FROM b),
v AS (SELECT page_id, px, c, CASE WHEN px * 3 + c < n THEN CAST('0x' || substr(h, 2 * (px * 3 + c) + 1, 2) AS BIGINT) ELSE 32 END / 255.0::DOUBLE AS x FROM p, (SELECT unnest([0, 1, 2]) AS c)),
s AS (SELECT page_id, CASE c WHEN 0 THEN px % 6 WHEN 1 THEN 6 + px % 5 ELSE 11 + px % 5 END AS spot, sum(x) AS x FROM v GROUP BY 1, 2),
u AS (SELECT page_id, spot, x / sqrt(sum(x * x) OVER (PARTITION BY page_id)) AS x FROM s)"""


@query(f"WITH {COLOR_SQL} SELECT page_id, round(max(x) FILTER (spot = 0), 5) AS first, round(coalesce(max(x) FILTER (spot = 15), 0), 5) AS last, round(sum(x), 4) AS total FROM u GROUP BY page_id")
def color_vector_udf(t) -> DataFrame:
    """The bytes of a whole url as pixels, the last one filled with blanks; a null url is one blank pixel."""
    url = F.coalesce("url", F.lit(""))
    size = F.octet_length(url)
    missing = F.when(size == 0, 3).otherwise(F.pmod(-size, F.lit(3)))
    images = t("pages").select("page_id", F.encode(F.concat(url, F.repeat(F.lit(" "), missing)), "UTF-8").alias("data"))
    found = enrichment.with_color_vectors(images, 16).select("page_id", F.transform("visual", lambda x: x.cast("double")).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return found.select("page_id", rounded(F.get("v", F.lit(0)), 5).alias("first"), rounded(F.get("v", F.lit(15)), 5).alias("last"), rounded(total, 4).alias("total"))


@query()
def perceptual_hash_udf(t) -> DataFrame:
    images = t("pages").select("page_id", F.unhex(F.rpad(F.sha2("html", 256), 384, "0")).alias("data"), F.lit(8).alias("width"), F.lit(8).alias("height"))
    return enrichment.with_hashes(images).select("page_id", "phash")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN -1 ELSE 1 END * round(s_suppkey % 90 + 24.5 / 60 + 36 / 3600.0, 6) AS degrees, CASE WHEN s_suppkey % 7 > 0 THEN round((s_suppkey % 50) / (s_suppkey % 7), 6) END AS quotient, CASE WHEN s_suppkey % 5 > 0 THEN greatest(1, CAST(round(1000.0 / (s_suppkey % 5)) AS INT)) ELSE 100 END AS delay FROM supplier")
def rational_texts(t) -> DataFrame:
    k = F.col("s_suppkey")
    degrees = F.concat((k % 90).cast("string"), F.lit(" 49/2 36"))
    return t("supplier").select(
        "s_suppkey", rounded(temporal.dms_text_to_decimal(degrees, F.when(k % 2 == 0, "w").otherwise("E"))).alias("degrees"),
        rounded(temporal.rational(F.concat((k % 50).cast("string"), F.lit("/"), (k % 7).cast("string")))).alias("quotient"), temporal.frame_delay_ms((k % 5).cast("double")).alias("delay"),
    )


@query(f"WITH {MEDIA_SQL} SELECT id FROM media WHERE width >= 672 AND size_bytes <= 0.003 * 1024 * 1024 AND photo_has_gps AND photo_capture_time_epoch >= 1600473600 AND photo_capture_time_epoch < 1609459200 - 0.001")
def client_filters(t) -> DataFrame:
    from lumenlake.operators.filters import client_filters, conjunction

    asked = {"min_width": " 672 ", "max_width": "-5", "max_size_mb": "0.003", "min_height": "tall", "has_gps": "yes", "capture_from": "2020-09-19", "capture_to": "2020-12-31", "date_to": "never"}
    return media(t).where(conjunction(client_filters(asked))).select("id")
