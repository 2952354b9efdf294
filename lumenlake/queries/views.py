"""Payload rows, places, statuses, nested responses, client sorts, voices and membership filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.operators import filters, payload, voices
from lumenlake.queries.people import founding_sql
from lumenlake.queries.registry import MEDIA_SQL, media, query, rounded

KINDS = ("static_image", "video_scene", "audio", "pdf_page")


@query("""
WITH items AS (SELECT p_partkey AS k, 's3://b/' || p_partkey AS u, (['static_image', 'video_scene', 'audio', 'pdf_page'])[p_partkey % 4 + 1] AS kind, CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE p_size % 3 + 1 END AS n FROM part),
p AS (SELECT *, unnest(range(0, n)) AS i FROM items)
SELECT CASE kind WHEN 'static_image' THEN u WHEN 'video_scene' THEN u || '#scene=' || i WHEN 'audio' THEN u || '#audio-bit=' || i ELSE u || '#page=' || i END AS uri, kind AS media_kind,
  CASE kind WHEN 'static_image' THEN 'f' || k || '.x' WHEN 'video_scene' THEN printf('f%d scene %03d', k, i + 1) WHEN 'audio' THEN printf('f%d segment %03d', k, i + 1) ELSE printf('f%d page %03d', k, i + 1) END AS filename,
  CASE WHEN kind IN ('video_scene', 'audio') THEN printf('/p/%d#t=%.3f,%.3f', k, i * 2.5::DOUBLE, i * 2.5::DOUBLE + 2) ELSE '/p/' || k END AS path FROM p
UNION ALL SELECT u || '#document', 'pdf_document', 'f' || k || '.x', '/p/' || k FROM items WHERE kind = 'pdf_page'""")
def payload_parts(t) -> DataFrame:
    k = F.col("p_partkey")
    n = F.when(k % 4 == 0, 1).otherwise(F.col("p_size") % 3 + 1)
    span = lambda i: F.struct((i * 2.5).alias("start_seconds"), (i * 2.5 + 2).alias("end_seconds"))
    items = t("part").select(
        F.concat(F.lit("s3://b/"), k.cast("string")).alias("item_uri"), F.concat(F.lit("/p/"), k.cast("string")).alias("path"), F.concat(F.lit("f"), k.cast("string")).alias("stem"),
        F.lit(".x").alias("extension"), F.get(F.array(*map(F.lit, KINDS)), (k % 4).cast("int")).alias("media_kind"), F.transform(F.sequence(F.lit(0), n.cast("int") - 1), span).alias("parts"),
    )
    return payload.media_parts(items).select("uri", "media_kind", "filename", "path")


@query("SELECT page_id AS id, CASE WHEN page_id % 3 = 0 THEN 'gif' || page_id WHEN page_id % 3 = 1 THEN 'jpg' || page_id END AS thumbnail, CASE WHEN page_id % 2 = 0 THEN 'clip' || page_id ELSE url END AS media_url FROM pages")
def place_fallbacks(t) -> DataFrame:
    i = F.col("page_id")
    name = lambda p: F.concat(F.lit(p), i.cast("string"))
    none = F.lit(None).cast("string")
    m = t("pages").select(
        i.alias("id"), F.when(i % 3 == 0, name("gif")).alias("animated_thumbnail_url"), F.when(i % 3 == 2, " ").otherwise(name("jpg")).alias("thumbnail_url"), F.when(i % 2 == 0, name("clip")).alias("scene_clip_url"),
        none.alias("full_video_url"), F.lit("").alias("full_audio_url"), none.alias("pdf_page_url"), none.alias("full_pdf_url"), F.col("url").alias("path"),
    )
    return payload.place(m)


@query("SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'ready' ELSE 'unavailable' END WHEN 1 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'ready' ELSE 'unavailable' END WHEN 2 THEN 'not_implemented' WHEN 3 THEN 'unsupported' ELSE 'unavailable' END AS status FROM supplier")
def source_status(t) -> DataFrame:
    k = F.col("s_suppkey")
    spec = F.concat(F.get(F.array(*map(F.lit, ("/m/", "S3://b/", "camera://", "ftp://", "minio://"))), (k % 5).cast("int")), k.cast("string"))
    rows = t("supplier").select(spec.alias("spec"), F.when(k % 5 != 4, k % 2 == 0).alias("reachable"))
    return payload.source_status(rows).select(F.regexp_extract("spec", "([0-9]+)$", 1).cast("long").alias("s_suppkey"), "status")


@query("SELECT CASE WHEN bool_or(s_acctbal < -900) THEN 'not_ready' ELSE 'ready' END AS status, count(*) FILTER (s_acctbal >= 0) AS ok, count(*) AS checks FROM supplier")
def readiness_rollup(t) -> DataFrame:
    status = F.when(F.col("s_acctbal") < -900, "error").when(F.col("s_acctbal") < 0, "warn").otherwise("ok")
    return payload.rolled_up(t("supplier").select(status.alias("status")))


@query("""
WITH r AS (SELECT event_type AS part, event_id AS id, value AS score, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS n FROM events QUALIFY n <= 50)
SELECT part, count(*) AS count, arg_min(id, n) AS first, arg_max(id, n) AS last FROM r GROUP BY part""")
def response_by_part(t) -> DataFrame:
    rows = t("events").select(F.col("event_type").alias("part"), F.col("event_id").alias("id"), F.col("value").alias("score"), F.lit("0" * 16).alias("phash"))
    r = payload.response_parts(rows)
    return r.select("part", "count", F.get("results", F.lit(0))["id"].alias("first"), F.get("results", F.size("results") - 1)["id"].alias("last"))


@query("SELECT conv_id, arg_min(role, turn) FILTER (role <> 'system') AS analysis FROM conversations GROUP BY conv_id")
def first_analysis(t) -> DataFrame:
    parts = t("conversations").select("conv_id", "turn", F.when(F.col("role") != "system", F.col("role")).alias("analysis"))
    return payload.first_analysis(parts, "conv_id", "turn", "analysis")


CLIENT = {
    "captured": "c DESC NULLS LAST", "filename": "lower(filename)", "modified": "modified_at DESC", "distance": "d NULLS LAST",
    "relevance": "r DESC", "size": "size_bytes DESC", "vector": "v DESC NULLS LAST",
}


def _client(sort: str, order: str):
    sql = f"""WITH {MEDIA_SQL}, x AS (SELECT *, photo_capture_time_epoch AS c, CASE WHEN id % 4 <> 0 THEN id % 13 END AS d, (id * 7 % 101) / 101.0::DOUBLE AS r, CASE WHEN id % 3 <> 0 THEN (id * 11 % 97) / 97.0::DOUBLE END AS v FROM media)
SELECT id FROM x ORDER BY {order}, d NULLS LAST, lower(filename), lower(relative_path), id LIMIT 50"""

    def run(t) -> DataFrame:
        i = F.col("id")
        x = media(t).withColumns({
            "phash_distance": F.when(i % 4 != 0, i % 13), "relevance_score": (i * 7 % 101) / F.lit(101.0), "vector_score": F.when(i % 3 != 0, (i * 11 % 97) / F.lit(97.0)),
        })
        return x.orderBy(*payload.client_order(sort)).limit(50).select("id")

    run.__name__ = f"client_sort_{sort}"
    return query(sql)(run)


for _sort, _order in CLIENT.items():
    _client(_sort, _order)


@query("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey ORDER BY n DESC, round(total, 2) DESC, o_custkey LIMIT 25")
def registry_sorted(t) -> DataFrame:
    rows = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return payload.registry_order(rows.withColumn("name", F.lpad(F.col("o_custkey").cast("string"), 12, "0")), ["n", "total"], "name").limit(25).drop("name")


@query("WITH r AS (SELECT doc_id AS file_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) SELECT file_id FROM r WHERE n = 1 ORDER BY file_id LIMIT 120")
def seed_distinct_content(t) -> DataFrame:
    files = t("documents").select(F.col("doc_id").alias("file_id"), F.encode("text", "UTF-8").alias("content"))
    return payload.first_by_content(files, 120).select("file_id")


@query("SELECT conv_id AS media_id, role AS voice_id, arg_min('L' || (turn * 7 % 5), turn) FILTER (turn % 3 > 0) AS label, count(*) AS segment_count, round(sum((length(text) % 40) / 8.0::DOUBLE), 3) AS total_seconds, round(least(1.0, greatest(0.0, avg((turn % 5) / 3.0::DOUBLE))), 6) AS confidence FROM conversations GROUP BY 1, 2")
def recognised_voices(t) -> DataFrame:
    seg = t("conversations").select(
        F.col("conv_id").alias("media_id"), F.col("role").alias("voice_id"), F.when(F.col("turn") % 3 > 0, F.concat(F.lit("L"), (F.col("turn") * 7 % 5).cast("string"))).alias("label"), (F.col("turn") * 1.0).alias("start"),
        (F.col("turn") + (F.length("text") % 40) / 8.0).alias("end"), ((F.col("turn") % 5) / F.lit(3.0)).alias("score"),
    )
    return voices.recognised(seg).withColumn("confidence", rounded(F.col("confidence")))


@query(founding_sql("SELECT vec_id // 40 AS g, vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 7 >= 3", 0.1) + """
SELECT g AS registry, id AS segment_id, printf('voice-%04d', number) AS voice, 'Voice ' || number AS label, round(score, 6) AS score FROM found""")
def voice_enrolment(t) -> DataFrame:
    i = F.col("vec_id")
    seg = t("embeddings").select(F.floor(i / 40).alias("registry"), i.alias("segment_id"), "embedding", F.lit(0.0).alias("start"), ((i % 7) / 10.0).alias("end"))
    return voices.enrol(seg, "registry", 0.1).withColumn("score", rounded(F.col("score")))


@query("SELECT conv_id AS id FROM conversations WHERE role = 'system' GROUP BY conv_id UNION SELECT conv_id FROM conversations WHERE role = 'user' AND turn = 4")
def speaker_membership(t) -> DataFrame:
    c = t("conversations").groupBy(F.col("conv_id").alias("id")).agg(
        F.transform(F.collect_list(F.struct("turn", "role")), lambda x: F.struct(x["role"].alias("id"))).alias("v"), F.max(F.when((F.col("role") == "user") & (F.col("turn") == 4), "system")).alias("s")
    )
    audio = F.struct(F.col("v").alias("recognized_voices"), F.array(F.struct(F.col("s").alias("speaker_id"))).alias("audio_segments"))
    return c.select("id", audio.alias("audio_analysis")).where(filters.has_speaker("system")).select("id")


@query("SELECT media_id AS id FROM (SELECT vec_id // 4 AS media_id, vec_id % 9 AS p FROM embeddings) WHERE p = 3 GROUP BY media_id")
def person_membership(t) -> DataFrame:
    person = F.struct((F.col("vec_id") % 9).cast("string").alias("person_id"))
    rows = t("embeddings").groupBy(F.floor(F.col("vec_id") / 4).alias("id")).agg(F.collect_list(person).alias("people"))
    return rows.where(filters.has_person("3")).select("id")


@query("SELECT conv_id AS id FROM conversations WHERE contains(lower(text), 'the ') GROUP BY conv_id")
def album_text_contains(t) -> DataFrame:
    rows = t("conversations").groupBy(F.col("conv_id").alias("id")).agg(F.transform(F.collect_list("text"), lambda x: F.struct(x.alias("text"))).alias("transcript_segments"))
    audio = F.struct(F.lit(None).cast("string").alias("transcript_text"), "transcript_segments").alias("audio_analysis")
    m = rows.select("id", F.lit("").alias("ocr_text"), F.expr("cast(array() as array<struct<text:string>>)").alias("ocr_frames"), audio)
    return m.where(filters.album_text_matches("THE ")).select("id")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0")
def record_is_current(t) -> DataFrame:
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    same = filters.same_size_time_profile(
        F.col("o_custkey"), F.when(k % 3 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")), price, F.when(k % 5 == 0, price + 0.01).otherwise(price + 0.0004),
        F.lit("v6"), F.when(k % 7 == 0, None).otherwise("v6"),
    )
    return t("orders").where(same).select("o_orderkey")


@query(f"WITH {MEDIA_SQL} SELECT id FROM media WHERE photo_capture_time_epoch BETWEEN 1600500000 AND 1610000000 AND size_bytes <= 3000")
def capture_time_range(t) -> DataFrame:
    f = filters.SearchFilters(captured_from=1600500000, captured_to=1610000000, size_max=3000)
    return media(t).where(filters.conjunction(filters.pushed(f))).select("id")
