"""Index planning, deletion, table rewrites, watching and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.operators import deletion, payload, search
from lumenlake.plans import planning
from lumenlake.plans.ledger import IndexLedger
from lumenlake.plans.scratch import materialised, scratch_dir
from lumenlake.queries.registry import MEDIA_SQL, media, query, rounded
from lumenlake.sources.layout import write_clustered
from lumenlake.sources.merge import MergeTable
from lumenlake.sources.tables import VersionedTable
from lumenlake.streaming import watch

SIDES_SQL = """
scan AS (SELECT 'u' || o_orderkey AS uri, o_custkey AS size_bytes, o_totalprice AS modified_at, 'v6' AS profile FROM orders WHERE o_orderkey % 5 <> 0),
idx AS (SELECT 'u' || o_orderkey AS uri, 'pt' || o_orderkey AS point_id, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 1 ELSE o_custkey END AS size_bytes, o_totalprice AS modified_at, 'v6' AS profile, o_orderkey % 11 <> 0 AS complete, o_orderstatus AS source FROM orders WHERE o_orderkey % 3 <> 0),
led AS (SELECT 'u' || o_orderkey AS uri, o_custkey AS size_bytes, o_totalprice AS modified_at, 'v6' AS profile, CASE WHEN o_orderkey % 4 = 0 THEN 'running' ELSE 'completed' END AS status, CASE WHEN o_orderkey % 6 = 2 THEN 'gone' ELSE 'pt' || o_orderkey END AS p FROM orders WHERE o_orderkey % 2 = 0)"""
PLAN_SQL = f"""{SIDES_SQL},
cur AS (SELECT s.uri, i.point_id FROM scan s JOIN idx i ON s.uri = i.uri WHERE s.size_bytes = i.size_bytes AND abs(s.modified_at - i.modified_at) <= 0.001 AND s.profile = i.profile AND i.complete),
plan AS (SELECT s.uri, CASE WHEN l.uri IS NOT NULL THEN CASE WHEN l.status = 'completed' AND EXISTS (SELECT 1 FROM cur c WHERE c.uri = s.uri AND c.point_id = l.p) THEN 'current' ELSE 'pending' END
  WHEN EXISTS (SELECT 1 FROM cur c WHERE c.uri = s.uri) THEN 'current' ELSE 'pending' END AS status FROM scan s LEFT JOIN led l ON s.uri = l.uri)"""


def _sides(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    o, k = t("orders"), F.col("o_orderkey")
    uri, profile = F.concat(F.lit("u"), k.cast("string")).alias("uri"), F.lit("v6").alias("profile")
    size, mtime = F.col("o_custkey").alias("size_bytes"), F.col("o_totalprice").alias("modified_at")
    point = F.concat(F.lit("pt"), k.cast("string"))
    scan = o.where(k % 5 != 0).select(uri, size, mtime, profile)
    indexed = o.where(k % 3 != 0).select(
        uri, point.alias("point_id"), F.when(k % 7 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("size_bytes"), mtime, profile, (k % 11 != 0).alias("complete"), F.col("o_orderstatus").alias("source")
    )
    ledger = o.where(k % 2 == 0).select(
        uri, size, mtime, profile, F.when(k % 4 == 0, "running").otherwise("completed").alias("status"), F.array(F.when(k % 6 == 2, "gone").otherwise(point)).alias("point_ids")
    )
    return scan, indexed, ledger


@query(f"WITH {PLAN_SQL} SELECT uri FROM plan WHERE status = 'pending'")
def plan_pending(t) -> DataFrame:
    return planning.planned(*_sides(t)).where("status = 'pending'").select("uri")


@query(f"WITH {PLAN_SQL} SELECT uri FROM plan WHERE status = 'current'")
def plan_current(t) -> DataFrame:
    return planning.planned(*_sides(t)).where("status = 'current'").select("uri")


@query(f"WITH {SIDES_SQL} SELECT DISTINCT uri, point_id FROM idx WHERE uri NOT IN (SELECT uri FROM scan)")
def plan_prune_anti(t) -> DataFrame:
    scan, indexed, _ = _sides(t)
    return planning.to_prune(indexed, scan)


@query(f"WITH {SIDES_SQL} SELECT DISTINCT uri, point_id FROM idx WHERE source IN ('F', 'P') AND uri NOT IN (SELECT uri FROM scan)")
def plan_prune_scanned_sources(t) -> DataFrame:
    scan, indexed, _ = _sides(t)
    return planning.to_prune(indexed, scan, indexed.where("source IN ('F', 'P')").select("source"))


@query(f"WITH {SIDES_SQL} SELECT i.uri, i.point_id FROM idx i WHERE i.uri IN (SELECT uri FROM scan) AND right(i.uri, 1) = '1'")
def stale_points(t) -> DataFrame:
    scan, indexed, _ = _sides(t)
    produced = scan.select("uri", F.when(F.endswith("uri", F.lit("1")), "new").otherwise(F.concat(F.lit("pt"), F.substr("uri", F.lit(2)))).alias("point_id"))
    return planning.stale_points(indexed.select("uri", "point_id"), produced)


@query(f"WITH {PLAN_SQL} SELECT count(*) AS total, count(*) FILTER (status = 'pending') AS indexed, count(*) FILTER (status = 'current') AS already_indexed, CAST(0 AS BIGINT) AS skipped, CAST(0 AS BIGINT) AS failed FROM plan")
def index_run_totals(t) -> DataFrame:
    status = F.when(F.col("status") == "pending", "indexed").otherwise("already_indexed").alias("status")
    return planning.totals(planning.planned(*_sides(t)).select("uri", status))


@query("SELECT CAST(l_orderkey AS BIGINT) AS order_id FROM lineitem GROUP BY 1 HAVING bool_and(l_returnflag <> 'R')")
def committed_forall(t) -> DataFrame:
    flags = t("lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.collect_set("l_returnflag").alias("f"))
    return flags.where(F.forall("f", lambda x: x != "R")).select("order_id")


@query(f"WITH {MEDIA_SQL}, gone AS (SELECT id FROM media WHERE source_uri = 's3://bucket/src4') SELECT CAST(id AS VARCHAR) AS point_id FROM gone UNION SELECT 'face-' || vec_id FROM embeddings WHERE vec_id // 2 IN (SELECT id FROM gone)")
def delete_cascade(t) -> DataFrame:
    doomed = deletion.matching_media(media(t), source_uri="s3://bucket/src4")
    faces = t("embeddings").select(F.concat(F.lit("face-"), F.col("vec_id").cast("string")).alias("face_id"), F.floor(F.col("vec_id") / 2).alias("media_id"))
    return deletion.deleted_points(faces, doomed)


@query("SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'new' ELSE p_name END AS p_name, p_size FROM part UNION ALL SELECT p_partkey + 100000000, 'added', p_size FROM part WHERE p_partkey % 50 = 0")
def upsert_rewrite(t) -> DataFrame:
    old = t("part").select("p_partkey", "p_name", "p_size")
    new = old.where("p_partkey % 10 = 0").withColumn("p_name", F.lit("new")).unionByName(
        old.where("p_partkey % 50 = 0").withColumns({"p_partkey": F.col("p_partkey") + 100000000, "p_name": F.lit("added")})
    )
    table = VersionedTable(old.sparkSession, scratch_dir(old.sparkSession, "parts"), "p_partkey", old.schema)
    table.upsert(old)
    table.upsert(new)
    return table.read()


CHANGED_SQL = """
SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'named' WHEN doc_id % 10 = 0 THEN 'new' ELSE lang END AS lang,
  CASE WHEN doc_id % 9 = 0 AND doc_id % 6 = 0 THEN NULL ELSE n_chars END AS n_chars, doc_id % 9 = 0 AS tagged, length(text) AS kept FROM documents WHERE doc_id % 7 <> 0 OR doc_id % 70 = 0
UNION ALL SELECT doc_id + 100000000, 'added', n_chars, FALSE, length(text) FROM documents WHERE doc_id % 50 = 0"""


def _changed_documents(t) -> MergeTable:
    """Documents that are put in, replaced and added, deleted, put in again, and set in some fields, in changes of their own."""
    k = F.col("doc_id")
    old = t("documents").select("doc_id", "lang", "n_chars", "text", F.array().cast("array<string>").alias("tags"))
    table = MergeTable(old.sparkSession, scratch_dir(old.sparkSession, "merge"), "doc_id", old.schema)
    table.upsert(old.withColumn("lang", F.when(k % 10 == 0, "old").otherwise(F.col("lang"))))
    table.set_fields(old.where(k % 9 == 1).select("doc_id", F.lit(None).cast("string").alias("lang")))
    fresh = old.withColumn("lang", F.lit("new"))
    table.upsert(fresh.where(k % 10 == 0).unionByName(old.where(k % 50 == 0).withColumns({"doc_id": k + 100000000, "lang": F.lit("added")})))
    table.delete(old.where(k % 7 == 0))
    table.insert_missing(fresh.where(k % 70 == 0))
    table.insert_missing(fresh.where((k % 10 == 0) & (k % 7 != 0)).withColumn("lang", F.lit("too late")))
    table.set_fields(old.where(k % 9 == 1).select("doc_id", F.when(k % 10 == 0, "new").otherwise(F.col("lang")).alias("lang")))
    size = F.when(k % 6 != 0, F.col("n_chars")).alias("n_chars")
    table.set_fields(old.where(k % 9 == 0).select("doc_id", F.lit("named").alias("lang"), size, F.array(F.lit("t")).alias("tags")))
    return table


def _changed_rows(table: MergeTable) -> DataFrame:
    return table.read().select("doc_id", "lang", "n_chars", (F.size("tags") > 0).alias("tagged"), F.length("text").cast("long").alias("kept"))


@query(CHANGED_SQL)
def merge_table_changes(t) -> DataFrame:
    return _changed_rows(_changed_documents(t))


@query(CHANGED_SQL)
def merge_table_compacted(t) -> DataFrame:
    table = _changed_documents(t)
    table.compact(0)
    table.forget_before(table.version())
    return _changed_rows(table)


@query("SELECT doc_id AS id, 'best' AS part FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'rest' FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 <> 0")
def union_all_dedup(t) -> DataFrame:
    d = t("documents")
    part = lambda k: d.where(F.col("doc_id") % k == 0).select(F.col("doc_id").alias("id"), F.lit(1.0).alias("score"))
    found = search.merged_parts([part(2), part(3)], "id", "score")
    return found.select("id", F.get(F.array(F.lit("best"), F.lit("rest")), F.col("part")).alias("part"))


@query("SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def set_except(t) -> DataFrame:
    return t("orders").select("o_custkey").subtract(t("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")))


@query("SELECT c_custkey AS id FROM customer WHERE c_nationkey < 5 UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_union_distinct(t) -> DataFrame:
    return t("customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("id")).union(t("orders").where("o_orderstatus = 'P'").select("o_custkey")).distinct()


@query("SELECT 'u' || user_id AS root, 'watch' AS action FROM events WHERE user_id % 2 = 0 GROUP BY 1 UNION ALL SELECT 'u' || user_id, 'unwatch' FROM events WHERE user_id % 2 = 1 AND user_id % 3 = 0 GROUP BY 1")
def watch_root_changes(t) -> DataFrame:
    u = t("events").select("user_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("root"))
    wanted = u.where("user_id % 2 = 0 OR user_id % 6 = 1").select("root")
    watched = u.where("user_id % 6 = 1 OR (user_id % 2 = 1 AND user_id % 3 = 0)").select("root")
    return watch.root_changes(wanted, watched)


@query("""
WITH e AS (SELECT user_id, ts, event_type, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM e)
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS events, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS paths FROM g GROUP BY user_id, burst""")
def debounce_sessions(t) -> DataFrame:
    found = watch.debounced(t("events").select("user_id", "ts", "event_type"), ["user_id"], "ts", "event_type", "12 hours")
    return found.select("user_id", "first_ts", "last_ts", "events", F.array_join("paths", ",").alias("paths"))


@query("SELECT doc_id, n_chars, source FROM documents WHERE n_chars BETWEEN 300 AND 900 AND lang = 'en' AND doc_id % 1000 < 700")
def clustered_scan(t) -> DataFrame:
    """Ranges and equalities on files that are laid out by several fields."""
    rows = t("documents").select("doc_id", "n_chars", "lang", "source")
    path = scratch_dir(rows.sparkSession, "clustered")
    write_clustered(rows, path, ["n_chars", "lang", "doc_id"], files=int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), bloom=("lang",))
    found = rows.sparkSession.read.parquet(path).where("n_chars BETWEEN 300 AND 900 AND lang = 'en'")
    return found.where("doc_id % 1000 < 700").select("doc_id", "n_chars", "source")


@query("SELECT doc_id, CASE WHEN doc_id = 5 THEN 'New Tag,b' WHEN doc_id = 7 THEN '' ELSE lang || ',' || source END AS tags FROM documents")
def tags_of_media(t) -> DataFrame:
    """Tags of single media are set in a table of all."""
    rows = t("documents").select("doc_id", F.array("lang", "source").alias("tags"))
    table = MergeTable(rows.sparkSession, scratch_dir(rows.sparkSession, "tags"), "doc_id", rows.schema)
    table.upsert(rows)
    table.set_tags(5, [" New Tag ", "new tag", "", "b"])
    table.set_tags(7, [" "])
    table.set_tags(-1, ["nobody"])
    return table.read().select("doc_id", F.array_join("tags", ",").alias("tags"))


@query("""
WITH e AS (SELECT 'r' || doc_id // 7 AS root, 'p' || doc_id % 7 AS path, doc_id AS seen FROM documents), r AS (SELECT root, max(seen) AS since FROM e GROUP BY root),
n AS (SELECT max(seen) + 10 AS now FROM e), given AS (SELECT e.* FROM e JOIN r USING (root), n WHERE now - since >= 40 AND root <> 'r1')
SELECT root, path, CAST(seen + 1000 AS DOUBLE) AS seen FROM given WHERE path = 'p3' UNION ALL SELECT root, path, CAST(seen AS DOUBLE) FROM e WHERE root NOT IN (SELECT root FROM given)""")
def pending_changes(t) -> DataFrame:
    """Documents as events of roots: what waits after the quiet roots but a busy one were worked on, and some events came meanwhile."""
    d, i = t("documents"), F.col("doc_id")
    root, path = F.concat(F.lit("r"), F.floor(i / 7).cast("string")).alias("root"), F.concat(F.lit("p"), (i % 7).cast("string")).alias("path")
    events = d.select(root, path, i.cast("double").alias("at"))
    pending = watch.PendingChanges(d.sparkSession, scratch_dir(d.sparkSession, "pending"), 40.0)
    now = float(events.agg(F.max("at").alias("m")).first().m) + 10
    pending.add(events)
    given = materialised(pending.due(now, d.sparkSession.createDataFrame([("r1",)], "root string")), "given")
    pending.add(given.where("path = 'p3'").withColumn("at", F.col("at") + 1000))
    pending.done(given)
    return pending.paths.read().select("root", "path", F.col("at").alias("seen"))


@query("""
WITH o AS (SELECT CAST(doc_id AS VARCHAR) AS uri, (['indexed', 'already_indexed', 'skipped', 'skipped', 'failed'])[doc_id % 5 + 1] AS status FROM documents)
SELECT uri, status, count(*) OVER () AS total, count(*) FILTER (status = 'indexed') OVER () AS indexed, count(*) FILTER (status = 'already_indexed') OVER () AS already_indexed,
  count(*) FILTER (status = 'skipped') OVER () AS skipped, count(*) FILTER (status = 'failed') OVER () AS failed FROM o""")
def run_totals_observed(t) -> DataFrame:
    """A run's outcomes as they are written, beside its totals, which are taken by the way."""
    d = t("documents")
    status = F.get(F.array(*map(F.lit, ("indexed", "already_indexed", "skipped", "skipped", "failed"))), (F.col("doc_id") % 5).cast("int"))
    path = scratch_dir(d.sparkSession, "outcomes")
    totals = planning.with_totals(d.select(F.col("doc_id").cast("string").alias("uri"), status.alias("status")), lambda rows: rows.write.parquet(path))
    return d.sparkSession.read.parquet(path).crossJoin(F.broadcast(totals))  # one row


@query("SELECT user_id AS job_id, arg_max(event_type, event_id) AS status, max(event_id) AS sequence FROM events GROUP BY user_id")
def job_state_latest(t) -> DataFrame:
    e = t("events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), F.col("event_id").alias("sequence"))
    return watch.latest_states(e).select("job_id", "status", "sequence")


@query("SELECT user_id AS job_id, count(*) FILTER (event_id % 3 <> 0) AS done, count(*) AS total, round(count(*) FILTER (event_id % 3 <> 0) / count(*), 6) AS ratio FROM events GROUP BY user_id")
def job_progress_totals(t) -> DataFrame:
    e = t("events").select(F.col("user_id").alias("job_id"), F.when(F.col("event_id") % 3 != 0, 1).otherwise(0).alias("done"), F.lit(1).alias("total"))
    return watch.progress(e).withColumn("ratio", rounded(F.col("ratio")))


@query("SELECT 'o' || o_orderkey AS uri, CASE WHEN o_orderkey % 4 = 0 THEN 'removed' WHEN o_orderkey % 4 = 1 THEN 'added' ELSE 'changed' END AS change FROM orders WHERE o_orderkey % 4 < 3")
def snapshot_diff(t) -> DataFrame:
    k = F.col("o_orderkey")
    rows = t("orders").select(k, F.concat(F.lit("o"), k.cast("string")).alias("uri"), F.col("o_custkey").alias("size_bytes"), F.col("o_totalprice").alias("modified_at"))
    now = rows.where(k % 4 != 0).withColumn("size_bytes", F.when(k % 4 == 2, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")))
    return watch.snapshot_changes(rows.where(k % 4 != 1), now)


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 8")
def history_newest(t) -> DataFrame:
    return payload.newest(t("events"), "ts", "event_id").select("event_id", "user_id")


@query("""
WITH d AS (SELECT doc_id AS i, n_chars, (['static_image', 'video_scene', 'audio', 'pdf_page'])[doc_id % 4 + 1] AS kind FROM documents),
x AS (SELECT *, CASE WHEN i % 3 <> 0 THEN 1 END AS scene, CASE WHEN i % 7 <> 0 THEN 1 END AS bound, i % 5 <> 0 AS present, i % 11 <> 0 AS speech, n_chars > 500 AS told FROM d)
SELECT i AS doc_id, NOT (kind = 'video_scene' AND (scene IS NULL OR bound IS NULL))
  AND CASE WHEN kind = 'audio' AND NOT present THEN FALSE WHEN kind IN ('audio', 'video_scene') AND present AND speech AND NOT told THEN FALSE ELSE TRUE END AS complete,
  NOT (kind = 'video_scene' AND (scene IS NULL OR bound IS NULL)) AS without_transcription FROM x""")
def analysis_complete(t) -> DataFrame:
    from lumenlake.operators.filters import analysis_complete as complete

    i = F.col("doc_id")
    kind = F.get(F.array(*map(F.lit, ("static_image", "video_scene", "audio", "pdf_page"))), (i % 4).cast("int"))
    scene, bound = F.when(i % 3 != 0, 1), F.when(i % 7 != 0, 1.0)
    audio = F.when(i % 5 != 0, F.struct((i % 11 != 0).alias("speech_detected"), F.when(F.col("n_chars") > 500, "said").otherwise(" ").alias("transcript_text")))
    return t("documents").select("doc_id", *(complete(kind, scene, bound, F.lit(2.0), audio, on).alias(n) for on, n in ((True, "complete"), (False, "without_transcription"))))


@query("""
SELECT 'u' || o_orderkey AS uri, CASE WHEN o_orderkey % 4 = 0 THEN 'completed' WHEN o_orderkey % 4 = 1 THEN 'failed' WHEN o_orderkey % 8 = 2 THEN 'cancelled' ELSE 'running' END AS status,
  CASE WHEN o_orderkey % 4 = 0 THEN 'a,b,c' WHEN o_orderkey % 3 = 0 THEN 'a,b' ELSE '' END AS points FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 4 = 1""")
def ledger_of_a_run(t) -> DataFrame:
    """A run that registers items, commits points in two batches, and completes, fails or cancels some."""
    orders = t("orders")
    spark, k = orders.sparkSession, F.col("o_orderkey")
    uri = F.concat(F.lit("u"), k.cast("string")).alias("uri")
    items = orders.where((k % 2 == 0) | (k % 4 == 1)).select(k, uri, F.lit("s").alias("source"), F.col("o_custkey").alias("size_bytes"), F.col("o_totalprice").alias("modified_at"), F.lit("v6").alias("profile"))
    ledger = IndexLedger(spark, scratch_dir(spark, "ledger"))
    ledger.register(items)
    for points in (("a",), ("b", "a")):
        ledger.commit(items.where(k % 3 == 0).select("uri", F.explode(F.array(*map(F.lit, points))).alias("point_id")))
    ledger.complete(items.where(k % 4 == 0).select("uri", F.array(*map(F.lit, "abc")).alias("point_ids")))
    ledger.fail(items.where(k % 4 == 1).select("uri", F.lit("broken").alias("error")))
    ledger.cancel(items.where((k % 8 == 2) | (k % 4 == 0)))
    ledger.register(items)  # a second registration changes no entry
    return ledger.load()[0].select("uri", "status", F.array_join("point_ids", ",").alias("points"))
