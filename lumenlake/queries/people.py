"""Faces, people, speakers and identity changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlake.operators import faces, identity, inverse
from lumenlake.operators.filters import SearchFilters
from lumenlake.plans.scratch import scratch_dir
from lumenlake.queries.registry import MEDIA_SQL, media, query, rounded
from lumenlake.schema import MEDIA_FIELDS
from lumenlake.streaming.registries import FounderRegistry


def face_rows(t) -> DataFrame:
    """Embeddings as faces: media by id, person by id and label, some unlabelled."""
    i = F.col("vec_id")
    return t("embeddings").select(
        i.alias("face_id"),
        F.floor(i / 4).alias("media_id"),
        F.when(i % 6 != 0, F.concat(F.lit("p"), (i % 9).cast("string"))).alias("person_id"),
        F.when(i % 2 == 0, F.concat(F.lit("name"), (i % 9).cast("string"))).alias("person_label"),
        (i % 3).cast("int").alias("frame_index"),
        (F.lit(0.5) + (i % 50) / 100.0).alias("confidence"),
        F.col("embedding").alias("vector"),
    )


FACES_SQL = "faces AS (SELECT vec_id AS face_id, vec_id // 4 AS media_id, CASE WHEN vec_id % 6 <> 0 THEN 'p' || (vec_id % 9) END AS person_id, CASE WHEN vec_id % 2 = 0 THEN 'name' || (vec_id % 9) END AS person_label, CAST(vec_id % 3 AS INT) AS frame_index, 0.5::DOUBLE + (vec_id % 50) / 100.0::DOUBLE AS confidence, embedding::DOUBLE[] AS v FROM embeddings)"
MATCHES_SQL = f"""{FACES_SQL},
s AS (SELECT f.*, list_cosine_similarity(f.v, (SELECT v FROM faces WHERE face_id = 3)) AS score FROM faces f),
m AS (SELECT *, row_number() OVER (ORDER BY score DESC, face_id) - 1 AS ord FROM s ORDER BY score DESC, face_id LIMIT 240)"""


def _matches(t) -> DataFrame:
    rows = face_rows(t)
    return faces.match_faces(rows, rows.where("face_id = 3").first().vector, 12)


@query(f"""WITH {MATCHES_SQL} SELECT person_id, round(greatest(max(score), 0), 6) AS score, count(DISTINCT face_id) AS face_count, count(DISTINCT media_id) AS media_count,
array_to_string(list_sort(list_distinct(list(face_id))), ',') AS face_ids, arg_min(person_label, ord) FILTER (person_label IS NOT NULL) AS label FROM m WHERE person_id IS NOT NULL GROUP BY person_id""")
def face_people_agg(t) -> DataFrame:
    p = faces.people_of_matches(_matches(t))
    return p.select("person_id", rounded(F.col("score")).alias("score"), "face_count", "media_count", F.array_join(F.transform("face_ids", lambda x: x.cast("string")), ",").alias("face_ids"), "label")


@query(f"""WITH {MATCHES_SQL} SELECT media_id, round(greatest(max(score), 0), 6) AS face_score, max(CASE WHEN ord = last THEN person_id END) AS matched_person_id, max(CASE WHEN ord = first THEN person_id END) AS best_person_id
FROM (SELECT *, max(CASE WHEN person_id IS NOT NULL OR TRUE THEN ord END) OVER (PARTITION BY media_id) AS last, min(ord) OVER (PARTITION BY media_id) AS first FROM m) GROUP BY media_id""")
def face_media_agg(t) -> DataFrame:
    m = faces.media_of_matches(_matches(t))
    return m.select("media_id", rounded(F.col("face_score")).alias("face_score"), "matched_person_id", "best_person_id")


@query(f"""WITH {MATCHES_SQL}, v AS (SELECT ord % 10 AS face, person_id, count(*) AS votes, max(score) AS best, arg_min(person_label, ord) FILTER (person_label IS NOT NULL) AS label FROM m WHERE 1 - score <= 1.1 AND person_id IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY face ORDER BY votes DESC, best DESC, person_id DESC) AS n FROM v)
SELECT face, person_id, label, votes, round(least(1.0, best * votes), 6) AS confidence FROM r WHERE n = 1""")
def person_vote(t) -> DataFrame:
    matches = _matches(t).withColumn("face", (F.col("ord") % 10).cast("long"))
    return faces.vote(matches, "face", 1.1).withColumn("confidence", rounded(F.col("confidence")))


def _nested(t) -> DataFrame:
    """One row per medium with its faces as an array."""
    f = F.struct("face_id", F.col("media_id").cast("string").alias("media_id"), "frame_index", "confidence", "person_id", "person_label")
    nested = face_rows(t).groupBy(F.col("media_id").alias("id")).agg(F.sort_array(F.collect_list(f)).alias("faces"))
    people = faces.summarise_people(F.col("faces"))
    return nested.withColumn("people", people).withColumn("relative_path", F.format_string("m/%05d.jpg", "id"))


@query(f"WITH {FACES_SQL} SELECT media_id AS id, person_id, arg_min(person_label, face_id) FILTER (person_label IS NOT NULL) AS label, CAST(count(*) AS INT) AS face_count, round(max(confidence), 6) AS confidence FROM faces WHERE person_id IS NOT NULL GROUP BY 1, 2")
def people_summary(t) -> DataFrame:
    return _nested(t).select("id", F.explode("people").alias("p")).select("id", "p.person_id", "p.label", "p.face_count", rounded(F.col("p.confidence")).alias("confidence"))


PER_MEDIA_SQL = f"""{FACES_SQL},
pm AS (SELECT person_id, media_id, count(*) AS face_count, count(DISTINCT frame_index) AS frames, sum(confidence) + max(confidence) AS c_sum, count(*) + 1 AS c_n FROM faces WHERE person_id IS NOT NULL GROUP BY 1, 2)"""


@query(f"WITH {PER_MEDIA_SQL} SELECT person_id, CAST(sum(face_count) AS BIGINT) AS face_count, count(*) AS media_count, round(sum(c_sum) / sum(c_n), 6) AS confidence, min(media_id) AS first_media FROM pm GROUP BY person_id")
def inverse_people(t) -> DataFrame:
    return inverse.people_index(_nested(t)).select("person_id", "face_count", "media_count", rounded(F.col("confidence")).alias("confidence"), F.col("first_place.media_id").alias("first_media"))


@query(f"WITH {PER_MEDIA_SQL} SELECT person_id, printf('m/%05d.jpg', media_id) AS relative_path, media_id, face_count, frames FROM pm")
def inverse_people_places(t) -> DataFrame:
    return inverse.people_places(_nested(t))


@query(f"""WITH {FACES_SQL}, l AS (SELECT media_id, person_id, arg_min(person_label, face_id) FILTER (person_label IS NOT NULL) AS label FROM faces WHERE person_id IS NOT NULL GROUP BY 1, 2)
SELECT person_id, arg_min(label, media_id) FILTER (label IS NOT NULL) AS label FROM l GROUP BY person_id""")
def inverse_people_labels(t) -> DataFrame:
    return inverse.people_index(_nested(t)).select("person_id", "label")


VOICES_SQL = "v AS (SELECT role AS voice_id, conv_id AS media_id, 1 AS segment_count, length(text) / 15.0::DOUBLE AS total_seconds, 0.5::DOUBLE + (turn % 4) / 10.0::DOUBLE AS confidence, turn * 5.0::DOUBLE AS a, turn * 5.0::DOUBLE + 4 AS b FROM conversations)"


def _voices(t) -> DataFrame:
    return t("conversations").select(
        F.col("role").alias("voice_id"), F.col("conv_id").alias("media_id"), F.lit(1).alias("segment_count"), (F.length("text") / F.lit(15.0)).alias("total_seconds"),
        (F.lit(0.5) + (F.col("turn") % 4) / 10.0).alias("confidence"), (F.col("turn") * 5.0).alias("start_seconds"), (F.col("turn") * 5.0 + 4).alias("end_seconds"),
    )


@query(f"""WITH {VOICES_SQL}, p AS (SELECT voice_id, media_id, sum(segment_count) AS seg, sum(total_seconds) AS sec, sum(confidence) AS c, count(*) AS n, min(a) AS a, max(b) AS b FROM v GROUP BY 1, 2)
SELECT voice_id, CAST(sum(seg) AS BIGINT) AS segment_count, round(sum(sec), 3) AS total_seconds, round(sum(c) / sum(n), 6) AS confidence, count(*) AS media_count, CAST(sum(greatest(seg, n, 1)) AS BIGINT) AS occurrences, min(a) AS first_second, max(b) AS last_second FROM p GROUP BY voice_id""")
def inverse_speakers(t) -> DataFrame:
    s = inverse.speakers_index(_voices(t))
    return s.withColumns({"total_seconds": F.round("total_seconds", 3), "confidence": rounded(F.col("confidence"))})


@query(f"WITH {VOICES_SQL}, p AS (SELECT CASE WHEN voice_id = 'system' THEN 'user' ELSE voice_id END AS id, media_id, segment_count * (media_id % 3) AS n, total_seconds, confidence FROM v) SELECT media_id, id, CAST(sum(n) AS BIGINT) AS segment_count, round(sum(total_seconds), 3) AS total_seconds, round(sum(confidence * greatest(n, 1)) / sum(greatest(n, 1)), 6) AS confidence FROM p GROUP BY 1, 2")
def voice_merge_weighted(t) -> DataFrame:
    v = _voices(t).withColumns({"id": F.when(F.col("voice_id") == "system", "user").otherwise(F.col("voice_id")), "segment_count": F.col("segment_count") * (F.col("media_id") % 3)})
    return inverse.merge_voices(v, ["media_id", "id"]).withColumn("confidence", rounded(F.col("confidence")))


@query(f"WITH {FACES_SQL} SELECT media_id AS id, count(*) FILTER (person_label = 'Ada') AS named FROM (SELECT media_id, CASE WHEN person_id = 'p4' THEN 'Ada' ELSE person_label END AS person_label, person_id FROM faces) GROUP BY media_id HAVING count(*) FILTER (person_id = 'p4') > 0")
def person_rename(t) -> DataFrame:
    renamed = identity.rename_person(_nested(t), "p4", "Ada").where("changed")
    return renamed.select("id", F.size(F.filter("faces", lambda f: f["person_label"] == "Ada")).cast("long").alias("named"))


@query(f"WITH {FACES_SQL}, f AS (SELECT media_id, CASE WHEN person_id IN ('p1', 'p2') THEN 'p4' ELSE person_id END AS person_id, person_id IN ('p1', 'p2') AS hit FROM faces), c AS (SELECT media_id FROM f GROUP BY 1 HAVING bool_or(hit)) SELECT media_id AS id, person_id, CAST(count(*) AS INT) AS face_count FROM f WHERE person_id IS NOT NULL AND media_id IN (SELECT media_id FROM c) GROUP BY 1, 2")
def person_merge(t) -> DataFrame:
    merged = identity.merge_people(_nested(t), ["p1", "p2"], "p4", "Target").where("changed")
    return merged.select("id", F.explode("people").alias("p")).select("id", "p.person_id", "p.face_count")


@query(f"WITH {FACES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY confidence DESC, face_id) AS n FROM faces) SELECT media_id, face_id FROM r WHERE n = 1")
def query_face_argmax(t) -> DataFrame:
    box = F.struct(F.lit(2.0).alias("width"), F.lit(1.0).alias("height")).alias("bbox")
    return faces.query_face(face_rows(t).select("media_id", "face_id", "confidence", box)).select("media_id", "face_id")


def founding_sql(rows: str, least: float) -> str:
    """The fold as recursion: ``rows`` has g, id and v; the result g, id, the founder's id and number, and the score."""
    best = "list_max(list_transform(founders, lambda f, k: {'s': list_cosine_similarity(f.v, r.v), 'k': -k}))"
    return f"""
WITH RECURSIVE r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY id) AS i FROM ({rows})),
st AS (
  SELECT DISTINCT g, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(id BIGINT, v DOUBLE[])[]) AS founders, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS founder, CAST(0 AS BIGINT) AS number, CAST(NULL AS DOUBLE) AS score FROM r
  UNION ALL
  SELECT g, i, CASE WHEN b.s >= {least} THEN founders ELSE list_append(founders, {{'id': id, 'v': v}}) END, id, CASE WHEN b.s >= {least} THEN founders[-b.k].id ELSE id END,
         CASE WHEN b.s >= {least} THEN -b.k ELSE len(founders) + 1 END, CASE WHEN b.s >= {least} THEN b.s ELSE 1 END
  FROM (SELECT r.*, founders, {best} AS b FROM st JOIN r ON r.g = st.g AND r.i = st.i + 1)),
found AS (SELECT g, id, founder, number, score FROM st WHERE i > 0)"""


@query(founding_sql("SELECT vec_id // 4 AS g, vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings", 0.05) + " SELECT g AS media_id, id AS face_id, founder AS person FROM found")
def online_cluster(t) -> DataFrame:
    return faces.cluster_in_order(face_rows(t), 0.95)


@query(founding_sql("SELECT vec_id // 6 AS g, vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings", 0.05) + " SELECT g AS media_id, id AS face_id FROM found WHERE founder = id")
def faces_apart(t) -> DataFrame:
    """The faces of each medium without those that are near one kept before them."""
    rows = t("embeddings").select(F.floor(F.col("vec_id") / 6).alias("media_id"), F.struct(F.col("vec_id").alias("face_id"), F.col("embedding").alias("vector")).alias("f"))
    nested = rows.groupBy("media_id").agg(F.array_sort(F.collect_list("f")).alias("f"))  # six faces
    return nested.select("media_id", F.explode(faces.first_apart(F.col("f"), 0.95)).alias("f")).select("media_id", "f.face_id")


@query(founding_sql("SELECT 0 AS g, vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings", 0.25) + " SELECT id AS face_id, founder AS person FROM found")
def people_founded(t) -> DataFrame:
    """People across all media by arrival: one group of all faces."""
    return faces.cluster_in_order(face_rows(t).withColumn("all", F.lit(0)), 0.75, "all").select("face_id", "person")


@query(founding_sql("SELECT vec_id % 3 AS g, (vec_id % 2) * 10000000 + 10000000 + vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings", 0.25) + """
SELECT CAST(g AS VARCHAR) AS registry, CAST(id AS VARCHAR) AS item, number - 1 AS number, round(score, 6) AS score FROM found""")
def registry_over_batches(t) -> DataFrame:
    """People of three registries in two batches, the second of which is run twice: as one fold of both."""
    i = F.col("vec_id")
    rows = t("embeddings").select((i % 3).alias("group"), ((i % 2) * 10_000_000 + 10_000_000 + i).cast("string").alias("item"), F.col("embedding").alias("vector"), (i % 2).alias("batch"))
    registry = FounderRegistry(rows.sparkSession, scratch_dir(rows.sparkSession, "registry"), 0.25)
    for batch in (0, 1, 1):
        registry.handle(rows.where(F.col("batch") == batch), batch)
    return registry.assigned.read().select(F.col("grp").alias("registry"), "item", "number", rounded(F.col("score")).alias("score"))


SEARCH_SQL = f"""{MATCHES_SQL}, {MEDIA_SQL.strip()},
kept AS (SELECT * FROM media WHERE width >= 672 AND contains(lower(filename), 'img-000')),
inside AS (SELECT m.* FROM m WHERE media_id IN (SELECT id FROM kept))"""


def _face_search(t):
    rows = face_rows(t)
    asked = SearchFilters(width_min=672, name="IMG-000")
    return faces.face_search(rows, media(t), rows.where("face_id = 3").first().vector, asked, 12)


@query(f"""WITH {SEARCH_SQL} SELECT person_id, round(greatest(max(score), 0), 6) AS score, count(DISTINCT face_id) AS face_count, count(DISTINCT media_id) AS media_count,
arg_min(person_label, ord) FILTER (person_label IS NOT NULL) AS label FROM inside WHERE person_id IS NOT NULL GROUP BY person_id ORDER BY greatest(max(score), 0) DESC, person_id LIMIT 12""")
def face_search_people(t) -> DataFrame:
    return _face_search(t)[0].select("person_id", rounded(F.col("score")).alias("score"), "face_count", "media_count", "label")


@query(f"""WITH {SEARCH_SQL}, g AS (SELECT media_id AS id, greatest(max(score), 0) AS s, arg_max(person_id, ord) FILTER (person_id IS NOT NULL) AS matched_person_id, array_to_string(list_sort(list_distinct(list(face_id))), ',') AS faces FROM inside GROUP BY media_id)
SELECT g.id, filename, round(s, 6) AS face_score, faces FROM g JOIN kept USING (id) ORDER BY s DESC, filename, g.id LIMIT 12""")
def face_search_media(t) -> DataFrame:
    found = _face_search(t)[1]
    return found.select("id", "filename", rounded(F.col("face_score")).alias("face_score"), F.array_join(F.transform("face_ids", lambda x: x.cast("string")), ",").alias("faces"))


@query(f"""WITH {MATCHES_SQL}, x AS (SELECT *, ord % 10 AS face FROM m), v AS (SELECT face, person_id, count(*) AS votes, max(score) AS best, arg_min(person_label, ord) FILTER (person_label IS NOT NULL) AS label FROM x WHERE 1 - score <= 0.9 AND person_id IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY face ORDER BY votes DESC, best DESC, person_id DESC) AS n FROM v),
u AS (SELECT face_id, sha1(unhex('2f26cf002f654df18a469b0d5fc7e4d3') || encode(CAST(face_id AS VARCHAR))) AS s FROM (SELECT unnest(range(0, 14)) AS face_id))
SELECT face_id, coalesce(person_id, 'person-' || substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-5' || substr(s, 14, 3) || '-' || lower(to_hex((CAST('0x' || substr(s, 17, 1) AS BIGINT) & 3) | 8)) || substr(s, 18, 3) || '-' || substr(s, 21, 12)) AS person_id,
  label, round(CASE WHEN person_id IS NULL THEN 1 ELSE least(1.0, best * votes) END, 6) AS confidence FROM u LEFT JOIN r ON r.face = u.face_id AND r.n = 1""")
def people_assigned(t) -> DataFrame:
    matches = _matches(t).drop("face_id").withColumn("face_id", (F.col("ord") % 10).cast("long"))
    unknown = matches.sparkSession.range(14).withColumnRenamed("id", "face_id")
    return faces.assign_people(unknown, matches, 0.9).withColumn("confidence", rounded(F.col("confidence")))


def _spoken(t) -> DataFrame:
    """Conversations as media with recognised voices (one for each role, turn and pair of turns) and audio segments."""
    c, turn = t("conversations"), F.col("turn")
    voice = F.struct(
        "turn", F.col("role").alias("id"), F.concat(F.lit("L"), turn.cast("string")).alias("label"), (turn % 3).cast("int").alias("segment_count"),
        (F.length("text") / F.lit(8.0)).alias("total_seconds"), (F.lit(0.25) + (turn % 4) / F.lit(8.0)).alias("confidence"),
    )
    segment = F.struct(
        turn.cast("int").alias("segment_index"), F.lit("speech").alias("kind"), (turn * 5.0).alias("start_seconds"), (turn * 5.0 + 4).alias("end_seconds"), F.lit(0.5).alias("confidence"),
        F.when(turn % 2 == 0, F.col("role")).alias("speaker_id"), F.lit(None).cast("string").alias("speaker_label"),
    )
    kinds = MEDIA_FIELDS["audio_analysis"]
    nested = c.groupBy(F.col("conv_id").alias("id")).agg(F.sort_array(F.collect_list(voice)).alias("v"), F.sort_array(F.collect_list(segment)).alias("s"))
    own = F.transform("v", lambda x: F.struct(*(x[k].alias(k) for k in ("id", "label", "segment_count", "total_seconds", "confidence"))))
    known = {"audio_segments": F.col("s"), "recognized_voices": own}  # the other fields are null
    fields = T.StructType.fromDDL(f"a {kinds}")["a"].dataType
    filled = F.struct(*(known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))
    return nested.select("id", F.format_string("c/%05d", "id").alias("relative_path"), filled.alias("audio_analysis"))


SPOKEN_SQL = """v AS (SELECT conv_id AS media_id, role AS voice_id, turn, 'L' || turn AS label, turn % 3 AS said, length(text) / 8.0::DOUBLE AS seconds, 0.25::DOUBLE + (turn % 4) / 8.0::DOUBLE AS c FROM conversations),
seg AS (SELECT conv_id AS media_id, role AS voice_id, count(*) AS n, min(turn * 5.0::DOUBLE) AS a, max(turn * 5.0::DOUBLE + 4) AS b FROM conversations WHERE turn % 2 = 0 GROUP BY 1, 2),
loc AS (SELECT media_id, voice_id, sum(greatest(coalesce(n, 0), said, 1)) AS occurrences, min(a) AS start_seconds, max(b) AS end_seconds, max(c) AS confidence, sum(said) AS said, sum(seconds) AS seconds, sum(c) AS c, count(*) AS k, arg_min(label, turn) AS label FROM v LEFT JOIN seg USING (media_id, voice_id) GROUP BY 1, 2)"""


@query(f"WITH {SPOKEN_SQL} SELECT media_id, voice_id, CAST(occurrences AS BIGINT) AS occurrences, start_seconds, end_seconds, round(confidence, 6) AS confidence, label FROM loc")
def speaker_locations(t) -> DataFrame:
    return inverse.speaker_locations(_spoken(t)).select("media_id", "voice_id", "occurrences", "start_seconds", "end_seconds", rounded(F.col("confidence")).alias("confidence"), "label")


@query(f"WITH {SPOKEN_SQL} SELECT voice_id, CAST(sum(said) AS BIGINT) AS segment_count, round(sum(seconds), 3) AS total_seconds, round(sum(c) / sum(k), 6) AS confidence, count(*) AS media_count, CAST(sum(occurrences) AS BIGINT) AS occurrences, arg_min(label, media_id) AS label FROM loc GROUP BY voice_id")
def speakers_of_media(t) -> DataFrame:
    s = inverse.speakers_of_media(_spoken(t))
    return s.withColumns({"total_seconds": F.round("total_seconds", 3), "confidence": rounded(F.col("confidence"))})


@query(f"""WITH {SPOKEN_SQL}, f AS (SELECT label AS l FROM (SELECT label, row_number() OVER (ORDER BY media_id, turn) AS n FROM v WHERE voice_id = 'user') WHERE n = 1),
x AS (SELECT media_id, CASE WHEN voice_id IN ('system', 'assistant') THEN 'user' ELSE voice_id END AS voice_id, voice_id <> 'user' AS hit, said, seconds, c FROM v WHERE voice_id IN ('user', 'system', 'assistant')),
g AS (SELECT media_id, bool_or(hit) AS hit, sum(said) AS said, sum(seconds) AS seconds, sum(c * greatest(said, 1)) / sum(greatest(said, 1)) AS c FROM x GROUP BY media_id)
SELECT media_id AS id, 'user' AS voice, l AS label, CAST(said AS INT) AS segment_count, round(seconds, 3) AS total_seconds, round(c, 6) AS confidence FROM g, f WHERE hit""")
def speaker_merge(t) -> DataFrame:
    merged = identity.merge_speakers(_spoken(t), ["system", " assistant ", "user"], "user").where("changed")
    v = merged.select("id", F.explode("audio_analysis.recognized_voices").alias("v"))
    return v.select("id", F.col("v.id").alias("voice"), "v.label", "v.segment_count", rounded(F.col("v.total_seconds"), 3).alias("total_seconds"), rounded(F.col("v.confidence")).alias("confidence"))


@query("SELECT conv_id AS id, count(*) AS voices, count(*) FILTER (turn % 2 = 0) AS segments FROM conversations WHERE role = 'user' GROUP BY conv_id")
def speaker_rename(t) -> DataFrame:
    renamed = identity.rename_speaker(_spoken(t), "user", "Kim").where("changed")
    count = lambda part, name: F.size(F.filter(F.col("audio_analysis")[part], lambda x: x[name] == "Kim")).cast("long")
    return renamed.select("id", count("recognized_voices", "label").alias("voices"), count("audio_segments", "speaker_label").alias("segments"))


@query("SELECT CASE WHEN vec_id % 9 IN (1, 2) THEN 'p4' ELSE 'p' || (vec_id % 9) END AS id, count(*) AS n, min(vec_id) AS first FROM embeddings GROUP BY 1")
def voice_registry_merge(t) -> DataFrame:
    i = F.col("vec_id")
    profiles = t("embeddings").groupBy(F.concat(F.lit("p"), (i % 9).cast("string")).alias("id")).agg(F.lit("x").alias("label"), F.sort_array(F.collect_list(F.array(i))).alias("embeddings"))
    merged = identity.merge_registry(profiles, ["p1", "p2"], "p4")
    return merged.select("id", F.size("embeddings").cast("long").alias("n"), F.array_min(F.transform("embeddings", lambda e: e[0])).alias("first"))


@query("SELECT id FROM (VALUES ('p1'), ('p77')) x(id) WHERE id NOT IN (SELECT 'p' || (vec_id % 9) FROM embeddings WHERE vec_id % 6 <> 0)")
def merge_missing_sources(t) -> DataFrame:
    return identity.missing_sources(face_rows(t), ["p1", "p77"]).select(F.col("person_id").alias("id"))
