"""Vector search, hash distances, duplicate groups and albums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.functions.ids import uuid5
from lumenlake.functions.similarity import as_doubles, hamming_hex, phash_halves, relevance, weighted_mean
from lumenlake.operators import albums, duplicates, search
from lumenlake.operators.filters import SearchFilters, conjunction, pushed, residual
from lumenlake.operators.order import numbered
from lumenlake.plans.scratch import materialised, scratch_dir
from lumenlake.queries.registry import MEDIA_SQL, media, query, rounded



def _distance_sql(a: str, b: str) -> str:
    half = lambda x, at: f"CAST('0x' || substr({x}, {at}, 8) AS BIGINT)"
    return f"CAST(bit_count(xor({half(a, 1)}, {half(b, 1)})) + bit_count(xor({half(a, 9)}, {half(b, 9)})) AS INT)"


def _query_vector(t, vec_id: int = 0) -> list[float]:
    return t("embeddings").where(F.col("vec_id") == vec_id).first().embedding


SCORED = "scored AS (SELECT e.vec_id, e.label, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"


@query(f"WITH {SCORED} SELECT CAST(row_number() OVER (ORDER BY s DESC, vec_id) AS INT) AS rank, vec_id, round(s, 6) AS score FROM scored WHERE vec_id <> 0 ORDER BY s DESC, vec_id LIMIT 50")
def knn_topk(t) -> DataFrame:
    top = search.top_vectors(t("embeddings").where("vec_id <> 0"), _query_vector(t), 50, "vec_id", "embedding")
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "vec_id"))  # 50 rows
    return top.select(rank.alias("rank"), "vec_id", rounded(F.col("score")).alias("score"))


@query(f"""WITH {SCORED}, w AS (SELECT * FROM scored WHERE label = 1 ORDER BY s DESC, vec_id LIMIT 96),
d AS (SELECT *, CAST(bit_count(vec_id % 4096) AS INT) AS distance FROM w WHERE vec_id % 3 = 0)
SELECT vec_id, round(s, 6) AS score, distance, distance <= 2 AS near_duplicate, round(CASE WHEN distance > 2 THEN s ELSE 2 + (2 - distance + 1) / 3.0::DOUBLE + least(1, greatest(0, s)) * 0.01::DOUBLE END, 6) AS relevance FROM d ORDER BY s DESC, vec_id LIMIT 12""")
def knn_filtered_candidate_window(t) -> DataFrame:
    i = F.col("vec_id")
    none = F.lit(None).cast("string")
    rows = t("embeddings").select(
        i.alias("id"), F.col("embedding").alias("visual"), F.concat(F.lit("l"), F.col("label").cast("string")).alias("source_type"), F.lpad(F.lower(F.hex(i % 4096)), 16, "0").alias("phash"),
        F.concat(F.lit("kind"), (i % 3).cast("string")).alias("filename"), none.alias("relative_path"), none.alias("path"), none.alias("source_uri"),
    )
    found = search.search_media(rows, _query_vector(t), "0" * 16, SearchFilters(source_type="l1", name="KIND0"), 12, threshold=2)
    return found.select(F.col("id").alias("vec_id"), rounded(F.col("vector_score")).alias("score"), F.col("phash_distance").cast("int").alias("distance"), "near_duplicate", rounded(F.col("relevance_score")).alias("relevance"))


@query("""
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT q.query_id, e.vec_id AS id, list_cosine_similarity(e.embedding::DOUBLE[], q.v) AS s FROM embeddings e, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM s)
SELECT query_id, id, CAST(rank AS INT) AS rank, round(s, 6) AS score FROM r WHERE rank <= 10""")
def knn_batch_topk(t) -> DataFrame:
    queries = t("embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = search.batch_top_vectors(t("embeddings"), queries, 10, "vec_id", "embedding")
    return found.select("query_id", "id", "rank", rounded(F.col("score")).alias("score"))


@query(f"""
WITH {MEDIA_SQL}, q AS (SELECT phash AS h FROM media WHERE id = 0),
d AS (SELECT id, {_distance_sql('phash', 'h')} AS distance, (id % 100) / 100.0::DOUBLE AS s FROM media, q),
r AS (SELECT id, distance, s, CASE WHEN distance > 24 THEN s ELSE 2 + (24 - distance + 1) / 25.0::DOUBLE + s * 0.01::DOUBLE END AS rel FROM d)
SELECT id, distance, round(s, 6) AS score, round(rel, 6) AS relevance FROM r ORDER BY rel DESC, id LIMIT 40""")
def relevance_rank(t) -> DataFrame:
    m = media(t)
    target = m.where("id = 0").first().phash
    d = m.withColumn("distance", hamming_hex(F.col("phash"), F.lit(target)).cast("int")).withColumn("score", (F.col("id") % 100) / F.lit(100.0))
    ranked = d.withColumn("rel", relevance(F.col("score"), F.col("distance"), 24)).orderBy(F.desc("rel"), "id").limit(40)
    return ranked.select("id", "distance", rounded(F.col("score")).alias("score"), rounded(F.col("rel")).alias("relevance"))


SEEN_SQL = f"""{MEDIA_SQL.strip()}, q AS (SELECT m.phash AS h, embedding::DOUBLE[] AS v FROM media m JOIN embeddings e ON m.id = e.vec_id WHERE m.id = 0),
seen AS (SELECT m.*, list_cosine_similarity(e.embedding::DOUBLE[], q.v) AS s, {_distance_sql('phash', 'h')} AS d FROM media m JOIN embeddings e ON m.id = e.vec_id, q)"""


def _seen(t, filters: SearchFilters, text: str | None = None) -> DataFrame:
    """An exact search over all documents that have an embedding, by the first of them."""
    m = media(t)
    target = m.where("id = 0").first().phash
    rows = m.join(t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("visual")), "id")
    return search.search_media(rows, _query_vector(t), target, filters, None, threshold=28, text=text, exact=True)


@query(f"WITH {SEEN_SQL} SELECT id, round(s, 6) AS score, round(2 + (28 - d + 1) / 29.0::DOUBLE + least(1, greatest(0, s)) * 0.01::DOUBLE, 6) AS relevance FROM seen WHERE d <= 28")
def search_near_duplicates_only(t) -> DataFrame:
    found = _seen(t, SearchFilters(near_duplicates="only"))
    return found.select("id", rounded(F.col("vector_score")).alias("score"), rounded(F.col("relevance_score")).alias("relevance"))


@query(f"""WITH {SEEN_SQL}, r AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS place FROM seen WHERE d > 28 AND contains(lower(ocr_text), 'en') AND contains(lower(ocr_text), 'er'))
SELECT id, place FROM r""")
def search_text_then_vector(t) -> DataFrame:
    """Rows whose text holds all terms and that are no near duplicates, in the order of the search."""
    found = _seen(t, SearchFilters(near_duplicates="exclude"), "EN er")
    return numbered(found, [], [F.desc("text_score"), F.desc("vector_score"), F.col("id")], "place").select("id", (F.col("place") + 1).alias("place"))


@query(f"WITH {MEDIA_SQL} SELECT id, 1.0::DOUBLE AS vector_score, 1.0::DOUBLE AS relevance_score, CAST(NULL AS INT) AS phash_distance, 1.0::DOUBLE AS text_score, FALSE AS near_duplicate FROM media WHERE width >= 672 AND contains(lower(ocr_text), 'tion')")
def text_search_response(t) -> DataFrame:
    found = search.search_text(media(t), "Tion", SearchFilters(width_min=672), None)
    return search.response(found, text=True).select("id", "vector_score", "relevance_score", "phash_distance", "text_score", "near_duplicate")


@query(f"WITH {MEDIA_SQL} SELECT id, CAST('0x' || substr(phash, 1, 8) AS BIGINT) AS hi, CAST('0x' || substr(phash, 9, 8) AS BIGINT) AS lo FROM media")
def phash_halves_of_media(t) -> DataFrame:
    hi, lo = phash_halves(F.col("phash"))
    return media(t).select("id", hi.alias("hi"), lo.alias("lo"))


PAIRS_SQL = f"h AS (SELECT DISTINCT phash FROM media), pairs AS (SELECT a.phash AS a, b.phash AS b, {_distance_sql('a.phash', 'b.phash')} AS distance FROM h a, h b WHERE a.phash < b.phash AND {_distance_sql('a.phash', 'b.phash')} <= 8)"


@query(f"WITH {MEDIA_SQL}, {PAIRS_SQL} SELECT a, b, distance FROM pairs")
def hamming_pairs_banded(t) -> DataFrame:
    return duplicates.hash_pairs(duplicates.distinct_hashes(media(t)), 8).select("a", "b", F.col("distance").cast("int").alias("distance"))


MEMBERS_SQL = f"""{MEDIA_SQL}, {PAIRS_SQL},
reach AS (SELECT phash AS node, phash AS seen FROM h UNION SELECT r.node, p.y FROM reach r JOIN (SELECT a AS x, b AS y FROM pairs UNION ALL SELECT b, a FROM pairs) p ON r.seen = p.x),
low AS (SELECT r.node, min(m.id) AS root FROM reach r JOIN media m ON m.phash = r.seen GROUP BY r.node),
members AS (SELECT m.id, low.root, count(*) OVER (PARTITION BY low.root) AS size FROM media m JOIN low ON m.phash = low.node)"""


@query(f"WITH RECURSIVE {MEMBERS_SQL} SELECT id, root FROM members")
def duplicate_membership(t) -> DataFrame:
    return duplicates.membership(media(t), 8)


KEPT_SQL = MEMBERS_SQL.replace("FROM documents)", "FROM documents WHERE doc_id % 11 <> 0)")


@query(f"WITH RECURSIVE {KEPT_SQL} SELECT id, root FROM members")
def duplicate_membership_updated(t) -> DataFrame:
    """Classes after three batches, one of which changes hashes that another had wrong, and a removal."""
    m = media(t).select("id", "phash")
    index = duplicates.DuplicateIndex(m.sparkSession, scratch_dir(m.sparkSession, "duplicates"), 8, id_type="long")
    wrong = F.when(F.col("id") % 7 == 0, F.lit("0" * 16)).otherwise(F.col("phash"))
    index.add(m.where("id % 3 <> 1").withColumn("phash", wrong))
    index.add(m.where("id % 3 = 1 OR id % 7 = 0"))
    index.remove(m.where("id % 11 = 0"))
    return index.membership()


@query(f"""WITH RECURSIVE {MEMBERS_SQL},
g AS (SELECT root AS representative, count(*) AS size, list_sort(list(id)) AS ids FROM members WHERE size > 1 GROUP BY root),
u AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(array_to_string(ids, chr(10)))) AS s FROM g)
SELECT representative, size, array_to_string(ids, ',') AS ids, 'duplicate-' || substr(s, 1, 12) AS group_id FROM u""")
def duplicate_groups(t) -> DataFrame:
    found = duplicates.groups(duplicates.membership(media(t), 8))
    return found.select("representative", "size", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), "group_id")


@query(f"WITH RECURSIVE {MEMBERS_SQL} SELECT m.id, CASE WHEN size > 1 THEN root END AS duplicate_root, CASE WHEN size > 1 THEN size ELSE 1 END AS duplicate_group_size FROM media m LEFT JOIN members USING (id)")
def duplicate_membership_left(t) -> DataFrame:
    m = media(t)
    members = materialised(duplicates.membership(m, 8), "members")  # read twice
    return duplicates.with_group(m.select("id", "phash"), members).select("id", "duplicate_root", "duplicate_group_size")


@query(f"WITH RECURSIVE {MEMBERS_SQL} SELECT id, filename FROM media WHERE id IN (SELECT id FROM members WHERE size > 1)")
def duplicate_only_semi(t) -> DataFrame:
    m = media(t)
    return duplicates.only_duplicates(m, duplicates.membership(m, 8)).select("id", "filename")


@query(f"WITH RECURSIVE {MEMBERS_SQL} SELECT id, filename FROM media WHERE id NOT IN (SELECT id FROM members WHERE size > 1)")
def duplicate_exclude_anti(t) -> DataFrame:
    m = media(t)
    return duplicates.without_duplicates(m, duplicates.membership(m, 8)).select("id", "filename")


CONJUNCTION = SearchFilters(
    source_type="src2", width_min=640, width_max=760, height_min=640, height_max=784, size_min=100, modified_from=1.7e9,
    captured_from=1.6e9, has_gps=True, camera="model", keyword="TAG",
)


@query(f"""WITH {MEDIA_SQL} SELECT id, width, height, size_bytes FROM media
WHERE source_type = 'src2' AND width BETWEEN 640 AND 760 AND height BETWEEN 640 AND 784 AND size_bytes >= 100 AND modified_at >= 1.7e9
AND photo_capture_time_epoch >= 1.6e9 AND photo_has_gps AND (contains(lower(coalesce(camera_make, '')), 'model') OR contains(lower(camera_model), 'model'))
AND (len(list_filter(tags, lambda x: contains(lower(x), 'tag'))) > 0 OR len(list_filter(keywords, lambda x: contains(lower(x), 'tag'))) > 0)""")
def filters_conjunction(t) -> DataFrame:
    rows = media(t).where(conjunction([*pushed(CONJUNCTION), *residual(CONJUNCTION)]))
    return rows.select("id", "width", "height", "size_bytes")


@query(f"WITH {MEDIA_SQL} SELECT CASE WHEN width = height THEN 'square' WHEN width > height THEN 'landscape' ELSE 'portrait' END AS orientation, count(*) AS n FROM media GROUP BY 1")
def orientation_case(t) -> DataFrame:
    from lumenlake.operators.filters import orientation

    return media(t).groupBy(orientation(F.col("width"), F.col("height")).alias("orientation")).agg(F.count("*").alias("n"))


@query(f"WITH {MEDIA_SQL} SELECT id FROM media WHERE contains(lower(filename), '0012') OR contains(lower(relative_path), '0012') OR contains(lower(source_uri), '0012')")
def name_contains_any(t) -> DataFrame:
    return media(t).where(conjunction(residual(SearchFilters(name="0012")))).select("id")


@query(f"WITH {MEDIA_SQL} SELECT id FROM media WHERE list_contains(keywords, 'key3') OR list_contains(tags, 'key3')")
def keyword_or_tag(t) -> DataFrame:
    return media(t).where(conjunction(residual(SearchFilters(keyword="KEY3")))).select("id")


@query(f"WITH {MEDIA_SQL} SELECT DISTINCT source_type FROM media")
def facet_distinct(t) -> DataFrame:
    return media(t).select("source_type").distinct().orderBy("source_type")


def _album(sort: str, order: str, dup: bool = False):
    ctes = f"WITH RECURSIVE {MEMBERS_SQL}, rows AS (SELECT m.*, CASE WHEN size > 1 THEN size ELSE 1 END AS g FROM media m LEFT JOIN members USING (id))"
    sql = f"{ctes} SELECT id, filename FROM rows WHERE width >= 672 ORDER BY {order}, id LIMIT 60 OFFSET 20"

    def run(t) -> DataFrame:
        m = media(t)
        members = duplicates.membership(m, 8) if sort == "duplicate_group_size" else None
        return albums.album_results(m, SearchFilters(width_min=672), members, sort, 20, 60)[0].select("id", "filename")

    return run, sql


for _sort, _order in {
    "captured_newest": "floor(coalesce(photo_capture_time_epoch, 0)) DESC, filename",
    "duplicate_group_size": "g DESC, filename",
    "filename": "lower(filename)",
    "modified_newest": "modified_at DESC, filename",
    "size_largest": "size_bytes DESC, filename",
}.items():
    _run, _sql = _album(_sort, _order)
    _run.__name__ = f"album_sort_{_sort}"
    query(_sql)(_run)


@query(f"WITH {MEDIA_SQL} SELECT count(*) AS total FROM media WHERE media_kind = 'static_image' AND contains(lower(ocr_text), 'the')")
def album_page_total(t) -> DataFrame:
    return albums.album_results(media(t), SearchFilters(media_kind="static_image", text="THE"))[1]


@query(f"WITH {MEDIA_SQL} SELECT id, CAST((row_number() OVER (ORDER BY size_bytes DESC, filename, id) - 1) // 60 AS BIGINT) AS page FROM media WHERE width <= 736")
def album_pages(t) -> DataFrame:
    """Every row of an album with its page, from the directory of its places."""
    m = media(t)
    directory = albums.PageDirectory(m.sparkSession, scratch_dir(m.sparkSession, "album"))
    directory.build(albums.matching(m, SearchFilters(width_max=736.0)).select("id", "filename", "size_bytes"), "size_largest")
    return directory.rows().select("id", F.floor(F.col("_place") / 60).alias("page"))


@query(f"""WITH RECURSIVE {MEMBERS_SQL} SELECT m.id, root AS duplicate_root, size AS duplicate_group_size FROM media m JOIN members USING (id)
WHERE size > 1 AND width <= 736 ORDER BY modified_at DESC, filename, m.id LIMIT 30 OFFSET 5""")
def album_of_duplicates(t) -> DataFrame:
    m = media(t)
    album = albums.SmartAlbum("twice", SearchFilters(near_duplicates="only", width_max=736.5), sort="modified_newest", limit=30)
    return album.results(m, duplicates.membership(m, 8), 5)[0].select("id", "duplicate_root", "duplicate_group_size")


@query("""
WITH p AS (SELECT vec_id % 50 AS id, label AS part, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)) AS s FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(s, 9) DESC, part) AS n FROM p)
SELECT id, part, round(s, 6) AS score FROM r WHERE n = 1""")
def best_per_id_multi_query(t) -> DataFrame:
    from lumenlake.functions.similarity import cosine_to

    q = _query_vector(t, 1)
    parts = t("embeddings").select((F.col("vec_id") % 50).alias("id"), F.col("label").alias("part"), F.round(cosine_to(as_doubles(F.col("embedding")), q), 9).alias("s"))
    return search.best_per_id(parts, "id", "s", "part").select("id", "part", rounded(F.col("s")).alias("score"))


@query("SELECT doc_id, substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-5' || substr(s, 14, 3) || '-' || lower(to_hex((CAST('0x' || substr(s, 17, 1) AS BIGINT) & 3) | 8)) || substr(s, 18, 3) || '-' || substr(s, 21, 12) AS id FROM (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('s3://bucket/' || source || '/' || doc_id)) AS s FROM documents)")
def uuid5_id(t) -> DataFrame:
    return t("documents").select("doc_id", uuid5(F.concat(F.lit("s3://bucket/"), "source", F.lit("/"), F.col("doc_id").cast("string"))).alias("id"))


@query("""
WITH e AS (SELECT vec_id // 5 AS clip, vec_id % 5 + 1 AS w, embedding::DOUBLE[] AS v FROM embeddings),
x AS (SELECT clip, i, sum(w * v[i]) AS s FROM e, (SELECT unnest(range(1, 65)) AS i) GROUP BY clip, i),
n AS (SELECT clip, sqrt(sum(s * s)) AS n FROM x GROUP BY clip)
SELECT clip, round(sum(CASE WHEN i = 1 THEN s / n END), 6) AS first, round(sum(CASE WHEN i = 64 THEN s / n END), 6) AS last FROM x JOIN n USING (clip) GROUP BY clip""")
def weighted_frame_average(t) -> DataFrame:
    frames = t("embeddings").groupBy(F.floor(F.col("vec_id") / 5).alias("clip")).agg(
        F.sort_array(F.collect_list(F.struct((F.col("vec_id") % 5 + 1).cast("double").alias("w"), as_doubles(F.col("embedding")).alias("v")))).alias("f")
    )
    mean = weighted_mean(F.transform("f", lambda x: x["v"]), F.transform("f", lambda x: x["w"]), 64)
    return frames.select("clip", mean.alias("m")).select("clip", rounded(F.get("m", F.lit(0))).alias("first"), rounded(F.get("m", F.lit(63))).alias("last"))
