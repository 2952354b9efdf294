"""Face search, identity votes and people summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.functions.ids import PERSON_NAMESPACE, uuid5
from lumenlake.functions.similarity import as_doubles, cosine_to
from lumenlake.operators.founding import founded
from lumenlake.operators.filters import SearchFilters, conjunction, pushed, residual
from lumenlake.plans.scratch import materialised


def face_candidates(limit: int) -> int:
    return min(20 * limit, 500)


def match_faces(faces: DataFrame, query: list[float], limit: int) -> DataFrame:
    """The best faces for a query vector: columns of ``faces`` with score and ord (0 is the best)."""
    scored = faces.withColumn("score", cosine_to(as_doubles(F.col("vector")), query))
    top = scored.orderBy(F.desc("score"), "face_id").limit(face_candidates(limit))
    return top.withColumn("ord", F.row_number().over(Window.orderBy(F.desc("score"), "face_id")) - 1)  # 500 rows at most


def people_of_matches(matches: DataFrame) -> DataFrame:
    """Per person: best score (0 at least), faces, media, sorted face ids and the first label."""
    return (
        matches.where("person_id IS NOT NULL")
        .groupBy("person_id")
        .agg(
            F.greatest(F.max("score"), F.lit(0.0)).alias("score"),
            F.count_distinct("face_id").alias("face_count"),
            F.count_distinct("media_id").alias("media_count"),
            F.sort_array(F.collect_set("face_id")).alias("face_ids"),
            F.min_by("person_label", F.when(F.col("person_label").isNotNull(), F.col("ord"))).alias("label"),
        )
        .orderBy(F.desc("score"), "person_id")
    )


def media_of_matches(matches: DataFrame) -> DataFrame:
    """Per medium: best score (0 at least), faces, the person of its last match and of its best."""
    return (
        matches.groupBy("media_id")
        .agg(
            F.greatest(F.max("score"), F.lit(0.0)).alias("face_score"),
            F.sort_array(F.collect_set("face_id")).alias("face_ids"),
            F.max_by("person_id", "ord").alias("matched_person_id"),
            F.min_by("person_id", "ord").alias("best_person_id"),
        )
        .orderBy(F.desc("face_score"), "media_id")
    )


def query_face(faces: DataFrame) -> DataFrame:
    """The face that a picture is searched by: the largest area times confidence."""
    weight = F.col("bbox.width") * F.col("bbox.height") * F.col("confidence")
    w = Window.partitionBy("media_id").orderBy(F.desc(weight), "face_id")
    return faces.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def face_search(
    faces: DataFrame, media: DataFrame, query: list[float], filters: SearchFilters, limit: int
) -> tuple[DataFrame, DataFrame]:
    """People and media of the faces that match, of media that pass the filters; both best first, ``limit`` at most.

    Media carry all their columns.  There is no hash to compare, so near-duplicate filters pass none or all.
    """
    matches = match_faces(faces, query, limit)
    named = F.broadcast(matches.select(F.col("media_id").alias("id")).distinct())  # 500 at most
    kept = media.where(conjunction([*pushed(filters), *residual(filters)])).join(named, "id", "left_semi")
    seen = materialised(kept, "matched")  # 500 rows at most
    inside = matches.join(F.broadcast(seen.select(F.col("id").alias("media_id"))), "media_id", "left_semi")
    people = people_of_matches(inside).limit(limit)
    found = media_of_matches(inside).drop("best_person_id").withColumnRenamed("media_id", "id")
    results = seen.join(F.broadcast(found), "id").withColumns({
        "vector_score": F.col("face_score"), "relevance_score": F.col("face_score"), "near_duplicate": F.lit(False),
    })
    return people, results.orderBy(F.desc("face_score"), "filename", "id").limit(limit)


def assign_people(unknown: DataFrame, matches: DataFrame, threshold: float) -> DataFrame:
    """(face_id, person_id, label, confidence) of each unknown face (face_id): its vote, or a new person named after the face."""
    winners = vote(matches, "face_id", threshold).drop("votes")
    new = F.concat(F.lit("person-"), uuid5(F.col("face_id").cast("string"), PERSON_NAMESPACE))
    return unknown.select("face_id").join(winners, "face_id", "left").select(
        "face_id", F.coalesce("person_id", new).alias("person_id"), "label", F.coalesce("confidence", F.lit(1.0)).alias("confidence")
    )


def vote(matches: DataFrame, key: str, threshold: float) -> DataFrame:
    """The person of each unknown face: most matches within the distance, then the best score, then the last id.

    ``matches`` has the order of its matches in ``ord``; a person's label is the first that there is.
    """
    counted = (
        matches.where((1 - F.col("score") <= threshold) & F.col("person_id").isNotNull())
        .groupBy(key, "person_id")
        .agg(
            F.count("*").alias("votes"),
            F.max("score").alias("best"),
            F.min_by("person_label", F.when(F.col("person_label").isNotNull(), F.col("ord"))).alias("label"),
        )
    )
    rank = F.struct("votes", "best", "person_id")
    return counted.groupBy(key).agg(F.max_by(F.struct("person_id", "label", "votes", "best"), rank).alias("w")).select(
        key, "w.person_id", "w.label", "w.votes", F.least(F.lit(1.0), F.col("w.best") * F.col("w.votes")).alias("confidence")
    )


def summarise_people(faces: Column) -> Column:
    """People of one medium from its faces: counts, best confidence and first label, by person id."""
    ids = F.array_sort(F.array_distinct(F.filter(F.transform(faces, lambda f: f["person_id"]), lambda p: p.isNotNull())))

    def one(person):
        own = F.filter(faces, lambda f: f["person_id"] == person)
        labels = F.filter(F.transform(own, lambda f: f["person_label"]), lambda x: x.isNotNull())
        return F.struct(
            person.alias("person_id"),
            F.try_element_at(labels, F.lit(1)).alias("label"),
            F.size(own).alias("face_count"),
            F.size(F.array_distinct(F.transform(own, lambda f: f["media_id"]))).alias("media_count"),
            F.array_max(F.transform(own, lambda f: f["confidence"])).alias("confidence"),
        )

    return F.transform(ids, one)


def first_apart(faces: Column, threshold: float) -> Column:
    """Faces of one medium without those within ``threshold`` of one kept before them."""
    from lumenlake.functions.similarity import cosine

    same = lambda a, b: 1 - cosine(as_doubles(a["vector"]), as_doubles(b["vector"])) <= threshold
    return F.aggregate(
        faces,
        F.slice(faces, 1, 0),
        lambda acc, x: F.when(F.exists(acc, lambda y: same(x, y)), acc).otherwise(F.array_append(acc, x)),
    )


def cluster_in_order(faces: DataFrame, threshold: float, group: str = "media_id") -> DataFrame:
    """(group, face_id, person) by arrival: a face joins the person whose first face is most similar, or founds one.

    Groups of any size: see `founding.founded`, also for null and unequal vectors (a null person).
    """
    found = founded(faces, group, "face_id", "vector", 1 - threshold)
    return found.select(group, "face_id", F.col("founder").alias("person"))
