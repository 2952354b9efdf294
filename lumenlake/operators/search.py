"""Vector, text and multi-part search.

A query vector is a constant, so a search is one scan with ``TakeOrderedAndProject``; many
queries at once are compared per partition with a matrix product, each partition sending its
best rows only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlake.functions.similarity import as_doubles, cosine_to, hamming_hex, relevance
from lumenlake.functions.text import holds_terms, match_score
from lumenlake.operators.filters import SearchFilters, conjunction, pushed, residual
from lumenlake.plans.scratch import materialised

CANDIDATES = 500


def top_vectors(vectors: DataFrame, query: list[float], limit: int, id_column: str, vector: str) -> DataFrame:
    """The ``limit`` rows of the highest cosine, best first, ties by id."""
    scored = vectors.withColumn("score", cosine_to(as_doubles(F.col(vector)), query))
    return scored.orderBy(F.desc("score"), id_column).limit(limit)


def candidate_window(limit: int, narrowed: bool) -> int:
    """Rows fetched before residual filters: 8 a result with any of those, 500 at most."""
    return min(limit * 8, CANDIDATES) if narrowed else min(limit, CANDIDATES)


def search_media(
    media: DataFrame, query: list[float], phash: str, filters: SearchFilters, limit: int | None,
    threshold: int = 8, text: str | None = None, exact: bool = False,
) -> DataFrame:
    """Filtered vector search: pushed filters, best candidates, then residual filters and order.

    The residual filters see a bounded window of candidates, as the result may be short of
    ``limit``; ``exact`` applies them to all rows instead, and may be without a limit (None).
    """
    distance = hamming_hex(F.col("phash"), F.lit(phash))
    rows = media.where(conjunction(pushed(filters)))
    rest = residual(filters, F.col("phash_distance"), threshold)
    scored = rows.withColumn("vector_score", cosine_to(as_doubles(F.col("visual")), query)).withColumn("phash_distance", distance)
    if text:
        scored = scored.withColumn("text_score", match_score(text, F.col("ocr_text")))
        rest.append(F.col("text_score").isNotNull())
    if limit is None and not exact:
        raise ValueError("a search without a limit is exact")
    if not exact:
        window = candidate_window(limit, bool(rest))
        scored = scored.orderBy(F.desc("vector_score"), "id").limit(window)
    best = [F.desc("text_score")] if text else []
    found = (
        scored.where(conjunction(rest))
        .withColumn("near_duplicate", F.coalesce(F.col("phash_distance") <= threshold, F.lit(False)))
        .withColumn("relevance_score", relevance(F.col("vector_score"), F.col("phash_distance"), threshold))
        .orderBy(*best, F.desc("vector_score"), "id")
    )
    return found if limit is None else found.limit(limit)


def text_matches(media: DataFrame, query: str):
    """Whether one of the texts of a medium (recognised text, frames, transcript, its segments) holds the query."""
    audio = F.col("audio_analysis")
    one = lambda c: F.coalesce(holds_terms(query, c), F.lit(False))
    several = lambda items: F.coalesce(F.exists(items, lambda x: one(x["text"])), F.lit(False))
    return one(F.col("ocr_text")) | several(F.col("ocr_frames")) | one(audio["transcript_text"]) | several(audio["transcript_segments"])


def search_text(media: DataFrame, query: str, filters: SearchFilters, limit: int | None) -> DataFrame:
    """The rows with a text that holds the query, by file name; score is 1, as there is no partial credit."""
    if not query.strip():
        raise ValueError("a text query is required")
    found = media.where(conjunction([*pushed(filters), *residual(filters), text_matches(media, query)]))
    ordered = found.withColumn("score", F.lit(1.0)).orderBy("filename", "id")
    return ordered if limit is None else ordered.limit(limit)


def response(results: DataFrame, text: bool = False) -> DataFrame:
    """Results as they are answered: the row with vector score, relevance, distance, text score and near_duplicate.

    A text search has no vector: its score stands for vector score, relevance and text score alike.
    """
    if not text:
        return results
    score = F.col("score")
    none = F.lit(None).cast("int")
    return results.withColumns({"vector_score": score, "relevance_score": score, "phash_distance": none, "text_score": score, "near_duplicate": F.lit(False)}).drop("score")


def merged_parts(parts: list[DataFrame], id_column: str, score: str) -> DataFrame:
    """The results of all parts of a query, numbered in ``part``, as one list: each id once, by its best part."""
    numbered = [p.withColumn("part", F.lit(n)) for n, p in enumerate(parts)]
    return best_per_id(reduce(DataFrame.unionByName, numbered), id_column, score, "part")


def best_per_id(results: DataFrame, id_column: str, score: str, part: str) -> DataFrame:
    """One row per id over all query parts: the highest score, the earliest part on a tie."""
    w = Window.partitionBy(id_column).orderBy(F.desc(score), part)
    best = results.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return best.orderBy(F.desc(score), id_column)


QUERY_BLOCK = 1_024
SCORED_ROWS = 1_024  # rows that are compared with a block of queries at once: 8 MB of scores


def batch_top_vectors(vectors: DataFrame, queries: DataFrame, limit: int, id_column: str, vector: str) -> DataFrame:
    """(query_id, id, score, rank): the best ``limit`` rows of each query, for any number of queries.

    ``queries`` is (query_id, a vector column named like that of ``vectors``).  They are taken in blocks
    of about QUERY_BLOCK, one pass over the vectors each; a partition keeps its best per query, so what
    is shuffled is partitions x queries x limit.  Ids keep their types; ties go by id.  A query is compared
    with the vectors of its own length only.  Vectors that are null or hold a null, of queries too, are left
    out; a zero vector's score is 0.  Equal queries are one; of several vectors of a query id each row's best
    score counts.
    """
    asked = queries.select("query_id", as_doubles(F.col(vector)).alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())).distinct()
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    numbered = asked.withColumn("_block", F.pmod(F.xxhash64("query_id", "v"), F.lit(blocks)))
    out = None
    for n in range(blocks):
        part = _block_top(vectors, numbered.where(F.col("_block") == n), limit, id_column, vector)
        part = part if blocks == 1 else materialised(part, "knn")
        out = part if out is None else out.unionByName(part)
    out = out.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= limit)


def _block_top(vectors: DataFrame, queries: DataFrame, limit: int, id_column: str, vector: str) -> DataFrame:
    import numpy as np
    from pyspark.sql.pandas.types import to_arrow_type

    rows = queries.orderBy("query_id", "v").collect()  # a block: distinct queries dealt by a hash of id and vector
    kinds = (dict(queries.dtypes)["query_id"], dict(vectors.dtypes)[id_column])
    schema = f"query_id {kinds[0]}, id {kinds[1]}, score double"
    if not rows:
        return vectors.sparkSession.createDataFrame([], schema)
    by_length = {}
    for width in sorted({len(r.v) for r in rows}):
        own = [r for r in rows if len(r.v) == width]
        matrix = np.array([r.v for r in own], dtype=np.float64).reshape(len(own), width)
        by_length[width] = ([r.query_id for r in own], matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300))
    shared = vectors.sparkSession.sparkContext.broadcast(by_length)
    types = [to_arrow_type(f.dataType) for f in T.StructType.fromDDL(schema)]

    def run(batches):
        import pyarrow as pa

        held = {width: [[] for _ in asked] for width, (asked, _) in shared.value.items()}
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_pylist()
            order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i])))  # ties go by id: rows in that order
            offsets = np.asarray(batch.column(1).offsets)
            sizes = np.diff(offsets)[order]
            values = batch.column(1).values.to_numpy(zero_copy_only=False)
            for width, (_, units) in shared.value.items():
                own = order[sizes == width]
                if len(own):
                    x = values[offsets[own][:, None] + np.arange(width)[None, :]].reshape(len(own), width)
                    _keep_best(held[width], x, [ids[i] for i in own.tolist()], units, limit)
        flat = [(q, i, s) for width, (asked, _) in shared.value.items() for q, best in zip(asked, held[width]) for s, i in best]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in flat], types[c]) for c in range(3)], ["query_id", "id", "score"])

    usable = vectors.select(F.col(id_column).alias("id"), as_doubles(F.col(vector)).alias("v"))
    usable = usable.where(F.size("v").isin(sorted(by_length)) & ~F.exists("v", lambda x: x.isNull()))
    return usable.mapInArrow(run, schema)


def _keep_best(held: list[list[tuple]], x, ids: list, units, limit: int) -> None:
    """Merge the scores of rows (in the order of their ids) into the best of each query."""
    import numpy as np

    for at in range(0, len(x), SCORED_ROWS):
        part = x[at : at + SCORED_ROWS]
        size = np.linalg.norm(part, axis=1)
        scores = np.where(size[:, None] > 0, part @ units.T / np.maximum(size, 1e-300)[:, None], 0.0)
        last = min(limit, len(part)) - 1
        cut = -np.partition(-scores, last, axis=0)[last]
        top = scores.max(axis=0)
        for k, best in enumerate(held):
            if len(best) == limit and top[k] < best[-1][0]:
                continue
            new = [(float(scores[r, k]), ids[at + r]) for r in np.nonzero(scores[:, k] >= cut[k])[0].tolist()]
            held[k] = sorted([*best, *new], key=lambda t: (-t[0], t[1] is not None, t[1]))[:limit]
