"""SimHash near-duplicates by tiled exact comparison.

A fingerprint holds, per bit, the majority over the XXH64 of a text's word shingles.
Distinct fingerprints are laid out in tiles by population count; every pair of tiles whose
counts can be within the radius is compared exactly, by numpy exclusive-or and bit counts.
Inside a pair of tiles, sub-tiles sorted by the counts of the four 16-bit quarters are
skipped when those differ by more than the radius in sum: a bit that differs changes one
quarter's count by one, so nothing within the radius is lost.

`near_duplicates` links by the radius alone.  `similar_documents` links texts whose sets of distinct
shingles have a Jaccard similarity of at least ``similarity``.  Sets of n shingles, put in one order
for all, that reach it share a shingle among their first n - ceil(similarity n) + 1: this prefix is
posted, and sets that meet are candidates if their two fingerprints, taken over the distinct
shingles, differ in no more bits than `sketch_radius`.  Shingles that are common in a sample come
last in the order, which shortens the lists and changes no result.  Candidates form clusters, and a
cluster's sets are compared exactly, in pairs of blocks of bounded size, skipping pairs that are
joined already.  No table of pairs is made, and no list or cluster is capped.

Cost: tiles are compared in pairs, so the work of `near_duplicates` grows with the square of the
number of distinct fingerprints, less what the counts exclude; the README has figures.

Edge cases: a null or empty text, or one without words, has fingerprint 0 and links like any
other; a text of fewer words than a shingle is one shingle; rows with equal ids share their
component per fingerprint; texts of any length are hashed whole, the fingerprints of `near_duplicates` a megabyte at a time; rows with a null id take part, but the component is the smallest
id that is not null (null if the class has none); an empty table gives an empty result;
further columns of the input are not read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlake.llm.common import joined_hot, written
from lumenlake.llm.graph import LocalForest, components
from lumenlake.plans.scratch import discard, materialised_at

SUB = 256  # fingerprints per sub-tile
WHITE = re.compile(rb"[\t-\r ]")


@dataclass(frozen=True)
class SimHashParams:
    shingle_words: int = 5
    radius: int = 4
    seed: int = 42
    tile: int = 16_384
    similarity: float = 0.8  # of `similar_documents`
    sketch_miss: float = 1e-6  # chance at most that a pair at the similarity is no candidate
    block: int = 1_024  # shingle sets of a block of a cluster
    block_bytes: int = 16 << 20  # and their shingles
    posting_block: int = 4_096  # sets of one list compared at once
    sampled: int = 16  # common shingles are counted in one of so many texts
    common: int = 65_536  # so many of them come last in the order


BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def shingle_hashes(text: bytes | None, shingle_words: int, seed: int) -> np.ndarray:
    """XXH64 of each word shingle of one text, repeats included."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = (text or b"").lower().split()  # bytes.lower is A-Z only; bytes.split cuts at 20, 09-0D
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return np.array([digest(joined, seed)] if words else [], dtype=np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1)[: len(words) - shingle_words + 1].tolist()
    stops = ends[shingle_words - 1 :].tolist()
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops)), dtype=np.uint64, count=len(starts))


def shingle_pieces(text: bytes | None, shingle_words: int, seed: int, piece: int = 1 << 20):
    """The hashes of `shingle_hashes`, for about ``piece`` bytes of text at a time; cuts are at white space."""
    if len(text or b"") <= piece:
        yield shingle_hashes(text, shingle_words, seed)
        return
    held, start, begun = [], 0, False
    while start < len(text):
        cut = WHITE.search(text, start + piece)
        end = cut.start() if cut else len(text)
        held += text[start:end].lower().split()
        start = end
        if len(held) >= shingle_words or (end == len(text) and not begun):
            yield shingle_hashes(b" ".join(held), shingle_words, seed)
            held, begun = held[len(held) - shingle_words + 1 :] if len(held) >= shingle_words else [], True


def majority(pieces) -> int:
    """The bits set in over half the hashes of arrays of them, as an unsigned 64-bit integer; 0 for none."""
    counts, total = np.zeros(64, dtype=np.int64), 0
    for hashes in pieces:
        total += len(hashes)
        for at in range(0, len(hashes), 65_536):
            lanes = hashes[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8)
            for lane in range(8):
                counts[lane * 8 : lane * 8 + 8] += np.bincount(lanes[:, lane], minlength=256) @ BYTE_BITS
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def fingerprint(text: bytes | None, shingle_words: int, seed: int) -> int:
    return majority(shingle_pieces(text, shingle_words, seed))


def remixed(hashes: np.ndarray) -> np.ndarray:
    """Other hashes of the same shingles, for a second fingerprint."""
    x = (hashes ^ (hashes >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def fingerprints(docs: DataFrame, params: SimHashParams) -> DataFrame:
    """(doc_id, fp) per row; fp is the fingerprint's 64 bits as a signed long."""
    rows = docs.select("doc_id", "text")
    words, seed = params.shingle_words, params.seed

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            fps = np.fromiter((fingerprint(t.as_py(), words, seed) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, fp long")


def _quarters(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp[:, None] >> np.array([48, 32, 16, 0], dtype=np.uint64) & np.uint64(0xFFFF)).astype(np.int16)


def _sorted_tile(fp: np.ndarray, ids: np.ndarray):
    q = _quarters(fp)
    order = np.lexsort((q[:, 3], q[:, 2], q[:, 1], q[:, 0]))
    fp, ids, q = fp[order], ids[order], q[order]
    cuts = range(0, len(fp), SUB)
    low = np.array([q[i : i + SUB].min(axis=0) for i in cuts])
    high = np.array([q[i : i + SUB].max(axis=0) for i in cuts])
    return fp, ids, low, high


def link_tiles(left, right, radius: int, forest: LocalForest) -> None:
    """Join into ``forest`` all pairs of the two sorted tiles within the radius."""
    (fa, ia, la, ha), (fb, ib, lb, hb) = left, right
    same = left is right
    for i in range(len(la)):
        gap = np.maximum(0, np.maximum(la[i] - hb, lb - ha[i])).sum(axis=1)
        near = np.nonzero(gap <= radius)[0]
        if same:
            near = near[near >= i]
        if not len(near):
            continue
        block = fa[i * SUB : (i + 1) * SUB]
        for at in range(0, len(near), 8):  # temporaries that fit a cache
            part = near[at : at + 8]
            cols = np.concatenate([np.arange(j * SUB, min((j + 1) * SUB, len(fb))) for j in part])
            rows, hits = np.nonzero(np.bitwise_count(block[:, None] ^ fb[cols][None, :]) <= radius)
            a, b = ia[i * SUB + rows], ib[cols[hits]]
            keep = a != b
            a, b = a[keep], b[keep]
            if len(a):  # only pairs that earlier unions have not made redundant reach the forest
                roots = {x: forest.find(x) for x in np.unique(np.concatenate([a, b])).tolist()}
                ra = np.fromiter((roots[x] for x in a.tolist()), dtype=np.int64, count=len(a))
                rb = np.fromiter((roots[x] for x in b.tolist()), dtype=np.int64, count=len(b))
                pairs = np.unique(np.stack([np.minimum(ra, rb), np.maximum(ra, rb)], axis=1)[ra != rb], axis=0)
                for x, y in pairs.tolist():
                    forest.union(x, y)


def tile_links(prints: DataFrame, params: SimHashParams) -> DataFrame:
    """Links (a, b) between the ids of distinct fingerprints (fp, id): a forest per pair of tiles.

    A tile is (population count, part): the 65 counts are gathered on the driver to decide how
    many parts each needs, so that a part holds about ``tile`` fingerprints whatever the
    distribution.  Each fingerprint is sent to the pairs its tile takes part in.
    """
    spark = prints.sparkSession
    radius, size = params.radius, params.tile
    sized = prints.withColumn("pop", F.bit_count("fp"))
    counts = {r["pop"]: r["n"] for r in sized.groupBy("pop").agg(F.count("*").alias("n")).collect()}  # 65 rows at most
    parts = {p: max(1, -(-n // size)) for p, n in counts.items()}
    tiles = [(p, s) for p in sorted(parts) for s in range(parts[p])]
    number = {t: i for i, t in enumerate(tiles)}
    # neighbours of a tile are those of the population counts within the radius: a range of numbers
    first = {p: number[(min(q for q in parts if q >= p - radius), 0)] for p in parts}
    last = {p: number[(max(q for q in parts if q <= p + radius), parts[max(q for q in parts if q <= p + radius)] - 1)] for p in parts}
    plan = spark.createDataFrame(
        [(p, parts[p], number[(p, 0)], first[p], last[p]) for p in parts] or [],
        "pop int, parts int, base int, first int, last int",
    )
    placed = (
        sized.join(F.broadcast(plan), "pop")
        .withColumn("tile", F.col("base") + F.pmod(F.xxhash64("fp"), F.col("parts").cast("long")).cast("int"))
        .withColumn("other", F.explode(F.sequence("first", "last")))
        .select(
            F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "fp", "id"
        )
    )
    n_pairs = sum(last[p] - first[p] + 1 for p, _ in tiles) // 2 + 1
    dealt = placed.repartition(min(max(n_pairs, 1), 20_000), "i", "j").sortWithinPartitions("i", "j", "tile")

    def run(batches):
        import pyarrow as pa

        held: dict = {"key": None, "rows": []}
        out: list[tuple[int, int]] = []

        def close():
            if held["key"] is None:
                return
            i, j = held["key"]
            tile, fp, ids = (np.concatenate([r[k] for r in held["rows"]]) for k in range(3))
            fp = fp.view(np.uint64)
            here = [tile == t for t in ((i,) if i == j else (i, j))]
            sides = [_sorted_tile(fp[m], ids[m]) for m in here if m.any()]
            forest = LocalForest()
            if i == j or len(sides) == 2:
                link_tiles(sides[0], sides[-1], radius, forest)
            out.extend(forest.edges())

        for batch in batches:
            i, j, *columns = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("i", "j", "tile", "fp", "id"))
            if not len(i):
                continue
            cuts = np.nonzero((np.diff(i) != 0) | (np.diff(j) != 0))[0] + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(i)]):
                key = (int(i[a]), int(j[a]))
                if key != held["key"]:
                    close()
                    held["key"], held["rows"] = key, []
                held["rows"].append([c[a:b].copy() for c in columns])
        close()
        a, b = (np.array([e[k] for e in out], dtype=np.int64) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, params: SimHashParams = SimHashParams()) -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs``."""
    prints = written(fingerprints(docs, params), "simhash")
    distinct = written(
        prints.groupBy("fp").agg(F.min("doc_id").cast("long").alias("first_id"), F.count("*").alias("n")), "simhash"
    )
    # nodes are the fingerprints themselves, so that a class without an id still is one
    links = tile_links(distinct.select("fp", F.col("fp").alias("id")), params)
    member = components(links)
    classes = distinct.join(member, distinct["fp"] == member["node"], "left").select(
        "fp", F.coalesce("component", "fp").alias("cls"), "first_id"
    )
    named = classes.groupBy("cls").agg(F.min("first_id").alias("component_id"))
    by_print = classes.join(named, "cls").select("fp", "component_id")
    return joined_hot(prints, by_print, ["fp"], "inner").select("doc_id", "fp", "component_id")


def bit_difference(common: int, a: int, b: int) -> float:
    """The chance that a fingerprint's bit differs between sets with so many common and own shingles."""
    def above(own: int) -> np.ndarray:  # by the common shingles that have the bit: chance of a majority
        odds = np.array([math.comb(own, k) for k in range(own + 1)]) / 2.0**own
        return np.array([odds[[2 * (c + k) > common + own for k in range(own + 1)]].sum() for c in range(common + 1)])

    x, y = above(a), above(b)
    odds = np.array([math.comb(common, c) / 2.0**common for c in range(common + 1)])
    return float((odds * (x * (1 - y) + y * (1 - x))).sum())


def sketch_radius(similarity: float, miss: float) -> int:
    """The bits of two fingerprints, 128, in which a pair at the similarity differs at most but for the chance ``miss``.

    A bit differs most often in small sets, which are tried one by one; large ones follow the
    angle between their vectors, which is widest when neither set holds the other.
    """
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    for common in range(1, 41):
        own = int(common / similarity - common + 1e-9)
        p = max([p, *(bit_difference(common, a, own - a) for a in range(own // 2 + 1))])
    tail, radius = 1.0, -1
    while tail > miss and radius < 128:
        radius += 1
        tail -= math.comb(128, radius) * p**radius * (1 - p) ** (128 - radius)
    return radius


def with_shingles(docs: DataFrame, params: SimHashParams) -> DataFrame:
    """(doc_id, id, shingles) per row: set id (a hash of the distinct shingles) and the set, as bytes."""

    def columns(hashes, distinct):
        return [distinct.tobytes()]

    return _by_text(docs, params, columns, "shingles binary")


def common_shingles(docs: DataFrame, params: SimHashParams) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are common in a sample, sorted, and their counts: bounded by ``common``."""
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(params.sampled)) == 0)
    each = _by_text(sample, params, lambda hashes, distinct: [distinct.view(np.int64)], "shingles array<long>")
    counts = each.select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"))
    top = counts.where("n > 3").orderBy(F.desc("n"), "shingle").limit(params.common).collect()
    found = np.array([(r.shingle, r.n) for r in top], dtype=np.int64).reshape(-1, 2)
    hashes = found[:, 0].copy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], found[order, 1]


def prefix(distinct: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The shingles of a sorted set of which any set with the similarity has one in its own prefix."""
    hashes, counts = common
    if len(hashes) and len(distinct):
        at = np.minimum(np.searchsorted(hashes, distinct), len(hashes) - 1)
        distinct = distinct[np.lexsort((distinct, np.where(hashes[at] == distinct, counts[at], 0)))]
    return distinct[: len(distinct) - math.ceil(similarity * len(distinct) - 1e-9) + 1]


def shingle_sets(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], params: SimHashParams) -> DataFrame:
    """(doc_id, id, fp, second, size, prefix) per row: set id, two fingerprints of the set, its size and prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(common)  # params.common shingles at most
    similarity = params.similarity

    def columns(hashes, distinct):
        prints = np.array([majority([distinct]), majority([remixed(distinct)])], dtype=np.uint64).view(np.int64)
        return [*prints.tolist(), len(distinct), prefix(distinct, shared.value, similarity).view(np.int64)]

    return _by_text(docs, params, columns, "fp long, second long, size long, prefix array<long>")


def _by_text(docs: DataFrame, params: SimHashParams, columns, schema: str) -> DataFrame:
    """(doc_id, id) and what ``columns`` makes of a text's shingle hashes and the sorted distinct ones, per row."""
    rows = docs.select("doc_id", "text")
    words, seed = params.shingle_words, params.seed
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, id long, {schema}"
    kinds = {"long": "int64", "binary": "binary", "array<long>": "list"}
    names, types = zip(*(c.strip().split(" ", 1) for c in schema.split(",")[-(schema.count(",")) :]))

    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            out: list[list] = [[] for _ in names]
            for t in batch.column("text").cast(pa.large_binary()):
                hashes = shingle_hashes(t.as_py(), words, seed)
                distinct = np.unique(hashes)
                name = np.array([xxhash.xxh64_intdigest(distinct.tobytes(), seed)], dtype=np.uint64).view(np.int64)[0]
                for column, value in zip(out, [int(name), *columns(hashes, distinct)]):
                    column.append(value)
            arrow = [pa.array(c, pa.list_(pa.int64()) if k == "array<long>" else getattr(pa, kinds[k])()) for c, k in zip(out, types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrow], ["doc_id", *names])

    return rows.mapInArrow(run, schema)


def prefix_links(sets: DataFrame, common: tuple[np.ndarray, np.ndarray], params: SimHashParams) -> DataFrame:
    """Candidate links (a, b) of distinct sets (id, fp, second, size, prefix): a forest per task.

    Postings are shuffled once, by shingle.  Only shingles that are common in the sample can have very
    long lists; those are counted, and a long one is dealt to pairs of blocks under keys of their own
    (a chance clash of keys makes two lists one, which adds comparisons and changes no link).
    """
    spark = sets.sparkSession
    postings = sets.select("id", "fp", "second", F.col("size").cast("int").alias("size"), F.explode("prefix").alias("shingle"))
    known = F.broadcast(spark.createDataFrame([(h,) for h in common[0].view(np.int64).tolist()], "shingle long"))  # params.common at most
    counts = postings.select("shingle").join(known, "shingle").groupBy("shingle").agg(F.count("*").alias("n"))
    long_lists = counts.select("shingle", F.ceil(F.col("n") / F.lit(params.posting_block)).alias("blocks")).where("blocks > 1")
    blocks = F.coalesce("blocks", F.lit(1).cast("long"))
    placed = (
        postings.join(F.broadcast(written(long_lists, "lists")), "shingle", "left")
        .withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    )
    own_key = F.xxhash64("shingle", F.least("block", "other"), F.greatest("block", "other"))
    dealt = placed.select(F.when(F.col("blocks") == 1, F.col("shingle")).otherwise(own_key).alias("key"), "id", "fp", "second", "size")
    dealt = dealt.repartition("key").sortWithinPartitions("key")
    radius, similarity = sketch_radius(params.similarity, params.sketch_miss), params.similarity

    def run(batches):
        import pyarrow as pa

        forest, held = LocalForest(), None

        def link(columns, starts, stops):
            ids, fp, second, size = columns
            fp, second = fp.view(np.uint64), second.view(np.uint64)

            def near(x, y):
                return candidates(fp[x], second[x], size[x], fp[y], second[y], size[y], radius, similarity)

            two = starts[stops - starts == 2]
            for x in two[near(two, two + 1)].tolist():
                forest.union(int(ids[x]), int(ids[x + 1]))
            more = stops - starts > 2
            for start, stop in zip(starts[more].tolist(), stops[more].tolist()):
                rest = np.arange(start, stop)
                while len(rest) > 1:  # what a set reaches leaves the rest, so that a list of near copies is soon done
                    reached, rest = [rest[0]], rest[1:]
                    while reached and len(rest):
                        x = reached.pop()
                        hit = near(x, rest)
                        if hit.any():
                            for y in rest[hit].tolist():
                                forest.union(int(ids[x]), int(ids[y]))
                            reached += rest[hit].tolist()
                            rest = rest[~hit]

        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "id", "fp", "second", "size")]
            if not len(columns[0]):
                continue
            if held is not None:
                columns = [np.concatenate(c) for c in zip(held, columns)]
            cuts = np.nonzero(np.diff(columns[0]) != 0)[0] + 1
            if len(cuts):
                link(columns[1:], np.r_[0, cuts[:-1]], cuts)
            held = [c[cuts[-1] if len(cuts) else 0 :].copy() for c in columns]
        if held is not None:
            link(held[1:], np.array([0]), np.array([len(held[0])]))
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in forest.edges()], pa.int64()) for k in (0, 1)], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def candidates(fp, second, size, fp2, second2, size2, radius: int, similarity: float) -> np.ndarray:
    """Whether two fingerprints and the sizes allow the similarity."""
    bits = np.bitwise_count(fp ^ fp2) + np.bitwise_count(second ^ second2)
    return (bits <= radius) & (np.minimum(size, size2) >= similarity * np.maximum(size, size2) - 1e-9)


def verified_links(members: DataFrame, params: SimHashParams) -> DataFrame:
    """Links (a, b) of cluster members (cluster, blocks, id, fp, second, shingles) with the similarity: a forest per pair of blocks."""
    placed = (
        members.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "fp", "second", "shingles")
    )
    dealt = placed.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "block")
    radius, similarity = sketch_radius(params.similarity, params.sketch_miss), params.similarity

    def compare(rows: list[tuple], forest: LocalForest) -> None:
        fp, second = (np.array([r[k] for r in rows], dtype=np.int64).view(np.uint64) for k in (2, 3))
        size = np.array([len(r[4]) // 8 for r in rows])

        def close_pairs():
            for at in range(0, len(rows), 256):  # bounded memory
                part = slice(at, at + 256)
                near = candidates(fp[part, None], second[part, None], size[part, None], fp[None, at:], second[None, at:], size[None, at:], radius, similarity)
                for x, y in zip(*(k.tolist() for k in np.nonzero(np.triu(near, 1)))):
                    yield at + x, at + y

        for x, y in close_pairs():
            if forest.find(rows[x][1]) != forest.find(rows[y][1]):
                p, q = (np.frombuffer(rows[k][4], dtype=np.uint64) for k in (x, y))
                common = len(np.intersect1d(p, q, assume_unique=True))
                if common >= similarity * (len(p) + len(q) - common):
                    forest.union(rows[x][1], rows[y][1])

    def run(batches):
        import pyarrow as pa

        key, rows, forest, out = None, [], LocalForest(), []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("cluster", "i", "j", "block", "id", "fp", "second", "shingles")]
            for cluster, i, j, *row in zip(*columns):
                if (cluster, i, j) != key:
                    compare(rows, forest) if rows else None
                    if key is not None and cluster != key[0]:
                        out += forest.edges()
                        forest = LocalForest()
                    key, rows = (cluster, i, j), []
                rows.append(row)
        if rows:
            compare(rows, forest)
        out += forest.edges()
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def similar_documents(docs: DataFrame, params: SimHashParams = SimHashParams()) -> DataFrame:
    """(doc_id, id, component_id) per row: classes of documents linked by shingle similarity."""
    return classified(docs, params).drop("cls")


def classified(docs: DataFrame, params: SimHashParams) -> DataFrame:
    """(doc_id, id, cls, component_id) per row; cls tells apart classes whose smallest ids are equal.

    Equal shingle sets are one node.  Only the texts of clustered nodes are read a second time.
    """
    spark, common = docs.sparkSession, common_shingles(docs, params)
    full, full_path = materialised_at(shingle_sets(docs, common, params), "shingles")
    one = full.groupBy("id").agg(
        F.min("doc_id").cast("long").alias("first_id"), *[F.first(c).alias(c) for c in ("fp", "second", "size", "prefix")]
    )
    sets, sets_path = materialised_at(one, "sets")
    prints = written(full.select("doc_id", "id"), "prints")
    discard(spark, full_path)  # prefixes are as long as the texts: they go as soon as they have been used
    links = written(prefix_links(sets, common, params), "links")
    distinct = written(sets.select("id", "first_id", "fp", "second", "size"), "distinct")
    discard(spark, sets_path)
    clusters = components(links)
    members = clusters.select(F.col("node").alias("id"), F.col("component").alias("cluster")).join(distinct, "id")
    of_count, of_bytes = F.count("*") / F.lit(params.block), F.sum(F.col("size") * 8) / F.lit(params.block_bytes)
    sizes = members.groupBy("cluster").agg(F.ceil(F.greatest(of_count, of_bytes)).cast("int").alias("blocks"))
    placed = written(members.drop("size").join(sizes, "cluster"), "clusters")
    wanted = placed.select(F.col("first_id").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    texts = docs.select("doc_id", "text")
    again = texts.join(wanted, "doc_id", "left_semi").unionByName(texts.where("doc_id IS NULL"))
    sets = with_shingles(again, params).drop("doc_id").dropDuplicates(["id"])
    linked = components(verified_links(sets.join(placed, "id"), params))
    classes = distinct.join(linked, distinct["id"] == linked["node"], "left").select(
        "id", F.coalesce("component", "id").alias("cls"), "first_id"
    )
    named = classes.groupBy("cls").agg(F.min("first_id").alias("component_id"))
    slim = prints.select("doc_id", "id")
    return joined_hot(slim, classes.join(named, "cls"), ["id"], "inner").select("doc_id", "id", "cls", "component_id")


def hex_of(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(docs: DataFrame, params: SimHashParams = SimHashParams()) -> DataFrame:
    """One document of each class stays, that with the smallest id; of its repeated rows, one.

    Rows that share an id but not a shingle set are documents of their own, of one class or several.
    Rows without an id stay only if their whole class has none (they can't be told apart).
    """
    found = written(classified(docs, params), "kept")
    columns = docs.columns
    named = found.where("doc_id IS NOT NULL")
    first = named.groupBy("cls").agg(F.min(F.struct("doc_id", "id")).alias("first")).select("first.doc_id", F.col("first.id").alias("_set_id"))
    sets = named.groupBy("doc_id").agg((F.min("id") == F.max("id")).alias("one")).join(first, "doc_id")
    # only ids with several sets need their texts' sets to tell their rows apart
    single = docs.join(sets.where("one").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    several = written(sets.where("NOT one").select("doc_id", "_set_id"), "kept")
    shared = with_set_id(docs.join(several.select("doc_id"), "doc_id", "left_semi").select(columns), params)
    shared = shared.join(several, ["doc_id", "_set_id"], "left_semi").dropDuplicates(["doc_id", "_set_id"])
    nameless = found.where("doc_id IS NULL AND component_id IS NULL").select(F.col("id").alias("_set_id")).distinct()
    unnamed = with_set_id(docs.where("doc_id IS NULL"), params).join(nameless, "_set_id", "left_semi")
    return single.select(columns).unionByName(shared.select(columns)).unionByName(unnamed.select(columns))


def with_set_id(docs: DataFrame, params: SimHashParams) -> DataFrame:
    """``docs`` with the hash of each row's distinct shingles as ``_set_id``."""
    words, seed = params.shingle_words, params.seed

    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            ids = [xxhash.xxh64_intdigest(np.unique(shingle_hashes(t.as_py(), words, seed)).tobytes(), seed) for t in texts]
            yield batch.append_column("_set_id", pa.array(np.array(ids, dtype=np.uint64).view(np.int64)))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_set_id", T.LongType())]))
