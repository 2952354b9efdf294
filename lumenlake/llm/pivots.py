"""Near-duplicate vectors by a pivot-permutation index.

Reference points (pivots) are drawn from a bounded sample and kept well apart.  A vector is
described by its permutation: the pivots in the order of their nearness, of which the first
``prefix`` are kept.  The inverted lists hold, for each pivot, the vectors that have it among their
first few pivots; two vectors that meet in a list are candidates if they share at least so many
pivots of their prefixes, and candidates are verified by their cosine in double precision.  A pair
is counted in the list of the smallest pivot in which it meets, so that no pair of lists counts it
twice, and no table of pairs is made.

Vectors are described after the mean of the sample is taken from them, since vectors that share a
direction have all the same nearest pivots otherwise; verification sees them as they are.  How many
pivots there are, how far apart, in how many lists a vector is and how many pivots are asked for is fitted
to the sample: mates of sample vectors are made at exactly the threshold, each on the way to another sample
vector, so that they lie where the table's own pairs lie.  For 1, 16, 32 ... pivots the fewest lists and
then the strictest count are taken at which ``recall`` of the mates are found, and of those the number of
pivots with the least estimated cost for the table's size (comparisons fall with it, descriptions grow).  One
pivot is one list, in which nothing is lost: small tables and tables that no pivots divide take it.

A vector travels as the bytes it was stored in to each of its lists, and in a list that is longer than a block
to each pair of blocks it is part of; blocks hold up to ``block_bytes``, so lists of any size are compared whole
and none is capped, but beyond blocks x pivots vectors the copies grow with the table.

Equal vectors are one vector with a weight.  Vectors of unequal lengths never meet.  The most
common lengths (``widths`` at most) have pivots; each other length is a single list.

Edge cases: vectors that are null, empty, zero, or hold a null or non-finite component link with
nothing and are their own component; components of any finite size are compared (vectors are scaled
by their largest component first); copies and ties at the threshold link with each other; rows that
repeat an id are counted as rows; a null id takes part as a link but has no component of its own
(null if it is not joined to an id); an empty table gives an empty result; further columns are not
read.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import joined_hot, written
from lumenlake.llm.graph import LocalForest, components


@dataclass(frozen=True)
class PivotParams:
    threshold: float = 0.9
    min_pivots: int = 1
    max_pivots: int = 2_048
    prefix: int = 32  # pivots of a permutation that are kept
    recall: float = 0.99  # of the sample's mates
    sample: int = 8_192  # vectors of a length from which pivots are taken
    mates: int = 1_024  # of the sample, on which the index is fitted
    widths: int = 8  # lengths that have pivots of their own
    least_block: int = 1_024
    block_bytes: int = 16 << 20  # vectors of a block at most
    seed: int = 7


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled by the largest component first, so that squares neither over- nor underflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """``count`` sample vectors (or all, if fewer) of which the closest pair is as far apart as a few trials find."""
    for apart in (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 2.0):
        kept = np.zeros((min(count, len(sample)), sample.shape[1]))
        n = 0
        for v in sample:
            if n == len(kept):
                break
            if n == 0 or apart > 1 or (kept[:n] @ v).max() < apart:
                kept[n] = v
                n += 1
        if n == len(kept):
            break
    return kept


def mates_of(x: np.ndarray, others: np.ndarray, threshold: float) -> np.ndarray:
    """Unit rows with cosine ``threshold`` to those of ``x``, on the way to other rows, or as near to it as these are."""
    near, far = np.zeros((len(x), 1)), np.ones((len(x), 1))
    for _ in range(40):
        middle = (near + far) / 2
        y = x + middle * (others - x)
        apart = (x * y).sum(axis=1, keepdims=True) < threshold * np.sqrt((y * y).sum(axis=1, keepdims=True))
        near, far = np.where(apart, near, middle), np.where(apart, middle, far)
    y = x + near * (others - x)
    return y / np.maximum(np.sqrt((y * y).sum(axis=1, keepdims=True)), 1e-300)


def centred(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Unit rows as seen from the centre; a row in the centre is zero."""
    y = x - centre
    return y / np.maximum(np.sqrt((y * y).sum(axis=1, keepdims=True)), 1e-12)


@dataclass
class Described:
    """How vectors of a length are described and posted."""

    centre: np.ndarray
    pivots: np.ndarray
    lists: int  # in which a vector is
    shared: int  # pivots that two prefixes have in common at least

    def permutations(self, x: np.ndarray, prefix: int) -> np.ndarray:
        return permutations(centred(x, self.centre), self.pivots, prefix)


def fitted(sample: np.ndarray, count: int, params: PivotParams) -> Described:
    """The description with the least estimated cost that finds ``recall`` of the sample's mates."""
    centre = sample.mean(axis=0)
    one = Described(centre, np.zeros((1, sample.shape[1])), 1, 1)  # one list of all
    if len(sample) < 32:
        return one
    seen = centred(sample, centre)
    order = np.random.default_rng(params.seed).permutation(len(sample))
    held = min(params.mates, len(sample) // 2)
    probe, seen = sample[order[:held]], seen[order[held:]]  # no probe is a pivot
    mates = mates_of(probe, probe[np.roll(np.arange(len(probe)), 1)], params.threshold)
    options = []
    n = 1
    most = max(1, len(seen) // 2)
    while n <= min(params.max_pivots, most):
        if n >= min(params.min_pivots, most):
            known = Described(centre, choose_pivots(seen, n), 1, 1)
            a, b = (known.permutations(x, params.prefix) for x in (probe, mates))
            common = (a[:, :, None] == b[:, None, :]).any(axis=2).sum(axis=1)
            for k in range(1, a.shape[1] + 1):
                meet = (a[:, :k, None] == b[:, None, :k]).any(axis=(1, 2))
                if meet.mean() >= params.recall:
                    break
            if meet.mean() >= params.recall:
                found = [s for s in range(1, a.shape[1] + 1) if (meet & (common >= s)).mean() >= params.recall - 0.005]
                posted = np.bincount(known.permutations(sample[order[: 4 * params.mates]], params.prefix)[:, :k].ravel(), minlength=n).astype(np.float64)
                work = (posted**2).sum() / min(len(sample), 4 * params.mates) ** 2
                # in units of a comparison: pairs that meet in lists, copies of a vector, descriptions
                cost = count * work + 200.0 * k + 0.1 * n * sample.shape[1] * (n > 1)
                options.append((cost, n, Described(centre, known.pivots, k, max(found))))
        n = 16 if n == 1 else 2 * n
    return min(options, key=lambda o: o[:2])[2] if options else one


def permutations(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The numbers of the nearest pivots of each unit row, nearest first; ties by number."""
    sim = x @ pivots.T
    m = min(prefix, len(pivots))
    near = np.sort(np.argpartition(-sim, m - 1, axis=1)[:, :m], axis=1)
    order = np.argsort(-np.take_along_axis(sim, near, axis=1), axis=1, kind="stable")
    return np.take_along_axis(near, order, axis=1).astype(np.int16)


def keyed_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, key, v) per row: the vector's bytes as stored (negative zero as zero) and their digest; null if unusable."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    single = rows.schema["embedding"].dataType.simpleString() == "array<float>"
    rows = rows.withColumn("embedding", F.col("embedding").cast("array<float>" if single else "array<double>"))
    kind = np.float32 if single else np.float64

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lists = batch.column("embedding")
            offsets = np.asarray(lists.offsets)
            x = lists.values.to_numpy(zero_copy_only=False).astype(kind) + kind(0)  # null components become nan
            wrong, some = (np.concatenate([[0], np.cumsum(t)]) for t in (~np.isfinite(x), x != 0))
            first, last = offsets[:-1], offsets[1:]
            good = np.asarray(lists.is_valid()) & (wrong[last] == wrong[first]) & (some[last] > some[first])
            v = [x[a:b].tobytes() if ok else None for a, b, ok in zip(first.tolist(), last.tolist(), good.tolist())]
            key = [None if b is None else hashlib.blake2b(b, digest_size=16).digest() for b in v]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(key, pa.binary()), pa.array(v, pa.binary())], ["vec_id", "key", "v"])

    return rows.mapInArrow(run, "vec_id long, key binary, v binary")


class PivotIndex:
    """Pivots by vector length, and what is needed to describe and post vectors.  Bounded by the parameters."""

    def __init__(self, distinct: DataFrame, count: int, single: bool, params: PivotParams):
        self.kind, self.params = np.dtype(np.float32 if single else np.float64), params
        size = F.octet_length("v")
        common = distinct.groupBy(size.alias("bytes")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bytes").limit(params.widths).collect()
        self.known: dict[int, Described] = {}
        for r in common:
            sample = distinct.where(size == r.bytes).orderBy("key").limit(params.sample).select("v").collect()  # bounded by params.sample
            rows = unit_rows(np.stack([np.frombuffer(x.v, dtype=self.kind) for x in sample]))
            self.known[r.bytes] = fitted(rows, r.n, params)

    def described(self, v: list[bytes]):
        """(rows, lists, permutations) for each length among the vectors; a list's number holds length and pivot."""
        sizes = np.array([len(b) for b in v])
        for size in np.unique(sizes).tolist():
            at = np.nonzero(sizes == size)[0]
            known = self.known.get(size)
            if known is None or len(known.pivots) == 1:
                near, k = np.zeros((len(at), 1), dtype=np.int16), 1
            else:
                near, k = known.permutations(unit_rows(np.stack([np.frombuffer(v[i], dtype=self.kind) for i in at])), self.params.prefix), known.lists
            yield at, size * 65_536 + near[:, :k].astype(np.int64), near

    def block_rows(self, size: int, count: int) -> int:
        """Vectors of a block: more in larger tables, so that lists are in few blocks, but bounded in bytes."""
        p = self.params
        return max(min(max(p.least_block, count // 64), p.block_bytes // size), min(64, p.least_block))


def pair_links(distinct: DataFrame, count: int, single: bool, params: PivotParams) -> DataFrame:
    """Per distinct vector (id, weight, key, v) and pair of blocks of a list: rows (a, b, n).

    b is null and n a number of linked rows to add to a; or b is set and (a, b) is a link of
    the block's spanning forest.
    """
    spark = distinct.sparkSession
    index = PivotIndex(distinct, count, single, params)
    shared_index = spark.sparkContext.broadcast(index)  # widths x max_pivots vectors at most

    def lists_of(batches):
        import pyarrow as pa

        for batch in batches:
            for _, lists, _ in shared_index.value.described(batch.column("v").to_pylist()):
                values, n = np.unique(lists, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n.astype(np.int64))], ["list", "n"])

    sizes = distinct.select("v").mapInArrow(lists_of, "list long, n long").groupBy("list").agg(F.sum("n").alias("n"))
    # only lists of several blocks: fewer than vectors x lists / block, and than widths x max_pivots but for rare lengths
    long_lists = {r["list"]: r.n for r in sizes.where(F.col("n") > params.least_block).collect()}
    blocks = {x: -(-n // index.block_rows(x // 65_536, count)) for x, n in long_lists.items()}
    shared_blocks = spark.sparkContext.broadcast({x: b for x, b in blocks.items() if b > 1})

    def deal(batches):
        import pyarrow as pa

        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                ids = np.asarray(batch.column("id"))
                for at, lists, near in shared_index.value.described(batch.column("v").to_pylist()):
                    row = np.repeat(at, lists.shape[1])
                    the_list = lists.ravel()
                    parts = np.array([shared_blocks.value.get(x, 1) for x in the_list.tolist()], dtype=np.int64)
                    mixed = ids[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    block = ((mixed >> np.uint64(33)) % parts.astype(np.uint64)).astype(np.int64)
                    each = np.repeat(np.arange(len(row)), parts)
                    other = np.arange(len(each)) - np.repeat(np.cumsum(parts) - parts, parts)
                    prefixes = pa.array([x.tobytes() for x in near], pa.binary())
                    place = np.empty(len(batch), dtype=np.int64)
                    place[at] = np.arange(len(at))
                    for a in range(0, len(each), 4_096):
                        e, o = each[a : a + 4_096], other[a : a + 4_096]
                        r = pa.array(row[e])
                        columns = {
                            "list": pa.array(the_list[e]), "i": pa.array(np.minimum(block[e], o).astype(np.int32)),
                            "j": pa.array(np.maximum(block[e], o).astype(np.int32)), "block": pa.array(block[e].astype(np.int32)),
                            "id": batch.column("id").take(r), "weight": batch.column("weight").take(r),
                            "near": prefixes.take(pa.array(place[row[e]])), "v": batch.column("v").take(r),
                        }
                        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    dealt = distinct.select("id", "weight", "v").mapInArrow(deal, "list long, i int, j int, block int, id long, weight long, near binary, v binary")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count * 6 // 100_000))
    dealt = dealt.repartition(parts, "list", "i", "j").sortWithinPartitions("list", "i", "j", "block")

    kind, posted = index.kind, {size: (k.lists, k.shared) for size, k in index.known.items()}

    def compare(batches):
        import pyarrow as pa

        links: dict[int, int] = {}
        forest = LocalForest()

        def out():
            edges = forest.edges()
            a, b = [*links, *(e[0] for e in edges)], [*[None] * len(links), *(e[1] for e in edges)]
            n = [*links.values(), *[0] * len(edges)]
            links.clear()
            forest.parent.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (a, b, n)], ["a", "b", "n"])

        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            the_list, i, j = (np.asarray(batch.column(c)) for c in ("list", "i", "j"))
            rest = [np.asarray(batch.column(c)) for c in ("block", "id", "weight")]
            near, v = batch.column("near").to_pylist(), batch.column("v").to_pylist()
            cuts = np.nonzero((np.diff(the_list) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0))[0] + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                now = (int(the_list[s]), int(i[s]), int(j[s]))
                if now != key:
                    if held:
                        compare_blocks(key, held, kind, posted, params, links, forest)
                    key, held = now, []
                held.append((*(c[s:e].copy() for c in rest), near[s:e], v[s:e]))
            if len(links) + len(forest.parent) > 500_000:
                yield out()
        if held:
            compare_blocks(key, held, kind, posted, params, links, forest)
        yield out()

    return dealt.mapInArrow(compare, "a long, b long, n long")


def bitmaps(codes: np.ndarray, keep: np.ndarray, words: int) -> np.ndarray:
    """Sets of small numbers, one a row, as bits; ``keep`` says which entries count."""
    out = np.zeros((len(codes), words), dtype=np.uint64)
    row = np.arange(len(codes))
    for c in range(codes.shape[1]):
        bit = np.where(keep[:, c], np.uint64(1) << (codes[:, c] % 64).astype(np.uint64), np.uint64(0))
        out[row, codes[:, c] // 64] |= bit
    return out


def compare_blocks(
    key, held, kind, posted: dict[int, tuple[int, int]], params: PivotParams, links: dict[int, int], forest: LocalForest, sub: int = 1_024
) -> None:
    """Link the vectors of a pair of blocks: candidates by shared pivots, then cosines; sub-blocks bound the memory."""
    the_list, i, j = key
    block, ids, weight = (np.concatenate([h[c] for h in held]) for c in range(3))
    near = np.stack([np.frombuffer(b, dtype=np.int16) for h in held for b in h[3]])
    v = np.stack([np.frombuffer(b, dtype=kind) for h in held for b in h[4]])
    sides = [np.nonzero(block == i)[0], np.nonzero(block == j)[0]]
    if len(ids) < 2 or not (len(sides[0]) and len(sides[1])):
        return
    pivot, (k, shared) = the_list % 65_536, posted.get(the_list // 65_536, (1, 1))
    names, codes = np.unique(near, return_inverse=True)
    codes, words = codes.reshape(near.shape), -(-len(names) // 64)
    every = bitmaps(codes, np.ones(near.shape, dtype=bool), words)
    before = bitmaps(codes, (np.arange(near.shape[1])[None, :] < k) & (near < pivot), words)  # lists in which a pair has met already
    needed = min(shared, near.shape[1])
    found = np.zeros(len(ids), dtype=np.int64)
    for a0 in range(0, len(sides[0]), sub):
        a = sides[0][a0 : a0 + sub]
        x = unit_rows(v[a])
        for b0 in range(a0 if i == j else 0, len(sides[1]), sub):
            b = sides[1][b0 : b0 + sub]
            common = np.zeros((len(a), len(b)), dtype=np.uint8)
            met = np.zeros((len(a), len(b)), dtype=bool)
            for w in range(words):
                common += np.bitwise_count(every[a, w][:, None] & every[b, w][None, :])
                met |= (before[a, w][:, None] & before[b, w][None, :]) != 0
            wanted = (common >= needed) & ~met
            if i == j and a0 == b0:
                wanted = np.triu(wanted, 1)
            if not wanted.any():
                continue
            close = wanted & (x @ unit_rows(v[b]).T >= params.threshold)
            rows, columns = np.nonzero(close)
            if not len(rows):
                continue
            found[a] += (close @ weight[b].astype(np.float64)).astype(np.int64)
            found[b] += (weight[a].astype(np.float64) @ close).astype(np.int64)
            nodes = np.unique(np.concatenate([a[rows], b[columns]]))
            root = np.zeros(len(ids), dtype=np.int64)
            root[nodes] = [forest.find(int(n)) for n in ids[nodes]]
            ra, rb = root[a[rows]], root[b[columns]]
            pairs = np.unique(np.stack([np.minimum(ra, rb), np.maximum(ra, rb)], axis=1)[ra != rb], axis=0)
            for p, q in pairs.tolist():
                forest.union(p, q)
    for r in np.nonzero(found)[0].tolist():
        links[int(ids[r])] = links.get(int(ids[r]), 0) + int(found[r])


def linked_vectors(vectors: DataFrame, params: PivotParams = PivotParams()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors`` (vec_id, embedding)."""
    rows = keyed_vectors(vectors)
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    # one row per distinct vector, numbered; writing them fixes the numbers
    distinct = written(
        rows.where("key IS NOT NULL")
        .groupBy("key")
        .agg(F.min("vec_id").alias("first_id"), F.count("*").alias("weight"), F.first("v").alias("v"))
        .withColumn("id", F.monotonically_increasing_id()),
        "vectors",
    )
    found = written(pair_links(distinct, distinct.count(), single, params), "links")
    others = found.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    member = components(found.where("b IS NOT NULL").select("a", "b"))
    slim = distinct.drop("v")
    classes = (
        slim.join(others, "id", "left")
        .join(member, slim["id"] == member["node"], "left")
        .select(
            "key",
            "first_id",
            (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).cast("long").alias("n_links"),
            F.coalesce("component", "id").alias("cls"),
        )
    )
    named = classes.groupBy("cls").agg(F.min("first_id").alias("component_id"))
    classes = classes.join(named, "cls").select("key", "n_links", "component_id")
    keyed = written(rows.select("vec_id", "key"), "keys")
    joined = joined_hot(keyed.where("key IS NOT NULL"), classes, ["key"], "inner").select("vec_id", "n_links", "component_id")
    alone = keyed.where("key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
