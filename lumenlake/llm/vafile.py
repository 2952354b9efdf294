"""Vector codes by product quantisation, with nearest entries found through a vector-approximation file.

A vector's components become integers and are cut into parts; each part position has a codebook whose
entries are improved in a fixed number of rounds (assign every part to its nearest entry, then replace
each entry by the floor of its parts' mean).  All arithmetic is in integers, so a result depends on
no order of rows, partitions or retries.

Nearest entries by a VA-file: each entry's coordinates are quantised to ``cell_bits`` bits, equal
cells between the least and the greatest of the codebook's in that coordinate.  For a part to be coded, a
lookup table per coordinate and cell has the least and greatest squared distance to the cell; an entry's
bounds are sums of looked-up numbers.  Entries whose lower bound is above the least upper bound are
out; the rest are compared by their integer distances.  A nearest entry is never out, since its
distance is within its bounds, so the codes are exact, ties included.

A round is one scan of the vectors: each task sends sums and counts by part and entry, which a
grouped aggregation adds up.  The driver holds codebooks only: entries x length numbers.

Edge cases: vectors that are null, or hold a null or non-finite component, are dropped; with fewer than
``entries`` vectors a codebook is that much smaller; starting vectors are the smallest ids, null ids last,
equal ids by their components; vectors of another length have codebooks of their own, which are
fitted together while they have ``book_numbers`` numbers or fewer, else in several groups of lengths; where
the number of parts doesn't divide a length, the first parts are one longer; empty vectors have code
zero throughout; components of any finite size are exact (beyond 64 bits with Python's integers); an error
that no long holds is null; null labels are one label; repeated rows are rows; an empty table gives an
empty result; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumenlake.llm.common import joined_hot, written

LIMB = 32  # bits of a piece of a sum


@dataclass(frozen=True)
class CodeParams:
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4_096
    cell_bits: int = 3
    book_numbers: int = 4_000_000  # numbers of the codebooks of lengths that are fitted together
    chunk: int = 4_096  # vectors that are compared at a time


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, x): x as doubles, all of them finite."""
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", "label", x.alias("x")).where("x IS NOT NULL")
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    return rows.where(~F.exists("x", bad))


def part_bounds(length: int, parts: int) -> list[tuple[int, int]]:
    """First and last coordinate of each part."""
    sizes = [length // parts + (i < length % parts) for i in range(parts)]
    ends = np.cumsum(sizes).tolist()
    return [(e - s, e) for s, e in zip(sizes, ends)]


def integers(x: np.ndarray, scale: int, exact: bool) -> np.ndarray:
    """floor(scale * x): in 64 bits, or as Python integers where those could not hold squares of distances."""
    if not exact:
        return np.floor(x * scale).astype(np.int64)
    ratios = [float(v).as_integer_ratio() for v in x.ravel()]
    return np.array([(a * scale) // b for a, b in ratios] or [0], dtype=object)[: x.size].reshape(x.shape)


class VAFile:
    """The entries of one codebook, their cells and the cells' edges."""

    def __init__(self, entries: np.ndarray, cell_bits: int):
        self.entries, self.width = entries, entries.shape[1]
        cells = 1 << cell_bits
        least = entries.min(axis=0)
        step = (entries.max(axis=0) - least) // cells + 1
        self.cells = ((entries - least) // step).astype(np.int64)  # entry x coordinate
        self.low = least[:, None] + np.arange(cells)[None, :] * step[:, None]  # coordinate x cell
        self.high = self.low + step[:, None] - 1

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row; of equal distances the first entry."""
        n = len(q)
        if not self.width:
            return np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        lower = np.zeros((len(self.entries), n), dtype=q.dtype)
        upper = np.zeros_like(lower)
        for c in range(self.width):
            below = self.low[c][:, None] - q[:, c][None, :]  # cell x row
            above = q[:, c][None, :] - self.high[c][:, None]
            inside = np.maximum(np.maximum(below, above), 0)
            across = np.maximum(-below, -above)
            lower += (inside * inside)[self.cells[:, c]]
            upper += (across * across)[self.cells[:, c]]
        entry, row = np.nonzero(lower <= upper.min(axis=0)[None, :])
        apart = q[row] - self.entries[entry]
        exact = (apart * apart).sum(axis=1)
        order = np.lexsort((entry, exact, row)) if q.dtype != object else np.array(sorted(range(len(row)), key=lambda i: (row[i], exact[i], entry[i])))
        first = np.searchsorted(row[order], np.arange(n))
        best = order[first]
        return entry[best], exact[best]


def coded(x: np.ndarray, books: list[np.ndarray], params: CodeParams, exact: bool):
    """(integers, entries, distances) of vectors of one length; entries and distances by row and part."""
    q = integers(x, params.scale, exact)
    chosen = np.empty((len(q), params.parts), dtype=np.int64)
    apart = np.empty((len(q), params.parts), dtype=q.dtype)
    for p, (a, b) in enumerate(part_bounds(q.shape[1], params.parts)):
        chosen[:, p], apart[:, p] = VAFile(books[p], params.cell_bits).nearest(q[:, a:b])
    return q, chosen, apart


def by_length(batch, column: str, chunk: int):
    """(rows, matrix) of a batch's vectors, by length, at most ``chunk`` at a time."""
    lists = batch.column(column)
    offsets = np.asarray(lists.offsets)
    values = lists.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for size in np.unique(sizes).tolist():
        at = np.nonzero(sizes == size)[0]
        for start in range(0, len(at), chunk):
            rows = at[start : start + chunk]
            yield rows, values[offsets[rows][:, None] + np.arange(size)[None, :]].reshape(len(rows), size)


@dataclass
class Length:
    """What is known of the vectors of a length."""

    rows: int
    top: float  # greatest absolute component
    books: list[np.ndarray]

    def exact(self, length: int, params: CodeParams) -> bool:
        """Whether 64 bits are too few for a squared distance or a sum of distances."""
        largest = 2.0 * self.top * params.scale + 2
        return largest * largest * max(length, 1) >= 2.0**62

    def limbs(self, params: CodeParams) -> int:
        """Pieces of LIMB bits that hold a sum of components; a single long where one is enough."""
        bits = int(self.top * params.scale + 1).bit_length() + self.rows.bit_length() + 1 if np.isfinite(self.top * params.scale) else 1_200
        return 1 if bits <= 62 else -(-bits // LIMB)


def starting_books(rows: DataFrame, lengths: list[int], params: CodeParams) -> dict[int, Length]:
    """The first codebooks of each length: the parts of the smallest ids' vectors."""
    size = F.size("x")
    found = rows.where(size.isin(lengths)).groupBy(size.alias("length")).agg(
        F.count("*").alias("n"), F.max(F.array_max(F.transform("x", F.abs))).alias("top")
    ).collect()  # a row per length
    out = {}
    for r in found:
        top = r.top or 0.0
        known = Length(r.n, top, [])
        first = rows.where(size == r.length).orderBy(F.asc_nulls_last("vec_id"), "x").limit(params.entries).select("x").collect()
        q = integers(np.array([list(f.x) for f in first], dtype=np.float64).reshape(len(first), r.length), params.scale, known.exact(r.length, params))
        known.books = [q[:, a:b] for a, b in part_bounds(r.length, params.parts)]
        out[r.length] = known
    return out


def improved(rows: DataFrame, known: dict[int, Length], params: CodeParams) -> dict[int, Length]:
    """One round: each entry becomes the floor of the mean of the parts that are nearest to it."""
    shared = rows.sparkSession.sparkContext.broadcast(known)  # entries x length numbers of each length
    limbs = {n: k.limbs(params) for n, k in known.items()}

    def run(batches):
        import pyarrow as pa

        counts: dict[tuple[int, int], np.ndarray] = {}
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for _, x in by_length(batch, "x", params.chunk):
                length = x.shape[1]
                k = shared.value[length]
                q, chosen, _ = coded(x, k.books, params, k.exact(length, params))
                for p, (a, b) in enumerate(part_bounds(length, params.parts)):
                    n = len(k.books[p])
                    if (length, p) not in counts:
                        counts[length, p] = np.zeros(n, dtype=np.int64)
                        sums[length, p] = np.zeros((n, b - a), dtype=object if limbs[length] > 1 else np.int64)
                    counts[length, p] += np.bincount(chosen[:, p], minlength=n)
                    np.add.at(sums[length, p], chosen[:, p], q[:, a:b])
        found = [(length, p, e, c, sums[length, p][e]) for (length, p), of in counts.items() for e, c in enumerate(of.tolist()) if c]
        flat = [[piece for v in s.tolist() for piece in in_limbs(int(v), limbs[length])] for length, _, _, _, s in found]
        columns = [[f[i] for f in found] for i in range(4)]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int64()) for c in columns), pa.array(flat, pa.list_(pa.int64()))], ["length", "part", "entry", "n", "sums"]
        )

    partial = rows.where(F.size("x").isin(list(known))).select("x").mapInArrow(run, "length long, part long, entry long, n long, sums array<long>")
    widest = max((n // params.parts + 1) * limbs[n] for n in known)
    added = partial.groupBy("length", "part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(widest)]).alias("sums"))
    new = {n: Length(k.rows, k.top, [b.copy() for b in k.books]) for n, k in known.items()}
    for r in added.collect():  # lengths x parts x entries rows
        book = new[r.length].books[r.part]
        for i in range(book.shape[1]):
            m = limbs[r.length]
            total = sum(v << (LIMB * j) for j, v in enumerate(r.sums[i * m : (i + 1) * m]))
            book[r.entry, i] = total // r.n
    return new


def in_limbs(value: int, count: int) -> list[int]:
    """Pieces of a number that add up by piece: all but the last below 2^LIMB, the last with the sign."""
    out = []
    for _ in range(count - 1):
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position, as decimals with commas."""
    return hashlib.sha256(",".join(str(int(v)) for book in books for v in book.ravel()).encode()).hexdigest()


def compressed(vectors: DataFrame, params: CodeParams = CodeParams()) -> tuple[DataFrame, dict[int, list[np.ndarray]]]:
    """((vec_id, label, code, error, codebooks_sha256), codebooks by length) of ``vectors`` (vec_id, embedding, label).

    ``code`` has two hex digits a part; ``error`` is the squared distance between a vector and its entries.
    """
    rows = usable(vectors)
    lengths = sorted(r.n for r in rows.select(F.size("x").alias("n")).distinct().collect())  # distinct lengths
    out, books = [], {}
    while lengths:
        group = [lengths.pop(0)]
        while lengths and params.entries * (sum(group) + lengths[0]) <= params.book_numbers:
            group.append(lengths.pop(0))
        known = starting_books(rows, group, params)
        for _ in range(params.rounds):
            known = improved(rows, known, params)
        out.append(_codes(rows, known, params))
        books |= {n: k.books for n, k in known.items()}
    if not out:
        out = [_codes(rows, {}, params)]
    return reduce(DataFrame.unionByName, out), books


def _codes(rows: DataFrame, known: dict[int, Length], params: CodeParams) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast({n: (k, k.exact(n, params), books_digest(k.books)) for n, k in known.items()})
    ids = [rows.schema["vec_id"], rows.schema["label"]]
    schema = T.StructType([*ids, *T.StructType.fromDDL("code string, error bigint, codebooks_sha256 string")])
    arrow = to_arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at, x in by_length(batch, "x", params.chunk):
                k, exact, digest = shared.value[x.shape[1]]
                _, chosen, apart = coded(x, k.books, params, exact)
                errors = apart.sum(axis=1).tolist()
                columns = [
                    *(batch.column(i).take(pa.array(at)) for i in range(2)),
                    pa.array([bytes(c).hex() for c in chosen.astype(np.uint8).tolist()]),
                    pa.array([e if e < 1 << 63 else None for e in errors], pa.int64()),
                    pa.array([digest] * len(at)),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return rows.where(F.size("x").isin(list(known) or [-1])).select("vec_id", "label", "x").mapInArrow(run, schema)


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with the sum of the errors of equal labels; null labels together."""
    rows = written(codes.withColumns({"_named": F.col("label").isNotNull(), "_label": F.coalesce(F.col("label").cast("string"), F.lit(""))}), "codes")
    sums = rows.groupBy("_named", "_label").agg(F.try_sum("error").alias("label_error"))
    return joined_hot(rows, sums, ["_named", "_label"], "left").drop("_named", "_label")
