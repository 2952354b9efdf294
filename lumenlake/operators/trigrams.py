"""Substring search by an inverted index of trigrams over a Parquet table.

The table stays where it is: a row's address is its file and its number in it.  Postings hold, for each
trigram of lower-cased text and each chunk of rows of a file, which rows of the chunk have it, two bytes a row.
They are sorted by trigram over files of their own, whose bounds are kept, so a search reads the
posting files that can hold its trigrams, and of those the pages.

A search takes the rarest trigrams of each term, intersects their rows chunk by chunk, and reads the table's
files that still have candidates.  The predicate itself is evaluated on the candidates, so the result is that
of a scan of the whole table; a term that isn't in any row ends the search with the counts alone.  Terms under
three characters have no trigram: without a longer one, and for terms that most rows have, the table is scanned.
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.plans.scratch import materialised

FEW_ROWS = 1_000_000  # candidates that are broadcast, of 16 bytes and a path


def grams(text: str) -> np.ndarray:
    """The distinct trigrams of a text as numbers: three code points of 21 bits."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    return np.unique((c[:-2] << 42) | (c[1:-1] << 21) | c[2:]) if len(c) > 2 else np.zeros(0, dtype=np.int64)


def addressed(table: DataFrame) -> DataFrame:
    """A scan of Parquet files with each row's address: columns _file and _row."""
    return table.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def _postings(chunk_rows: int, chunk_grams: int):
    """(file, base, gram, n, rows) from (file, row, texts) in the order of a file's rows."""

    def run(batches):
        import pyarrow as pa

        names = ["file", "base", "gram", "n", "rows"]
        held: list[tuple[int, np.ndarray]] = []  # place in the chunk, trigrams
        now, size = None, 0

        def made():
            places = np.concatenate([np.full(len(g), p, dtype=np.uint16) for p, g in held] or [np.zeros(0, dtype=np.uint16)])
            values = np.concatenate([g for _, g in held] or [np.zeros(0, dtype=np.int64)])
            order = np.argsort(values, kind="stable")
            values, places = values[order], places[order]
            starts = np.nonzero(np.concatenate([[True], values[1:] != values[:-1]]))[0] if len(values) else np.zeros(0, dtype=np.int64)
            ends = np.append(starts[1:], len(values))
            raw = places.tobytes()
            rows = [raw[2 * a : 2 * b] for a, b in zip(starts.tolist(), ends.tolist())]
            n = len(starts)
            columns = [pa.array([now[0]] * n, pa.string()), pa.array(np.full(n, now[1], dtype=np.int64)), pa.array(values[starts]), pa.array((ends - starts).astype(np.int64)), pa.array(rows, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            files, rows, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for file, row, several in zip(files, rows, texts):
                key = (file, row // chunk_rows * chunk_rows)
                if now is not None and (key != now or size > chunk_grams):
                    yield made()
                    held, size = [], 0
                now = key
                own = [grams(t) for t in several.as_py() or () if t]
                if own:
                    every = own[0] if len(own) == 1 else np.unique(np.concatenate(own))
                    held.append((row - key[1], every))
                    size += len(every)
        if held:
            yield made()

    return run


@dataclass
class TextIndex:
    """Postings below a path of the texts of a Parquet table."""

    spark: SparkSession
    path: str
    chunk_rows: int = 4_096  # of a posting; 65,536 at most
    chunk_grams: int = 8_000_000  # trigrams that are held before their postings are made

    def _at(self, name: str) -> str:
        return posixpath.join(self.path, name)

    def build(self, table: DataFrame, texts: Callable[[], Column], partitions: int | None = None) -> None:
        """Index ``texts()`` (an array of strings, of which nulls don't count) of a scan of Parquet files."""
        lowered = F.transform(texts(), lambda t: F.lower(t)).alias("texts")
        rows = addressed(table).select(F.col("_file").alias("file"), F.col("_row").alias("row"), lowered)
        found = rows.mapInArrow(_postings(self.chunk_rows, self.chunk_grams), "file string, base long, gram long, n long, rows binary")
        parts = partitions or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = found.repartitionByRange(parts, "gram", "file", "base").sortWithinPartitions("gram", "file", "base")
        dealt.write.parquet(self._at("postings"))
        stored = self.spark.read.parquet(self._at("postings"))
        stored.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.min("gram").alias("low"), F.max("gram").alias("high")).write.parquet(self._at("bounds"))
        counts = stored.groupBy("gram").agg(F.sum("n").alias("n"))
        counts.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(self._at("counts"))
        table.agg(F.count("*").alias("rows")).write.parquet(self._at("rows"))

    def chosen(self, terms: list[str], most: int = 3, common: float = 0.5) -> list[int] | None:
        """The rarest trigrams of each term; None if a scan is better, [] if some term is in no row."""
        by_term = [g for g in (grams(t).tolist() for t in terms) if g]
        if not by_term:
            return None
        asked = sorted({g for of in by_term for g in of})
        counts = {r.gram: r.n for r in self.spark.read.parquet(self._at("counts")).where(F.col("gram").isin(asked)).collect()}  # as many as a query has
        if any(g not in counts for g in asked):
            return []
        rows = self.spark.read.parquet(self._at("rows")).first().rows
        best = sorted({g for of in by_term for g in sorted(of, key=lambda g: (counts[g], g))[:most]})
        return None if min(counts[g] for g in best) > common * rows else best

    def posting_files(self, wanted: list[int]) -> list[str]:
        """The posting files that can hold one of the trigrams."""
        bounds = self.spark.read.parquet(self._at("bounds"))
        holds = F.exists(F.array(*[F.lit(g) for g in wanted]), lambda g: (g >= F.col("low")) & (g <= F.col("high")))
        return sorted(unquote(r.path) for r in bounds.where(holds).collect())  # a row per posting file

    def candidates(self, wanted: list[int]) -> DataFrame:
        """(file, row) of rows that have all trigrams."""
        postings = self.spark.read.parquet(*self.posting_files(wanted)).where(F.col("gram").isin(wanted))
        needed, chunk_rows = len(wanted), self.chunk_rows

        def meet(table):
            import pyarrow as pa

            # a chunk may have several postings of a trigram, of different rows
            of: dict[int, list[bytes]] = {}
            for gram, rows in zip(table.column("gram").to_pylist(), table.column("rows").to_pylist()):
                of.setdefault(gram, []).append(rows)
            places = np.zeros(chunk_rows, dtype=np.int64)
            for several in of.values():
                places[np.frombuffer(b"".join(several), dtype=np.uint16)] += 1
            found = np.nonzero(places == needed)[0] + table.column("base")[0].as_py()
            return pa.table({"file": pa.array([table.column("file")[0].as_py()] * len(found), pa.string()), "row": pa.array(found, pa.int64())})

        whole = postings.join(postings.groupBy("file", "base").agg(F.count_distinct("gram").alias("k")).where(F.col("k") == needed).drop("k"), ["file", "base"], "left_semi")
        return whole.groupBy("file", "base").applyInArrow(meet, "file string, row long")

    def search(self, table: DataFrame, terms: list[str], matches: Column) -> DataFrame:
        """The rows of ``table`` (a scan of the indexed files) for which ``matches`` holds, which implies all terms in one of the texts."""
        wanted = self.chosen(terms)
        if wanted is None:
            return table.where(matches)
        if not wanted:
            return table.limit(0)
        found = materialised(self.candidates(wanted), "candidates")
        files = [r.file for r in found.select("file").distinct().collect()]  # files of the table
        if not files:
            return table.limit(0)
        some = addressed(self.spark.read.schema(table.schema).parquet(*map(unquote, files)))
        near = F.broadcast(found) if found.count() <= FEW_ROWS else found
        kept = some.join(near, (some["_file"] == near["file"]) & (some["_row"] == near["row"]), "left_semi").drop("_file", "_row")
        return kept.where(matches)
