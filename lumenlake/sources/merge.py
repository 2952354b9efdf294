"""Merge-on-read tables: a change writes only what it changes, readers put it together.

A table is cut into buckets by a hash of its key.  A bucket has a base and deltas: rows that were set
(``u``), keys that were deleted (``d``) or named columns that were set (``s``).  A change is one folder of
deltas in the buckets it touches; its number in the log is its place in the order of changes.  Per key,
the last ``u`` or ``d`` counts, and each column takes the last ``s`` after it; a grouped aggregation over the
deltas alone finds them, so a key that changes very often is no group in memory.

Reading: buckets without deltas are scanned as they are, with filters and column pruning; the others join
their base to the deltas' keys and set columns, which are broadcast while the log says that they are small and
shuffled beyond it; rows that were set whole come from the deltas.  `compact` rewrites the buckets whose deltas have grown and leaves the rest.

The log is numbered manifests, of which the highest counts.  A manifest comes into being by a rename that
fails if its number is taken.  A job that dies before leaves a folder that nothing names.  Changes that
don't depend on what is there (upsert, delete, set fields, compaction) take the next number if theirs is
gone; `insert_missing` gets an error.  (Stores without such a rename need a committer of their own.)

Null is a key like any other.  Of rows with equal keys in one change the greatest by ``latest_by`` is taken;
without it, and among equals, the one whose JSON text is greatest, so that a repeated task takes the same.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlake.functions.text import normalise_tags
from lumenlake.plans.scratch import discard
from lumenlake.sources.tables import ConcurrentChange

BROADCAST_BYTES = 32 << 20  # of what a reader has to know of deltas, estimated
RETRIES = 20


class NumberedLog:
    """Files 1, 2, 3 ... in a folder, each made once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _hadoop(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(posixpath.join(self.path, *parts))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        folder, fs = self._hadoop()
        if not fs.exists(folder):
            return []
        return sorted(int(n) for s in fs.listStatus(folder) if (n := s.getPath().getName()).isdigit())

    def read(self, number: int) -> str:
        path, fs = self._hadoop(f"{number:012d}")
        stream = fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def commit(self, number: int, text: str) -> bool:
        """Whether the file was made; not if its number is taken."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        folder, fs = self._hadoop()
        fs.mkdirs(folder)
        fresh, _ = self._hadoop(f".{uuid.uuid4().hex}")
        out = fs.create(fresh, True)
        out.write(bytearray(text.encode()))
        out.close()
        final, _ = self._hadoop(f"{number:012d}")
        options = self.spark._sc._gateway.new_array(hadoop.Options.Rename, 1)
        options[0] = hadoop.Options.Rename.NONE
        try:
            hadoop.FileContext.getFileContext(folder.toUri(), self.spark._jsc.hadoopConfiguration()).rename(fresh, final, options)
        except Exception as e:
            fs.delete(fresh, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def remove(self, number: int) -> None:
        path, fs = self._hadoop(f"{number:012d}")
        fs.delete(path, False)


class MergeTable:
    """A table by a key; ``buckets`` is fixed when it is made: a bucket should be a file or a few."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: T.StructType | str, buckets: int = 16):
        self.spark, self.path, self.key = spark, path, key
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.log = NumberedLog(spark, posixpath.join(path, "_log"))
        self._first = {"buckets": buckets, "key": key, "schema": self.schema.jsonValue(), "base": {}, "deltas": []}

    # -------------------------------------------------------------- the log

    def version(self) -> int:
        """The number of the present version; 0 before the first change."""
        return max(self.log.numbers(), default=0)

    def manifest(self, number: int | None = None) -> dict:
        """What a version is made of: per bucket its base, and the deltas by sequence."""
        number = self.version() if number is None else number
        return json.loads(self.log.read(number)) if number else self._first

    def _commit(self, change: Callable[[dict, int], dict], base: int | None = None) -> int:
        """Add a manifest: ``change`` of the present one, or, if ``base`` is given, of that one or none."""
        for _ in range(RETRIES):
            number = self.version() if base is None else base
            if self.log.commit(number + 1, json.dumps(change(self.manifest(number), number + 1))):
                return number + 1
            if base is not None:
                break
        raise ConcurrentChange(f"version {number + 1} of {self.path} is there already")

    # -------------------------------------------------------------- writing

    def _bucket(self, count: int):
        return F.pmod(F.xxhash64(F.col(f"`{self.key}`")), F.lit(count)).cast("int")

    def _written(self, rows: DataFrame, kind: str, dealt: bool = True) -> tuple[str, dict[str, int]]:
        """(folder, bytes by bucket) of rows, one folder a bucket; large buckets are several files.

        ``dealt``: rows of a bucket are brought together first; not where they come from files by bucket.
        """
        name = f"{kind}-{uuid.uuid4().hex}"
        marked = rows.withColumn("_bucket", self._bucket(self.manifest()["buckets"]))
        marked = marked.hint("rebalance", "_bucket") if dealt else marked
        marked.write.partitionBy("_bucket").parquet(posixpath.join(self.path, name))
        folder, fs = self.log._hadoop("..", name)
        found = [s.getPath() for s in fs.listStatus(folder) if s.isDirectory() and "=" in s.getPath().getName()]
        return name, {p.getName().split("=")[1]: fs.getContentSummary(p).getLength() for p in found}

    def _whole(self, rows: DataFrame) -> DataFrame:
        """Rows with all columns of the table in its types; missing ones are null."""
        have = set(rows.columns)
        return rows.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema])

    def _one_each(self, rows: DataFrame, latest_by: str | None) -> DataFrame:
        """A row for each key."""
        columns = [F.col(f"`{c}`") for c in rows.columns if c != latest_by or c in self.schema.names]
        row = F.struct(*columns)
        order = F.struct(*([F.col(f"`{latest_by}`")] if latest_by else []), F.to_json(row, {"ignoreNullFields": "false"}))
        best = rows.groupBy(F.col(f"`{self.key}`").alias("_key")).agg(F.max_by(row, order).alias("_row"))
        return best.select("_row.*")

    def _put(self, rows: DataFrame, shape: Callable[[DataFrame], DataFrame], kind: str, latest_by: str | None) -> tuple[str, dict[str, int], dict[str, int]]:
        """(folder, bytes by bucket, bytes of keys by bucket) of ``shape`` of the rows, one for each key.

        Whether a key repeats is told by the keys that were written, so the rows are computed once; if one does, they are written anew.
        """
        name, sizes = self._written(shape(rows), kind)
        keys, repeats = self._keys(name, sizes)
        if repeats:
            discard(self.spark, posixpath.join(self.path, name))
            name, sizes = self._written(shape(self._one_each(rows, latest_by)), kind)
            keys, _ = self._keys(name, sizes)
        return name, sizes, keys

    def _keys(self, name: str, sizes: dict[str, int]) -> tuple[dict[str, int], bool]:
        """Bytes by bucket that the keys of a written folder take in a reader, and whether one of them repeats."""
        if not sizes:
            return {}, False
        key = F.col(f"`{self.key}`")
        schema = T.StructType([self.schema[self.key], T.StructField("_bucket", T.IntegerType())])
        rows = self.spark.read.schema(schema).parquet(posixpath.join(self.path, name))
        each = rows.groupBy("_bucket", key).agg(F.count("*").alias("n"))
        size = F.coalesce(F.octet_length(key.cast("string")), F.lit(0)) + 64
        found = each.groupBy("_bucket").agg(F.sum(size * F.col("n")).alias("bytes"), F.max("n").alias("most")).collect()  # a row a bucket
        return {str(r["_bucket"]): int(r["bytes"]) for r in found}, any(r.most > 1 for r in found)

    def _delta(self, put: tuple[str, dict[str, int], dict[str, int]], op: str, columns: list[str], base: int | None = None) -> int:
        name, sizes, keys = put
        if not sizes:
            return self.version()
        # what a reader has to hold: the keys and the columns that are set
        weights = {b: n + (4 * sizes[b] if columns else 0) for b, n in keys.items()}

        def change(manifest: dict, number: int) -> dict:
            delta = {"seq": number, "folder": name, "op": op, "columns": columns, "bytes": sizes, "weight": weights}
            return {**manifest, "deltas": [*manifest["deltas"], delta]}

        return self._commit(change, base)

    def upsert(self, rows: DataFrame, latest_by: str | None = None, expect: int | None = None) -> int:
        """Rows replace those of equal key.  With ``expect`` only if that is the present version, as in the others."""
        if not self.version():
            return self._first_rows(rows, latest_by, expect)
        return self._delta(self._put(rows, self._whole, "delta", latest_by), "u", [], expect)

    def _first_rows(self, rows: DataFrame, latest_by: str | None, expect: int | None) -> int:
        """The rows of an empty table are its base at once, unless another change comes first."""
        put = name, sizes, _ = self._put(rows, self._whole, "base", latest_by)
        base = {b: {"folder": name, "upto": 1, "bytes": n} for b, n in sizes.items()}
        if not sizes or self.log.commit(1, json.dumps({**self._first, "base": base})):
            return self.version()
        if expect is not None:
            raise ConcurrentChange(f"version 1 of {self.path} is there already")
        return self._delta(put, "u", [])

    def insert_missing(self, rows: DataFrame, latest_by: str | None = None) -> int:
        """Rows whose key is not there yet are added; an error if the table changes meanwhile."""
        base = self.version()
        if not base:
            return self._first_rows(rows, latest_by, base)
        there = self.read_version(base).select(F.col(f"`{self.key}`").alias("_there"))
        new = lambda r: self._whole(r).join(there, F.col(f"`{self.key}`").eqNullSafe(F.col("_there")), "left_anti")
        return self._delta(self._put(rows, new, "delta", latest_by), "u", [], base)

    def delete(self, ids: DataFrame, expect: int | None = None) -> int:
        """Rows of these keys go; keys that aren't there do nothing."""
        keys = lambda r: r.select(F.col(f"`{self.key}`").cast(self.schema[self.key].dataType)).distinct()
        return self._delta(self._put(ids, keys, "delta", None), "d", [], expect)

    def set_fields(self, changes: DataFrame, latest_by: str | None = None, expect: int | None = None) -> int:
        """Named columns of ``changes`` (key and others) replace the stored ones; keys that aren't there do nothing."""
        columns = [c for c in changes.columns if c != self.key and c in self.schema.names]
        unknown = set(changes.columns) - {self.key, latest_by, *columns}
        if unknown:
            raise ValueError(f"no such columns: {sorted(unknown)}")
        named = lambda r: r.select(*[F.col(f"`{c}`").cast(self.schema[c].dataType).alias(c) for c in (self.key, *columns)])
        return self._delta(self._put(changes, named, "delta", latest_by), "s", columns, expect)

    def set_tags(self, key, tags: list[str]) -> int:
        """A row's tags: trimmed, without blanks and case-insensitive repeats.  Writes one file of one row."""
        kind = self.schema[self.key].dataType.simpleString()
        change = self.spark.createDataFrame([(key, tags)], f"`{self.key}` {kind}, tags array<string>")
        return self.set_fields(change.withColumn("tags", normalise_tags(F.col("tags"))))

    # -------------------------------------------------------------- reading

    def read(self) -> DataFrame:
        return self.read_version(self.version())

    def read_version(self, number: int) -> DataFrame:
        manifest = self.manifest(number)
        return self._rows(manifest, [str(b) for b in range(manifest["buckets"])])

    def get(self, keys: list) -> DataFrame:
        """The rows of a few keys; only their buckets are read."""
        manifest = self.manifest()
        kind = self.schema[self.key].dataType
        asked = self.spark.createDataFrame([(k,) for k in keys], T.StructType([T.StructField(self.key, kind)]))
        buckets = {str(r.b) for r in asked.select(self._bucket(manifest["buckets"]).alias("b")).distinct().collect()}
        rows = self._rows(manifest, sorted(buckets))
        wanted = F.broadcast(asked.select(F.col(f"`{self.key}`").alias("_wanted")).distinct())
        return rows.join(wanted, F.col(f"`{self.key}`").eqNullSafe(F.col("_wanted")), "left_semi")

    def _scan(self, paths: list[str], schema: T.StructType) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(posixpath.join(self.path, p) for p in paths))

    def _pending(self, manifest: dict, bucket: str) -> list[dict]:
        """The deltas of a bucket that are newer than its base."""
        upto = manifest["base"].get(bucket, {}).get("upto", 0)
        return [d for d in manifest["deltas"] if d["seq"] > upto and bucket in d["bytes"]]

    def _rows(self, manifest: dict, buckets: list[str]) -> DataFrame:
        pending = {b: self._pending(manifest, b) for b in buckets}
        base = lambda of: [f"{manifest['base'][b]['folder']}/_bucket={b}" for b in of if manifest["base"].get(b, {}).get("bytes")]
        clean = self._scan(base([b for b in buckets if not pending[b]]), self.schema)
        dirty = [b for b in buckets if pending[b]]
        if not dirty:
            return clean
        rest = self._merged(self._scan(base(dirty), self.schema), pending, dirty)
        return clean.unionByName(rest)

    @staticmethod
    def _weight(pending: dict[str, list[dict]], buckets: list[str]) -> int:
        return sum(d["weight"][b] for b in buckets for d in pending[b])

    def _merged(self, base: DataFrame, pending: dict[str, list[dict]], dirty: list[str]) -> DataFrame:
        used = {d["seq"]: d for b in dirty for d in pending[b]}
        size = self._weight(pending, dirty)
        resolved, columns = self._resolved([(d, [b for b in dirty if d in pending[b]]) for d in used.values()])
        key = F.col(f"`{self.key}`")
        small = F.broadcast if size <= BROADCAST_BYTES else lambda x: x  # else rows are shuffled by key
        slim = resolved.select("_key", F.col("_full").isNotNull().alias("_whole"), *(["_set"] if columns else []))
        joined = base.join(small(slim), key.eqNullSafe(F.col("_key")), "left").where(~F.coalesce("_whole", F.lit(False)))
        new = lambda c, old: F.when(F.col(f"_set.`{c}`.seq").isNotNull(), F.col(f"_set.`{c}`.value")).otherwise(old) if c in columns else old
        stays = joined.select(*[new(f.name, F.col(f"`{f.name}`")).alias(f.name) for f in self.schema])
        later = lambda c, old: (
            F.when(F.col(f"_set.`{c}`.seq") > F.col("_full.seq"), F.col(f"_set.`{c}`.value")).otherwise(old) if c in columns else old
        )
        fresh = resolved.where("_full.op = 'u'").select(*[later(f.name, F.col(f"_full.row.`{f.name}`")).alias(f.name) for f in self.schema])
        return stays.unionByName(fresh)

    def _resolved(self, deltas: list[tuple[dict, list[str]]]) -> tuple[DataFrame, set[str]]:
        """(key, the last full change, the last value of each column that was set) of deltas in given buckets, and those columns."""
        paths = [f"{d['folder']}/_bucket={b}" for d, buckets in deltas for b in buckets]
        by_folder = lambda what, kind: F.element_at(F.create_map(*[x for d, _ in deltas for x in (F.lit(d["folder"]), F.lit(d[what]).cast(kind))]), F.col("_folder"))
        rows = self._scan(paths, self.schema).withColumn("_folder", F.regexp_extract("_metadata.file_path", "((?:delta|base)-[0-9a-f]{32})", 1))
        rows = rows.withColumns({"_seq": by_folder("seq", "long"), "_op": by_folder("op", "string")})
        columns = {c for d, _ in deltas for c in d["columns"]}
        full = F.when(F.col("_op").isin("u", "d"), F.col("_seq"))
        row = F.struct(*(F.col(f"`{f.name}`") for f in self.schema))
        aggregates = [F.max_by(F.struct(F.col("_seq").alias("seq"), F.col("_op").alias("op"), row.alias("row")), full).alias("_full")]
        sets = []
        for c in sorted(columns):
            at = F.when(F.col("_seq").isin([d["seq"] for d, _ in deltas if c in d["columns"]]), F.col("_seq"))
            sets.append(F.max_by(F.struct(F.col("_seq").alias("seq"), F.col(f"`{c}`").alias("value")), at).alias(c))
        return rows.groupBy(F.col(f"`{self.key}`").alias("_key")).agg(*aggregates, *([F.struct(*sets).alias("_set")] if sets else [])), columns

    # -------------------------------------------------------------- upkeep

    def compact(self, deltas: int = 8, share: float = 0.25) -> int:
        """Rewrite the buckets with that many deltas, or whose deltas are that share of their base; 0 deltas: all that have any."""
        version = self.version()
        manifest = self.manifest(version)

        def grown(b: str) -> bool:
            pending = self._pending(manifest, b)
            size = sum(d["bytes"][b] for d in pending)
            return bool(pending) and (len(pending) >= deltas or size >= share * manifest["base"].get(b, {}).get("bytes", 0))

        buckets = [str(b) for b in range(manifest["buckets"]) if grown(str(b))]
        if not buckets:
            return version
        weight = self._weight({b: self._pending(manifest, b) for b in buckets}, buckets)
        name, sizes = self._written(self._rows(manifest, buckets), "base", dealt=weight > BROADCAST_BYTES)

        def change(now: dict, number: int) -> dict:
            fresh = {b: {"folder": name, "upto": version, "bytes": sizes.get(b, 0)} for b in buckets if now["base"].get(b, {}).get("upto", 0) < version}
            after = {**now, "base": {**now["base"], **fresh}}
            return {**after, "deltas": [d for d in after["deltas"] if any(d["seq"] > after["base"].get(b, {}).get("upto", 0) for b in d["bytes"])]}

        return self._commit(change)

    def forget_before(self, number: int) -> None:
        """Remove versions before a number and the folders that only they name; the present one always stays."""
        kept = [n for n in self.log.numbers() if n >= min(number, self.version())]
        gone = [n for n in self.log.numbers() if n not in kept]
        names = lambda of: {x["folder"] for n in of for m in [self.manifest(n)] for x in (*m["base"].values(), *m["deltas"])}
        for folder in names(gone) - names(kept):
            path, fs = self.log._hadoop("..", folder)
            fs.delete(path, True)
        for n in gone:
            self.log.remove(n)

    def files(self) -> list[str]:
        """The folders of buckets that the present version reads."""
        manifest = self.manifest()
        out = []
        for b in map(str, range(manifest["buckets"])):
            out += [f"{manifest['base'][b]['folder']}/_bucket={b}"] if manifest["base"].get(b, {}).get("bytes") else []
            out += [f"{d['folder']}/_bucket={b}" for d in self._pending(manifest, b)]
        return out
