"""Versioned Parquet tables: every change writes a new version, then a numbered pointer to it.

A version's folder is complete before its pointer is there, pointers are never changed, and the
highest one counts: readers see the old or the new table whatever step a job dies in, and a dead
job leaves only a folder without a pointer.  A pointer comes into being by a rename that fails if
its number is taken, so of two writers that began from one version the second gets an error and
nothing is lost.  (Stores without such a rename, as plain object stores, need a committer of their own.)
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlake.functions.text import normalise_tags


class ConcurrentChange(RuntimeError):
    """Another writer has changed the table since it was read; nothing was written."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, key: str, schema: T.StructType | str):
        self.spark, self.path, self.key = spark, path, key
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def _hadoop(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(posixpath.join(self.path, *parts))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _pointers(self) -> dict[int, str]:
        folder, fs = self._hadoop("_pointers")
        if not fs.exists(folder):
            return {}
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return {int(n.split("-", 1)[0]): n for n in names if n[:1].isdigit()}

    def version(self) -> int:
        """The number of the present version; 0 before the first change."""
        return max(self._pointers(), default=0)

    def _folder(self, number: int) -> str:
        path, fs = self._hadoop("_pointers", self._pointers()[number])
        stream = fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
        finally:
            stream.close()

    def read(self) -> DataFrame:
        return self.read_version(self.version())

    def read_version(self, number: int) -> DataFrame:
        if number == 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(posixpath.join(self.path, self._folder(number)))

    def _change(self, of) -> int:
        """Commit ``of`` (the present rows) as the next version."""
        base = self.version()
        name = f"v-{uuid.uuid4().hex}"
        rows = of(self.read_version(base))
        rows.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in self.schema]).write.parquet(posixpath.join(self.path, name))
        return self._point(base + 1, name)

    def _point(self, number: int, name: str) -> int:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        folder, fs = self._hadoop("_pointers")
        fs.mkdirs(folder)
        fresh, _ = self._hadoop("_pointers", f".{uuid.uuid4().hex}")
        out = fs.create(fresh, True)
        out.write(bytearray(name.encode()))
        out.close()
        final, _ = self._hadoop("_pointers", f"{number:012d}")
        options = self.spark._sc._gateway.new_array(hadoop.Options.Rename, 1)
        options[0] = hadoop.Options.Rename.NONE
        try:
            hadoop.FileContext.getFileContext(folder.toUri(), self.spark._jsc.hadoopConfiguration()).rename(fresh, final, options)
        except Exception as e:
            fs.delete(fresh, False)
            if "FileAlreadyExists" in str(e):
                raise ConcurrentChange(f"version {number} of {self.path} is there already") from e
            raise
        return number

    def upsert(self, rows: DataFrame) -> int:
        """Rows replace those of equal key; of repeated keys among them any one is taken."""
        new = rows.dropDuplicates([self.key])
        return self._change(
            lambda old: old.join(new.select(self.key), self.key, "left_anti").unionByName(new, allowMissingColumns=True)
        )

    def insert_missing(self, rows: DataFrame) -> int:
        """Rows whose key is not there yet are added; the others are left as they are."""
        new = rows.dropDuplicates([self.key])
        return self._change(
            lambda old: old.unionByName(new.join(old.select(self.key), self.key, "left_anti"), allowMissingColumns=True)
        )

    def delete(self, ids: DataFrame) -> int:
        return self._change(lambda old: old.join(ids.select(self.key).distinct(), self.key, "left_anti"))

    def set_fields(self, changes: DataFrame) -> int:
        """Named columns of ``changes`` (key and others) replace the stored ones; rows without a change stay.

        Of several changes of one key any one is made; a change of an unknown key does nothing.
        """
        columns = [c for c in changes.columns if c != self.key]
        marked = changes.dropDuplicates([self.key]).select(self.key, F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_new"))

        def changed(old: DataFrame) -> DataFrame:
            joined = old.join(marked, self.key, "left")
            new = {c: F.when(F.col("_new").isNotNull(), F.col(f"_new.`{c}`")).otherwise(F.col(f"`{c}`")) for c in columns}
            return joined.withColumns(new)

        return self._change(changed)

    def set_tags(self, key, tags: list[str]) -> int:
        """A row's tags: trimmed, without blanks and case-insensitive repeats."""
        kind = self.schema[self.key].dataType.simpleString()
        change = self.spark.createDataFrame([(key, tags)], f"{self.key} {kind}, tags array<string>")
        return self.set_fields(change.withColumn("tags", normalise_tags(F.col("tags"))))

    def forget_before(self, number: int) -> None:
        """Remove versions before a number; the present one always stays."""
        for old in sorted(self._pointers()):
            if old < min(number, self.version()):
                for parts in ((self._folder(old),), ("_pointers", self._pointers()[old])):
                    path, fs = self._hadoop(*parts)
                    fs.delete(path, True)


def check_schema(df: DataFrame, wanted: T.StructType) -> list[str]:
    """What is missing or of another type in a table that is opened."""
    have = {f.name: f.dataType for f in df.schema}
    return [f"{f.name}: {'missing' if f.name not in have else have[f.name].simpleString()}" for f in wanted if have.get(f.name) != f.dataType]
