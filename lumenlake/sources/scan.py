"""Scans of media files, as rows of (item_uri, source, size_bytes, modified_at, media_kind)."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Extensions by kind; an earlier kind takes precedence.
EXTENSIONS = {
    "video": (".avi", ".m4v", ".mkv", ".mov", ".mp4", ".webm"),
    "audio": (".aac", ".aif", ".aiff", ".flac", ".m4a", ".mp3", ".ogg", ".opus", ".wav", ".wma"),
    "pdf": (".pdf",),
    "image": (".bmp", ".gif", ".jpeg", ".jpg", ".png", ".tif", ".tiff", ".webp"),
}


def parse_extensions(text: str) -> frozenset[str]:
    parts = {p.strip().lower() for p in text.split(",") if p.strip()}
    if not parts:
        raise ValueError("no extensions")
    return frozenset(p if p.startswith(".") else f".{p}" for p in parts)


def parse_sources(text: str, environ: dict[str, str] | None = None) -> list[str]:
    """A JSON list, or items parted by the first of newline, semicolon and comma that occurs."""
    text = text.strip()
    if text.startswith("["):
        items = [str(x) for x in json.loads(text)]
    else:
        mark = next((m for m in "\n;," if m in text), "\n")
        items = text.split(mark)
    env = os.environ if environ is None else environ
    named = lambda s: re.sub(r"\$\{(\w+)\}|\$(\w+)", lambda m: env.get(m[1] or m[2], m[0]), s)
    clean = (named(i.strip()) for i in items)
    return [os.path.expanduser(i) for i in clean if i and not i.startswith("#")]


def source_kind(spec: str) -> str:
    """local, object or unavailable."""
    scheme = spec.split("://", 1)[0].lower() if "://" in spec else ""
    if scheme in ("", "file", "local"):
        return "local"
    return "object" if scheme in ("s3", "s3a", "minio") else "unavailable"


def spark_path(spec: str) -> str:
    scheme, _, rest = spec.rpartition("://")
    return {"": rest, "file": f"file://{rest}", "local": rest}.get(scheme.lower(), f"s3a://{rest}")


def kind_of(extension: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind in reversed(EXTENSIONS):
        out = F.when(extension.isin(*EXTENSIONS[kind]), kind).otherwise(out)
    return out


class Folder(InputPartition):
    """A folder with all below it, or only the files that are in it."""

    def __init__(self, path: str, deep: bool):
        super().__init__(path)
        self.path, self.deep = path, deep


class FolderReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[Folder]:
        """The driver lists the first two levels; what is below is listed by the tasks, a folder each."""
        if os.path.isfile(self.root):
            return [Folder(self.root, False)]
        shallow, deep = [self.root], []
        for first in sorted(e.path for e in os.scandir(self.root) if e.is_dir()):
            shallow.append(first)
            deep += sorted(e.path for e in os.scandir(first) if e.is_dir())
        return [*(Folder(p, False) for p in shallow), *(Folder(p, True) for p in deep)]

    def read(self, partition: Folder):
        if os.path.isfile(partition.path):
            yield self._row(partition.path)
            return
        for folder, inside, names in os.walk(partition.path, followlinks=True):
            if not partition.deep:
                inside.clear()
            for name in sorted(names):
                try:
                    yield self._row(os.path.join(folder, name))
                except FileNotFoundError:  # gone since it was listed, or a link to nothing
                    continue

    @staticmethod
    def _row(path: str) -> tuple:
        s = os.stat(path)
        return (f"file:{path}", s.st_size, s.st_mtime_ns / 1e9)


class FolderSource(DataSource):
    """Files below a mounted folder, whatever their names (Spark's readers skip those that begin with an underscore)."""

    @classmethod
    def name(cls) -> str:
        return "lumenlake_folder"

    def schema(self) -> str:
        return "path string, length long, modified_at double"

    def reader(self, schema) -> FolderReader:
        return FolderReader(os.path.abspath(self.options["path"]))


def listed(spark: SparkSession, spec: str) -> DataFrame:
    """(path, length, modified_at) of all files below a source: tasks list a mounted folder, Spark's reader an object store."""
    if source_kind(spec) == "local":
        root = re.sub("^file:/*", "/", spark_path(spec))
        if not os.path.exists(root):
            raise FileNotFoundError(f"no such source: {root}")
        spark.dataSource.register(FolderSource)
        return spark.read.format("lumenlake_folder").option("path", root).load()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(spark_path(spec))
    return files.select("path", "length", (F.unix_micros("modificationTime") / F.lit(1e6)).alias("modified_at"))


def scan(spark: SparkSession, spec: str, extensions: frozenset[str] | None = None) -> DataFrame:
    """Media files below a source; contents are not read.  Files below hidden folders of the source are left out."""
    wanted = extensions or frozenset(e for es in EXTENSIONS.values() for e in es)
    files = listed(spark, spec)
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    rows = files.select(
        F.col("path").alias("item_uri"),
        F.lit(spec).alias("source"),
        F.col("length").alias("size_bytes"),
        "modified_at",
        ext.alias("extension"),
    )
    # the source's own path may have hidden parts: what counts lies below it
    bare = F.regexp_replace("item_uri", "^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")
    root = re.sub("^[A-Za-z][A-Za-z0-9+.-]*:/*", "/", spark_path(spec)).rstrip("/") + "/"
    below = F.when(F.startswith(bare, F.lit(root)), F.substr(bare, F.lit(len(root)))).otherwise(bare)
    return rows.where(F.col("extension").isin(*wanted) & ~below.rlike(r"/\.[^/]")).withColumn("media_kind", kind_of(F.col("extension")))


def decoded(spark: SparkSession, spec: str) -> DataFrame:
    """(item_uri, data, width, height, error) of the pictures below a source, as RGB bytes, by Spark's reader.

    A file with a picture's extension that the reader doesn't decode (a broken one, or of a format that it
    doesn't know) has an error and no data.
    """
    names = "*.{" + ",".join(e for name in EXTENSIONS["image"] for e in (name[1:], name[1:].upper())) + "}"
    read = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(spark_path(spec))

    def rgb(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out, errors = [], []
            for data, width, height, channels in zip(*(batch.column(c).to_pylist() for c in ("data", "width", "height", "nChannels"))):
                good = channels in (1, 3, 4) and width > 0 and height > 0 and len(data) == width * height * channels
                errors.append(None if good else "not decoded" if channels not in (1, 3, 4) else "not as many bytes as pixels")
                if not good:
                    out.append(None)
                    continue
                pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
                out.append((np.repeat(pixels, 3, axis=2) if channels == 1 else pixels[:, :, 2::-1]).tobytes())  # stored as BGR or BGRA
            sizes = [pa.array([v if e is None else None for v, e in zip(batch.column(c).to_pylist(), errors)], pa.int32()) for c in ("width", "height")]
            columns = [batch.column("origin"), pa.array(out, pa.binary()), *sizes, pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["item_uri", "data", "width", "height", "error"])

    rows = read.select("image.*").select("origin", "data", "width", "height", "nChannels")
    seen = rows.mapInArrow(rgb, "item_uri string, data binary, width int, height int, error string")
    if source_kind(spec) != "local":
        return seen
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    empty = listed(spark, spec).where((F.col("length") == 0) & ext.isin(*EXTENSIONS["image"]))  # Spark's reader leaves these out
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in (("data", "binary"), ("width", "int"), ("height", "int"))]
    return seen.unionByName(empty.select(F.col("path").alias("item_uri"), *nothing, F.lit("empty").alias("error")))


def images(spark: SparkSession, spec: str) -> DataFrame:
    """(item_uri, data, width, height) of the pictures of `decoded` without an error."""
    return decoded(spark, spec).where("error IS NULL").drop("error")


def scan_all(spark: SparkSession, specs: list[str]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """The union of all sources that can be read, and (source, reason) of those that can't."""
    empty = "item_uri string, source string, size_bytes long, modified_at double, extension string, media_kind string"
    out, skipped = spark.createDataFrame([], empty), []
    for spec in specs:
        if source_kind(spec) == "unavailable":
            skipped.append((spec, "not supported"))
            continue
        try:
            rows = scan(spark, spec)
            rows.schema
        except Exception as e:  # an unreachable source is reported, the others go on
            skipped.append((spec, str(e).splitlines()[0]))
            continue
        out = out.unionByName(rows)
    return out, skipped
