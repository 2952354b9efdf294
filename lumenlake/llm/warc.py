"""WARC archives with revisit records.

Headers alone (id, digest, length, url) are shuffled by payload digest to find each payload's
first page; the decision is joined to the pages once, responses carry the payload and
revisits only refer to it, and every record gets fresh headers.  Archives are written by
Spark's own committed text writer, with the record separator as line separator and gzip around
each file (not around each record, which that writer can't do), so a lost executor leaves no
half-written archive.  Records are written by classes of payload size: a class has as many files as its
bytes over ``archive_bytes``, and so many records a file as its mean payload allows, so that files are of
about that size, a few times it at most, a single larger payload aside.  They are read as a stream, record by record, by Content-Length, so payloads that hold record separators
are kept whole.

Edge cases: a null html is an empty payload; equal payloads below ``least_revisit`` bytes are
all responses; rows that repeat a payload's smallest page id are all responses, other repeats
are revisits; rows with a null id are archived without an id header and come back with a null
id, and a payload known only from such rows is always a response; control characters in urls
are percent-escaped in headers; payloads and urls of any length that fits a Spark string are whole; an
empty table gives no records; further columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lumenlake.llm.common import scratch_dir, written

CRLF = "\r\n"
RECORD = (
    "page_id long, uri string, record_id string, record_type string, digest string, refers_to_record string, "
    "payload binary, payload_bytes long, payload_digest string"
)


@dataclass(frozen=True)
class WarcParams:
    least_revisit: int = 100
    date: str | None = None  # of the records; by default that of the writing
    archive_bytes: int = 64 << 20  # payloads of one archive file
    class_factor: int = 8  # size classes: up to so many times the mean payload, that times as much again, ...


def with_digests(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("digest"),
    )


def resolve(headers: DataFrame, params: WarcParams) -> DataFrame:
    """Headers with refers_to and refers_to_uri: the payload's smallest page id and its url, where the row revisits it."""
    able = headers.where((F.col("payload_bytes") >= params.least_revisit))
    first = (
        able.groupBy("digest")
        .agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "uri"))).alias("first"), F.count("*").alias("n"))
        .where((F.col("n") > 1) & F.col("first").isNotNull())
        .select("digest", "first")
    )
    joined = headers.join(first, "digest", "left")
    revisits = ~F.col("page_id").eqNullSafe(F.col("first.page_id")) & (F.col("payload_bytes") >= params.least_revisit)
    return joined.withColumns({
        "refers_to": F.when(revisits, F.col("first.page_id")), "refers_to_uri": F.when(revisits, F.col("first.uri")),
    }).drop("first")


def _record_id(page_id: Column) -> Column:
    """A UUID-shaped name from an MD5 of the page id."""
    h = F.md5(F.concat(F.lit("page/"), F.coalesce(page_id.cast("string"), F.lit("null"))))
    at = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), at(1, 8), F.lit("-"), at(9, 4), F.lit("-"), at(13, 4), F.lit("-"), at(17, 4), F.lit("-"), at(21, 12), F.lit(">"))


def _header_safe(url: Column) -> Column:
    clean = F.coalesce(url, F.lit(""))
    for code in [*range(0x20), 0x7F]:
        clean = F.replace(clean, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return clean


def record_text(date: str) -> Column:
    """One WARC record, without the separator after it."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(CRLF + CRLF),
    )
    body = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        F.when(F.col("uri") != "", line("WARC-Target-URI", F.col("uri"))).otherwise(F.lit("")),
        F.coalesce(line("X-Page-ID", F.col("page_id").cast("string")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(
            revisit,
            F.concat(
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                line("WARC-Refers-To", _record_id(F.col("refers_to"))),
                F.when(F.col("refers_to_uri") != "", line("WARC-Refers-To-Target-URI", F.col("refers_to_uri"))).otherwise(F.lit("")),
                line("WARC-Refers-To-Date", F.lit(date)),
            ),
        ).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit(CRLF),
        body,
    )


def write_archives(pages: DataFrame, path: str, params: WarcParams = WarcParams()) -> None:
    """Write one record per row of ``pages`` (page_id, url, html) to archives below ``path``."""
    rows = with_digests(pages).withColumn("uri", _header_safe(F.col("url"))).drop("url")
    headers = rows.select("page_id", "digest", "payload_bytes", "uri")
    total, count = headers.agg(F.coalesce(F.sum("payload_bytes"), F.lit(0)), F.count("*")).first()
    # one decision per (page id, digest), so that repeated rows don't multiply in the join; written, as every class asks for it
    decided = written(resolve(headers, params).where("refers_to IS NOT NULL").groupBy(
        F.col("page_id").alias("_id"), F.col("digest").alias("_digest")
    ).agg(F.min("refers_to").alias("refers_to"), F.min("refers_to_uri").alias("refers_to_uri")), "revisits")
    date = params.date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    mean, factor = max(1, -(-total // max(1, count))), params.class_factor
    which = F.greatest(F.lit(0), F.ceil(F.log(float(factor), F.greatest(F.col("payload_bytes"), F.lit(1)) / F.lit(float(mean * factor))) - F.lit(1e-9)).cast("int"))
    classes = headers.groupBy(which.alias("k")).agg(F.sum("payload_bytes").alias("bytes"), F.count("*").alias("n")).orderBy("k").collect()  # a handful
    for c in classes or [Row(k=0, bytes=0, n=0)]:
        these = rows.where(which == c.k)
        same = these["page_id"].eqNullSafe(decided["_id"]) & (these["digest"] == decided["_digest"])
        records = these.join(decided, same, "left").select(
            F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise("").alias("payload"),
            "page_id", "uri", "digest", "payload_bytes", "refers_to", "refers_to_uri",
        )
        per_file = max(1, params.archive_bytes * c.n // max(1, c.bytes))
        (
            records.select(record_text(date).alias("value"))
            .coalesce(max(1, -(-c.n // per_file)))
            .write.option("lineSep", CRLF + CRLF)
            .option("compression", "gzip")
            .option("maxRecordsPerFile", per_file + per_file // 4)
            .text(f"{path}/class-{c.k}")
        )


def parse_records(archive):
    """(headers, block) of each record of an open archive, by Content-Length; one record is held at a time."""
    while line := archive.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        headers = {}
        while (line := archive.readline()) not in (b"\r\n", b""):
            name, _, value = line.partition(b":")
            headers[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
        length = int(headers["content-length"])
        block = archive.read(length)
        if len(block) < length:
            raise ValueError("an archive ends within a record")
        yield headers, block


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives below ``path``, with lengths and digests of the payloads read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")

    def run(batches):
        import pyarrow as pa

        names = ["page_id", "uri", "record_id", "record_type", "digest", "refers_to_record", "payload", "payload_bytes", "payload_digest"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string()]

        def flush(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], names)

        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for headers, block in parse_records(gzip.open(pa.BufferReader(content.as_buffer()))):
                    response = headers["warc-type"] == "response"
                    _, _, payload = block.partition(b"\r\n\r\n")
                    rows.append((
                        int(headers["x-page-id"]) if "x-page-id" in headers else None,
                        headers.get("warc-target-uri"),
                        headers["warc-record-id"],
                        headers["warc-type"],
                        headers["warc-payload-digest"].removeprefix("sha256:"),
                        headers.get("warc-refers-to"),
                        payload if response else None,
                        len(payload) if response else None,
                        hashlib.sha256(payload).hexdigest() if response else None,
                    ))
                    held += len(block)
                    if held > 4 << 20:
                        yield flush(rows)
                        rows, held = [], 0
                if rows:
                    yield flush(rows)

    return files.mapInArrow(run, RECORD)


def resolved(records: DataFrame) -> DataFrame:
    """Records with revisits joined to their responses by record id; refers_to is the response's page id."""
    slim = records.drop("payload")  # a column that may be gone already
    revisits = slim.where("record_type = 'revisit'")
    wanted = (
        slim.where("record_type = 'response' AND page_id IS NOT NULL")
        .groupBy("record_id", F.col("payload_digest").alias("digest"))
        .agg(F.min("page_id").alias("of_page"), F.max("payload_bytes").alias("of_bytes"), F.max("payload_digest").alias("of_digest"))
        .withColumnRenamed("record_id", "refers_to_record")
    )
    joined = revisits.join(wanted, ["refers_to_record", "digest"], "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return (
        slim.where("record_type = 'response'")
        .withColumn("refers_to", F.lit(None).cast("long"))
        .select(columns)
        .unionByName(
            joined.select(
                "page_id",
                F.col("of_bytes").alias("payload_bytes"),
                F.col("of_digest").alias("payload_digest"),
                "record_type",
                F.col("of_page").alias("refers_to"),
            )
        )
    )


def archive_round_trip(pages: DataFrame, params: WarcParams = WarcParams()) -> DataFrame:
    """Write the pages' archives to the shared folder, read them back and resolve the revisits."""
    spark = pages.sparkSession
    path = scratch_dir(spark, "warc")
    write_archives(pages, path, params)
    return resolved(written(read_archives(spark, path).drop("payload"), "warc-records"))
