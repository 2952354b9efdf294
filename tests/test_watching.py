"""Listings of folders, changes between them, changes that wait, and totals by the way."""

import os
import time

from pyspark.sql import functions as F

from lumenlake.operators import enrichment
from lumenlake.plans import planning
from lumenlake.sources import scan
from lumenlake.streaming import watch


def put(path, text="12345"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_all_names_and_levels_are_listed(spark, tmp_path):
    root = tmp_path / "a folder"
    for name in ("_a.jpg", "b.JPG", "x/_y/_c.png", "x/d.mp4", "x/y/z/e.png", "x/.hidden/f.png", ".g.png", "h.txt", "x/é ü+%20.gif"):
        put(root / name)
    os.symlink(root / "nothing", root / "dead.png")
    got = {r.item_uri.removeprefix(f"file:{root}/"): (r.media_kind, r.size_bytes) for r in scan.scan(spark, str(root)).collect()}
    assert set(got) == {"_a.jpg", "b.JPG", "x/_y/_c.png", "x/d.mp4", "x/y/z/e.png", "x/é ü+%20.gif"} and got["x/d.mp4"] == ("video", 5)
    assert {r.item_uri.rsplit("/", 1)[1] for r in scan.scan(spark, f"file://{root}/x").collect()} == {"_c.png", "d.mp4", "e.png", "é ü+%20.gif"}
    rows, skipped = scan.scan_all(spark, [str(root), str(tmp_path / "gone"), "ftp://x"])
    assert rows.count() == 6 and [s for s, _ in skipped] == [str(tmp_path / "gone"), "ftp://x"]


def test_changes_between_listings_arrive_once(spark, tmp_path):
    root, seen = tmp_path / "in", []
    put(root / "a.jpg")
    put(root / "sub/b.jpg")
    handled = lambda changes, batch: seen.append((batch, sorted((r.uri.rsplit("/", 1)[1], r.change) for r in changes.collect())))
    make = lambda: watch.ListingWatch(spark, str(root), f"file://{tmp_path}/state", handled)
    make().tick(0)
    put(root / "a.jpg", "longer text")
    (root / "sub/b.jpg").unlink()
    put(root / "_c.jpg")
    make().tick(1)
    put(root / "d.jpg")
    make().tick(1)  # a batch that is run again sees what it saw
    make().tick(2)
    make().tick(3)
    assert seen[0] == (0, [("a.jpg", "added"), ("b.jpg", "added")])
    assert seen[1] == seen[2] == (1, [("_c.jpg", "added"), ("a.jpg", "changed"), ("b.jpg", "removed")])
    assert seen[3:] == [(2, [("d.jpg", "added")]), (3, [])]
    assert len(list((tmp_path / "state").glob("listing-*"))) == 2


def test_a_watch_goes_on_from_its_checkpoint(spark, tmp_path):
    root, seen = tmp_path / "in", []
    put(root / "a.jpg")

    def go_until(n):
        query = watch.ListingWatch(spark, str(root), f"file://{tmp_path}/state", lambda c, b: seen.extend((r.uri.rsplit("/", 1)[1], r.change) for r in c.collect())).run(f"file://{tmp_path}/checkpoint", "0 seconds")
        end = time.time() + 90
        while len(seen) < n and time.time() < end:
            time.sleep(0.2)
        query.stop()

    go_until(1)
    put(root / "b.jpg")
    go_until(2)
    assert seen == [("a.jpg", "added"), ("b.jpg", "added")]


def test_changes_wait_for_quiet_and_for_jobs(spark, tmp_path):
    pending = watch.PendingChanges(spark, f"file://{tmp_path}/p", quiet=5.0, buckets=1)
    events = lambda *rows: spark.createDataFrame(list(rows), "root string, path string, at double")
    due = lambda now, *busy: sorted((r.root, r.path) for r in pending.due(now, spark.createDataFrame([(b,) for b in busy], "root string")).collect())
    pending.add(events(("r", "a", 0.0), ("r", "b", 3.0), ("s", None, 1.0)))
    assert due(6.0) == [("s", "<unknown>")]  # r was quiet for 3 seconds only
    assert due(8.0, "r") == [("s", "<unknown>")]  # r's job runs: it is put off
    assert due(12.9, "s") == [] and due(13.0) == [("r", "a"), ("r", "b")]  # s is quiet from 12.9
    given = spark.createDataFrame(pending.due(13.0).collect(), "root string, path string, at double")
    pending.put_off(spark.createDataFrame([("r",)], "root string"), 13.0)  # the job could not be started
    assert due(14.0) == [] and due(18.0) == [("r", "a"), ("r", "b"), ("s", "<unknown>")]
    pending.add(events(("r", "b", 15.0)))  # while the job runs
    pending.done(given)
    assert due(100.0) == [("r", "b"), ("s", "<unknown>")]


def test_totals_by_the_way_are_those_of_a_pass(spark, tmp_path):
    rows = spark.range(1_000).select(F.col("id").cast("string").alias("uri"), F.get(F.array(*map(F.lit, ("indexed", "skipped", "failed"))), (F.col("id") % 3).cast("int")).alias("status"))
    got = planning.with_totals(rows, lambda r: r.write.parquet(str(tmp_path / "o")))
    assert got.first() == planning.totals(spark.read.parquet(str(tmp_path / "o"))).first()
    assert planning.with_totals(rows.limit(0), lambda r: r.write.parquet(str(tmp_path / "none"))).first().total == 0


def test_pictures_that_are_not_decoded_have_a_reason(spark, tmp_path):
    import struct
    import zlib

    def png(w, h, pixels):
        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        raw = b"".join(b"\0" + pixels[i * w * 3 : (i + 1) * w * 3] for i in range(h))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")

    pixels = bytes(range(18))
    (tmp_path / "good.PNG").write_bytes(png(3, 2, pixels))
    (tmp_path / "broken.png").write_bytes(png(3, 2, pixels)[:30])
    (tmp_path / "other.webp").write_bytes(b"RIFF0000WEBP")
    (tmp_path / "empty.jpg").write_bytes(b"")
    (tmp_path / "note.txt").write_bytes(b"x")
    got = {r.item_uri.rsplit("/", 1)[1]: (None if r.data is None else bytes(r.data), r.width, r.error) for r in scan.decoded(spark, str(tmp_path)).collect()}
    assert got == {"good.PNG": (pixels, 3, None), "empty.jpg": (None, None, "empty"), **{n: (None, None, "not decoded") for n in ("broken.png", "other.webp")}}
    assert [r.width for r in scan.images(spark, str(tmp_path)).collect()] == [3]
    rows = [(b"abc", 1, 1), (b"ab", 1, 1), (None, 1, 1), (b"abc", None, 1), (b"", 0, 0)]
    hashed = enrichment.with_hashes(spark.createDataFrame(rows, "data binary, width int, height int")).collect()
    assert [r.phash is None for r in hashed] == [False, True, True, True, True]
