"""Benchmark decontamination with a broadcast hash set of normalised n-grams.

The windows of all benchmark items are hashed into a sorted set; each document's token
windows are rolled over it, and every hash hit is verified against the window's words, so
that a collision never counts.  Beyond ``max_windows`` windows, or ``max_bytes`` of their texts,
the set is dealt in blocks, one pass each, and the blocks' hits are united per document.

Words are runs of digits, letters and bytes from 80 on, after lower-casing A-Z.  An item of
fewer words than a window, but not none, is one window of its own length.

Edge cases: null and empty texts have no words and no hits; repeated items are each named;
items with a null id give hits but no item; texts are hashed in slices of bounded size, so
long ones need no more than 16 bytes a word; an empty benchmark or table contaminates
nothing; further columns are kept by the removing forms and not read by the report.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import written
from lumenlake.plans.scratch import discard, materialised_at

IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[np.r_[48:58, 65:91, 97:123, 128:256]] = True
TO_LOWER = np.arange(256, dtype=np.uint64)
TO_LOWER[65:91] += np.uint64(32)
ODD = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)
SLICE = 1 << 18  # bytes hashed at once


@dataclass(frozen=True)
class DecontamParams:
    window_words: int = 10
    max_windows: int = 2_000_000  # of one broadcast block: about 60 MB in a worker
    max_bytes: int = 64 << 20  # of the items' texts in a block


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_P = _powers(ODD, SLICE + 1)
_INV = np.uint64(pow(int(ODD), -1, 1 << 64))
_PI = _powers(_INV, SLICE + 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def words_in(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words of one text (its UTF-8 bytes)."""
    mask = IS_WORD[raw]
    edge = np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))
    starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    hashes = np.empty(len(starts), dtype=np.uint64)
    w = 0
    while w < len(starts):  # slices that begin with a word and hold whole words
        at = starts[w]
        stop = int(np.searchsorted(ends, at + SLICE, side="right"))
        if stop <= w:  # a single word longer than a slice
            hashes[w] = np.frombuffer(
                hashlib.blake2b(raw[starts[w] : ends[w]].tobytes().lower(), digest_size=8).digest(), np.uint64
            )[0]
            w += 1
            continue
        piece = TO_LOWER[raw[at : ends[stop - 1]]]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((piece + np.uint64(1)) * _P[: len(piece)])])
        s, e = starts[w:stop] - at, ends[w:stop] - at
        hashes[w:stop] = _mix((sums[e] - sums[s]) * _PI[s] + (e - s).astype(np.uint64) * STEP)
        w = stop
    return starts, ends, hashes


def roll(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n words."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(count, dtype=np.uint64)
    for k in range(n):
        out = out * STEP + hashes[k : k + count]
    return _mix(out)


class WindowSet:
    """The windows of a block of items: sorted hashes, and where each window lies in the items' texts.

    Items are held once as bytes, words parted by a space; a window is a hash, two offsets and its
    item's number in arrays, so a block takes about 30 bytes a window beside the texts.
    """

    def __init__(self, pieces: list[tuple[object, list[bytes]]], window_words: int):
        self.items = [None if item is None else str(item) for item, _ in pieces]
        self.text = b" ".join(b" ".join(words) for _, words in pieces)
        self.by_length: dict[int, tuple[np.ndarray, ...]] = {}
        found: dict[int, list[tuple[np.ndarray, ...]]] = defaultdict(list)
        at = 0
        for number, (_, words) in enumerate(pieces):
            raw = np.frombuffer(self.text, dtype=np.uint8)[at : at + sum(map(len, words)) + len(words) - 1]
            starts, ends, hashes = words_in(raw)
            n = min(window_words, len(words))
            count = len(words) - n + 1
            found[n].append((roll(hashes, n), at + starts[:count], at + ends[n - 1 :], np.full(count, number)))
            at += len(raw) + 1
        for n, parts in found.items():
            hashes, first, last, owner = (np.concatenate([p[k] for p in parts]) for k in range(4))
            order = np.lexsort((owner, hashes))
            self.by_length[n] = (hashes[order], first[order], last[order], owner[order].astype(np.int32))

    def scan(self, raw: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, set]:
        """Word count, word starts and ends, mask of hit words, and items with windows that occur."""
        starts, ends, hashes = words_in(raw)
        hit = np.zeros(len(starts) + 1, dtype=np.int64)
        items: set = set()
        seen: dict[bytes, bool] = {}
        for n, (known, first, last, owner) in self.by_length.items():
            rolled = roll(hashes, n)
            if not len(rolled):
                continue
            low = np.searchsorted(known, rolled)
            low[low == len(known)] = 0
            for i in np.nonzero(known[low] == rolled)[0].tolist():
                words = b" ".join(raw[starts[k] : ends[k]].tobytes().lower() for k in range(i, i + n))
                if words not in seen:  # of equal hashes those of equal words
                    high = int(np.searchsorted(known, rolled[i], side="right"))
                    same = [k for k in range(int(low[i]), high) if self.text[first[k] : last[k]] == words]
                    seen[words] = bool(same)
                    items.update(x for x in (self.items[owner[k]] for k in same) if x is not None)
                if seen[words]:
                    hit[i] += 1
                    hit[i + n] -= 1
        return len(starts), starts, ends, np.cumsum(hit)[:-1] > 0, items


def item_words(text: str | None) -> list[bytes]:
    raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
    starts, ends, _ = words_in(raw)
    return [raw[a:b].tobytes().lower() for a, b in zip(starts, ends)]


def window_blocks(benchmark: DataFrame, params: DecontamParams):
    """Blocks of at most ``max_windows`` windows and about ``max_bytes`` of text, read item by item.

    An item of more windows is cut into pieces that overlap by a window less a word.
    """
    n, most = params.window_words, params.max_windows
    pieces, windows, size = [], 0, 0
    for row in benchmark.select("item_id", "text").where("text IS NOT NULL").toLocalIterator():
        words = item_words(row.text)
        for start in range(0, max(1, len(words) - n + 1), most):
            piece = words[start : start + most + n - 1]
            count, length = max(1, len(piece) - n + 1), sum(map(len, piece)) + len(piece)
            if pieces and (windows + count > most or size + length > params.max_bytes):
                yield WindowSet(pieces, n)
                pieces, windows, size = [], 0, 0
            if piece:
                pieces.append((row.item_id, piece))
                windows, size = windows + count, size + length
    if pieces:
        yield WindowSet(pieces, n)


def _runs_of(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
    return np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]


FOUND = "struct<n_words:bigint,hit_from:array<bigint>,hit_to:array<bigint>,items:array<string>>"


def _scanned(rows: DataFrame, windows: WindowSet | None, texts_too: bool = True) -> DataFrame:
    """``rows`` (row, text, found) with a block's hits united with those found before; one pass, no shuffle."""
    schema = rows.schema if texts_too else rows.select("row", "found").schema
    shared = rows.sparkSession.sparkContext.broadcast(windows)  # bounded by max_windows and max_bytes

    def run(batches):
        import pyarrow as pa

        known = shared.value or WindowSet([], 1)
        longs = pa.list_(pa.int64())
        kinds = {"n_words": pa.int64(), "hit_from": longs, "hit_to": longs, "items": pa.list_(pa.string())}
        for batch in batches:
            out: dict[str, list] = {k: [] for k in kinds}
            before = batch.column("found").to_pylist()
            for t, old in zip(batch.column("text").cast(pa.large_binary()), before):
                n, _, _, hit, items = known.scan(np.frombuffer(t.as_py() or b"", dtype=np.uint8))
                if old is not None:
                    for a, b in zip(old["hit_from"], old["hit_to"]):
                        hit[a:b] = True
                    items |= set(old["items"])
                first, last = _runs_of(hit)
                for name, value in zip(kinds, (n, first, last, sorted(items))):
                    out[name].append(value)
            found = pa.StructArray.from_arrays([pa.array(out[k], kind) for k, kind in kinds.items()], list(kinds))
            out_columns = [found if c == "found" else batch.column(c) for c in schema.names]
            yield pa.RecordBatch.from_arrays(out_columns, schema.names)

    return rows.mapInArrow(run, schema)


def with_hits(docs: DataFrame, benchmark: DataFrame, params: DecontamParams, texts_too: bool = True) -> DataFrame:
    """(row, text, found) per row of ``docs``: its other columns as a struct, its text if wanted, and the hits of all blocks.

    One block (the usual case) is one pass.  With more, rows are numbered and written once; a block's pass
    writes the numbers and hits of the rows that it hits, and these are united once.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*others).alias("row"), "text", F.lit(None).cast(FOUND).alias("found"))
    blocks = window_blocks(benchmark, params)
    first, second = next(blocks, None), next(blocks, None)
    if second is None:
        return _scanned(rows, first, texts_too)
    numbered = written(rows.select(F.struct("row", F.monotonically_increasing_id().alias("n")).alias("row"), "text", "found"), "windows")
    hits = []
    for block in chain([first, second], blocks):
        found = _scanned(numbered, block, texts_too=False)
        hits.append(written(found.select("row.n", "found").where(F.size("found.hit_from") > 0) if hits else found.select("row.n", "found"), "hits"))
    every = reduce(DataFrame.unionByName, hits).groupBy("n").agg(F.collect_list("found").alias("found"))  # a row per block at most
    united = every.mapInArrow(_united, f"n bigint, found {FOUND}")
    kept = numbered.select(F.col("row.n").alias("n"), "row.row", *(["text"] if texts_too else []))
    return kept.join(united, "n").select("row", *(["text"] if texts_too else []), "found")


def _united(batches):
    """Hits of several blocks in one row as those of one."""
    import pyarrow as pa

    longs = pa.list_(pa.int64())
    kind = pa.struct([("n_words", pa.int64()), ("hit_from", longs), ("hit_to", longs), ("items", pa.list_(pa.string()))])
    for batch in batches:
        out = []
        for several in batch.column("found").to_pylist():
            words = several[0]["n_words"]
            hit = np.zeros(words + 1, dtype=np.int64)
            for f in several:
                np.add.at(hit, f["hit_from"], 1)
                np.add.at(hit, f["hit_to"], -1)
            first, last = _runs_of(np.cumsum(hit)[:-1] > 0)
            out.append({"n_words": words, "hit_from": first.tolist(), "hit_to": last.tolist(), "items": sorted({i for f in several for i in f["items"]})})
        yield pa.RecordBatch.from_arrays([batch.column("n"), pa.array(out, kind)], ["n", "found"])


def report(docs: DataFrame, benchmark: DataFrame, params: DecontamParams = DecontamParams()) -> DataFrame:
    """(doc_id, n_words, n_hit, items) per row of ``docs``; items are the sorted ids, as strings."""
    found = with_hits(docs.select("doc_id", "text"), benchmark, params, texts_too=False)
    n_hit = F.aggregate(
        F.zip_with("found.hit_to", "found.hit_from", lambda b, a: b - a), F.lit(0).cast("long"), lambda acc, x: acc + x
    )
    return found.select("row.doc_id", "found.n_words", n_hit.alias("n_hit"), "found.items")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, params: DecontamParams = DecontamParams(), mode: str = "document"
) -> DataFrame:
    """``document``: rows without any hit stay.  ``span``: hit words are cut out of the texts.

    Both keep all columns.  Hits of all blocks are united before anything is cut, so the result
    doesn't depend on the size of a block.
    """
    if mode not in ("document", "span"):
        raise ValueError("mode is document or span")
    if mode == "document":
        waiting, path = None, None
        for block in window_blocks(benchmark, params):  # one pass over the rows for each, without a shuffle
            if waiting is not None:
                docs, done = materialised_at(_clean(docs, waiting), "clean")
                if path is not None:
                    discard(docs.sparkSession, path)
                path = done
            waiting = block
        return docs if waiting is None else _clean(docs, waiting)
    found = with_hits(docs, benchmark, params)

    def run(batches):
        import pyarrow as pa

        def cut(raw: bytes | None, runs) -> bytes | None:
            if not runs["hit_from"]:
                return raw
            starts, ends, _ = words_in(np.frombuffer(raw, dtype=np.uint8))
            kept, at = [], 0
            for a, b in zip(runs["hit_from"], runs["hit_to"]):
                kept.append(raw[at : starts[a]])
                at = int(ends[b - 1])
            return b"".join([*kept, raw[at:]])

        for batch in batches:
            texts = batch.column("text")
            new = [cut(t.as_py(), runs) for t, runs in zip(texts.cast(pa.large_binary()), batch.column("found").to_pylist())]
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(new, pa.large_binary()).cast(pa.large_string()).cast(texts.type))

    done = found.mapInArrow(run, found.schema)
    return done.select(*("text" if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))


def _clean(docs: DataFrame, windows: WindowSet) -> DataFrame:
    """The rows without a hit of the block's windows."""
    shared = docs.sparkSession.sparkContext.broadcast(windows)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            clean = [not shared.value.scan(np.frombuffer(t.as_py() or b"", dtype=np.uint8))[3].any() for t in texts]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
