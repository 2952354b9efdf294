"""Best-fit packing of documents into sequences, certified by lower bounds.

Documents are encoded, an end token is added, and what is longer than a sequence is cut into whole
sequences with the remainder in front.  Pieces shorter than a sequence are packed: they are dealt to
partitions, and each is packed by best-fit decreasing.  Dual-feasible functions of the piece lengths give
a lower bound of the bins that any packing needs: a partition whose bins equal its bound is as good as it
can be by itself.  One with a gap is packed again with documents exchanged between its bins so that rooms are filled
exactly, if that needs fewer.  The same bounds over all lengths (a table of at most ``length`` rows) certify the whole:
packing ends when the bins equal the whole's bound.  Until then the emptiest bins of partitions with a
gap are opened, their pieces go to a partition shared by ``fan`` others, and best-fit decreasing is
run again there; if it doesn't need fewer bins, the bins stay as they were.  Each round has 1/``fan``
of the partitions of the one before, so a partition never holds more than ``part_pieces`` pieces and the
number of rounds grows with the logarithm of the number of pieces.

Token ids: a byte-level vocabulary without normalisation is run by a second library that reads
the same merges, several times as fast and equal in every id (a test compares them over all
characters); a text with a special token or very much white space at once, or any other kind of tokenizer,
goes through the tokenizers library.  Very long texts are encoded in pieces that end before white space, where no
token can span.

Edge cases: null texts are empty and are one end token; texts of any length are read whole; repeated
rows, equal texts and null ids are documents like any other; pieces of equal length are packed in the
order of their number; an empty table gives an empty result; further columns, whatever their
names, are not read.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumenlake.llm.common import written


@dataclass(frozen=True)
class PackParams:
    length: int = 1_024
    end_id: int = 2
    part_pieces: int = 65_536
    fan: int = 16
    text_chars: int = 1 << 20  # longer texts are encoded in pieces of about so many characters


# ------------------------------------------------------------------ token ids

#: How a byte-level tokenizer splits text: a fixed part of the format.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BORDER = re.compile(r"(?<=[^\s])(?=[ \t\n\r])")
#: Longer runs of white space overflow the faster library's stack.
LONG_GAP = re.compile(r"\s{5000}")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Ids of texts by the tokenizer in a file."""

    def __init__(self, path: str, params: PackParams = PackParams()):
        import json

        from tokenizers import Tokenizer

        self.params, self.slow = params, Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = spec.get("normalizer") is None and spec.get("post_processor") is None and spec.get("truncation") is None
        byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
        self.fast = self._fast(model) if plain and byte_level and model.get("type") == "BPE" else None

    def _fast(self, model: dict):
        """The same merges in the faster library, if ids are the order of the merges."""
        import tiktoken

        letters = byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if all(c in letters for c in token)}
        merged = [(a + b) if isinstance(pair, list) else pair.replace(" ", "", 1) for pair in model["merges"] for a, b in [pair if isinstance(pair, list) else ("", "")]]
        ordered = [model["vocab"][m] for m in merged]
        if any(x >= y for x, y in zip(ordered, ordered[1:])) or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            return None
        return tiktoken.Encoding("merges", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        if self.fast is None or any(s in text for s in self.special) or (len(text) > 5_000 and LONG_GAP.search(text)):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        if len(text) <= self.params.text_chars:
            return np.array(self.fast.encode_ordinary(text), dtype=np.uint32)
        out, start = [], 0
        while start < len(text):
            cut = BORDER.search(text, start + self.params.text_chars)
            end = cut.start() if cut else len(text)
            out.append(np.array(self.fast.encode_ordinary(text[start:end]), dtype=np.uint32))
            start = end
        return np.concatenate(out)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file; the file is at the same place on every machine."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, path: str, params: PackParams = PackParams(), tokens: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document's pieces."""
    ids_field = [T.StructField("ids", T.ArrayType(T.LongType()))] if tokens else []
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("piece int, start bigint, length bigint, ids_crc32 bigint"), *ids_field])
    arrow = to_arrow_schema(schema)
    width = params.length

    def run(batches):
        import pyarrow as pa

        encode = encoder(path).ids
        for batch in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                of = np.append(encode(text.as_py() or ""), np.uint32(params.end_id)).astype("<u4")
                head = len(of) % width or width
                cuts = [0, *range(head, len(of) + 1, width)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(of[a:b].tobytes()))
                    if tokens:
                        ids.append(of[a:b].tolist())
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(ids, pa.list_(pa.int64()))] if tokens else [])], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


# ------------------------------------------------------------------ bounds and bins


def dual_bounds(count: np.ndarray, length: int) -> tuple[int, float]:
    """(bins that any packing needs, slack-free bins): the best dual-feasible function for counts by piece length.

    The functions: small pieces to nothing and large ones to a whole bin, for every threshold; and
    rounding (k + 1) x / length down to k-ths, for several k.  The sums are integers.
    """
    x = np.arange(len(count), dtype=np.int64)
    n = count.astype(object)
    best, part = 0, 0.0
    volume = np.concatenate([[0], np.cumsum([int(a) * int(c) for a, c in zip(x, count)])]) if len(count) else np.zeros(1)
    number = np.concatenate([[0], np.cumsum([int(c) for c in count])])
    for small in range(length // 2 + 1):
        large = length - small  # pieces above it count as a bin, pieces below ``small`` as nothing
        whole = int(number[-1] - number[min(large + 1, len(count))])
        middle = int(volume[min(large + 1, len(count))] - volume[min(small, len(count))])
        total = whole * length + middle
        best, part = max(best, -(-total // length)), max(part, total / length)
    for k in range(1, 33):
        scaled = (k + 1) * x
        weight = np.where(scaled % length == 0, x * k, scaled // length * length)
        total = int(sum(int(w) * int(c) for w, c in zip(weight, n)))
        best, part = max(best, -(-total // (k * length))), max(part, total / (k * length))
    return best, part


def best_fit_decreasing(lengths: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; pieces come in falling order and each goes where the least room is left."""
    bins = np.empty(len(lengths), dtype=np.int64)
    offsets = np.empty(len(lengths), dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(length + 1)]  # by room left
    rooms, used = 0, 0  # bit r: some bin has room r
    for i, size in enumerate(lengths.tolist()):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            which = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            room, which = length, used
            used += 1
        bins[i], offsets[i] = which, length - room
        if room > size:
            open_bins[room - size].append(which)
            rooms |= 1 << (room - size)
    return bins, offsets


def exchanged(lengths: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of pieces in falling order, where bins exchange pieces so that rooms are filled exactly.

    Each bin begins with the largest piece left.  Its room takes one piece that fills it, else two that do (the
    largest such first), else the largest that fits, and so on.
    """
    bins = np.empty(len(lengths), dtype=np.int64)
    offsets = np.empty(len(lengths), dtype=np.int64)
    left = np.bincount(lengths, minlength=length + 1).tolist()
    first = np.searchsorted(-lengths, -np.arange(length + 1)).tolist()  # the next piece of each length
    there = sum(1 << v for v, n in enumerate(left) if n)  # bit v: a piece of length v is left

    def place(v: int, which: int, room: int) -> int:
        nonlocal there
        bins[first[v]], offsets[first[v]] = which, length - room
        first[v] += 1
        left[v] -= 1
        if not left[v]:
            there &= ~(1 << v)
        return room - v

    used = 0
    while there:
        room = place(there.bit_length() - 1, used, length)
        while fitting := there & ((1 << (room + 1)) - 1):
            pair, rest = None, fitting
            while not fitting >> room & 1 and (a := rest.bit_length() - 1) * 2 >= room and a > 0:
                if left[room - a] > (room == 2 * a):
                    pair = a
                    break
                rest &= ~(1 << a)
            room = place(fitting.bit_length() - 1 if pair is None else pair, used, room)
        used += 1
    return bins, offsets


def repacked(lengths: np.ndarray, old: np.ndarray, at: np.ndarray, params: PackParams) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) by best-fit decreasing, with exchanges where that leaves a gap to the bound and they close some of it.

    As they were (bin names renumbered) if neither needs fewer bins.
    """
    bins, offsets = best_fit_decreasing(lengths, params.length)
    bound, _ = dual_bounds(np.bincount(lengths, minlength=params.length + 1), params.length)
    if bins.max(initial=-1) + 1 > bound:
        others = exchanged(lengths, params.length)
        if others[0].max(initial=-1) < bins.max(initial=-1):
            bins, offsets = others
    names, before = np.unique(old, return_inverse=True)
    if (old >= 0).all() and len(old) and len(names) <= bins.max(initial=-1) + 1:
        return before.reshape(-1), at
    return bins, offsets


def opened(bins: np.ndarray, lengths: np.ndarray, params: PackParams) -> np.ndarray:
    """Which pieces are in bins that are opened for an exchange: the emptiest bins of a partition with a gap."""
    count = int(bins.max(initial=-1)) + 1
    _, needed = dual_bounds(np.bincount(lengths, minlength=params.length + 1), params.length)
    if count - needed <= 1e-9:
        return np.zeros(len(bins), dtype=bool)
    fill = np.bincount(bins, weights=lengths, minlength=count)
    pieces = np.bincount(bins, minlength=count)
    order = np.lexsort((np.arange(count), fill))
    within = np.cumsum(pieces[order]) <= max(1, params.part_pieces // params.fan)
    within[:1] = True
    open_ = np.zeros(count, dtype=bool)
    open_[order[within & (fill[order] < params.length)]] = True
    return open_[bins]


PACKED = "part bigint, bin bigint, offset bigint, open boolean"


def pack_round(pieces: DataFrame, params: PackParams) -> DataFrame:
    """Pieces (with part, bin, offset: -1 at first) packed within their parts; ``open`` ones are for an exchange."""
    kept = [f for f in pieces.schema if f.name not in ("part", "bin", "offset")]
    schema = T.StructType([*kept, *T.StructType.fromDDL(PACKED)])
    arrow = to_arrow_schema(schema)

    def one(table):
        import pyarrow as pa

        table = table.sort_by([("length", "descending"), ("pid", "ascending")])
        lengths, old, at = (table.column(c).to_numpy() for c in ("length", "bin", "offset"))
        bins, offsets = repacked(lengths, old, at, params)
        columns = [table.column(f.name).combine_chunks() for f in kept]
        found = [table.column("part").combine_chunks(), pa.array(bins), pa.array(offsets.astype(np.int64)), pa.array(opened(bins, lengths, params))]
        return pa.Table.from_arrays([*columns, *found], schema=arrow)

    return pieces.groupBy("part").applyInArrow(one, schema)


def packed(pieces: DataFrame, params: PackParams = PackParams()) -> DataFrame:
    """``pieces`` (length and further columns) with ``sequence_id`` and ``offset``."""
    added = [c for c in pieces.columns]
    numbered = written(pieces.withColumn("pid", F.monotonically_increasing_id()), "pieces")  # writing fixes the numbers
    short = numbered.where(F.col("length") < params.length)
    sizes = short.groupBy("length").agg(F.count("*").alias("n")).collect()  # fewer rows than a sequence has tokens
    count = np.zeros(params.length + 1, dtype=np.int64)
    for r in sizes:
        count[r["length"]] = r.n
    bound, _ = dual_bounds(count, params.length)
    whole = numbered.where(F.col("length") >= params.length).select(*added, (-1 - F.col("pid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    parts = max(1, -(-int(count.sum()) // params.part_pieces))
    todo = short.withColumns({"part": F.pmod(F.xxhash64("pid"), F.lit(parts)).cast("long"), "bin": F.lit(-1).cast("long"), "offset": F.lit(-1).cast("long")})
    total, out, round_ = 0, whole, 0
    while True:
        done = written(pack_round(todo, params), "packed")
        sequence = (F.lit(round_).cast("long") * (1 << 57) + F.col("part") * (1 << 20) + F.col("bin")).alias("sequence_id")
        stay = lambda rows: rows.select(*added, sequence, "offset")  # noqa: E731,B023
        closed = done.where("NOT open").where("offset = 0").count()  # a bin has one piece at 0
        waiting = done.where("open").where("offset = 0").count()
        if parts == 1 or not waiting or total + closed + waiting <= bound:
            return out.unionByName(stay(done))
        out = out.unionByName(stay(done.where("NOT open")))
        total += closed
        bins = F.col("part") * (1 << 20) + F.col("bin")
        parts, round_ = -(-parts // params.fan), round_ + 1
        todo = done.where("open").drop("open").withColumns({"bin": bins, "part": F.floor(F.col("part") / params.fan).cast("long")})


def packed_documents(docs: DataFrame, path: str, params: PackParams = PackParams()) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) per piece of ``docs`` (doc_id, text)."""
    return packed(token_pieces(docs, path, params), params)


def sequences(docs: DataFrame, path: str, params: PackParams = PackParams()) -> DataFrame:
    """(sequence_id, ids, doc_ids, starts): the sequences themselves, ready for training; a row has ``length`` ids at most."""
    placed = packed(token_pieces(docs, path, params, tokens=True), params)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id", "start")))  # at most ``length`` pieces of a token
    return placed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.flatten(F.transform("p", lambda p: p["ids"])).alias("ids"),
        F.transform("p", lambda p: p["doc_id"]).alias("doc_ids"), F.transform("p", lambda p: p["start"]).alias("starts"),
    )
