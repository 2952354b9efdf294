"""Numeric kernels on decoded frames (RGB bytes), as Arrow-batched functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.functions.text import keep_first


def channel_ranges(size: int) -> list[tuple[int, int]]:
    """The parts of a vector that the three channels fill; what doesn't divide goes to the first."""
    spans = [size // 3 + (1 if c < size % 3 else 0) for c in range(3)]
    return [(sum(spans[:c]), spans[c]) for c in range(3)]


def unit(v: np.ndarray) -> np.ndarray:
    n = float(np.linalg.norm(v))
    return v / n if n else v


def color_vector(rgb: np.ndarray, size: int) -> np.ndarray:
    """Channel intensities dealt round a channel's part of the vector by pixel number, at length 1."""
    pixels = rgb.reshape(-1, 3).astype(np.float64) / 255.0
    out = np.zeros(size)
    index = np.arange(len(pixels))
    for c, (start, span) in enumerate(channel_ranges(size)):
        if span:
            out[start : start + span] = np.bincount(index % span, weights=pixels[:, c], minlength=span)
    return unit(out)


def motion_vector(frames: list[np.ndarray], delays: list[int], size: int, weight: float) -> np.ndarray:
    """Mean frame vector blended with that of absolute frame differences, both weighted by delay."""
    total = sum(max(d, 1) for d in delays) or 1
    content = unit(sum(color_vector(f, size) * (max(d, 1) / total) for f, d in zip(frames, delays)))
    if len(frames) < 2 or weight <= 0:
        return content
    moves = [
        (np.abs(b[: a.shape[0], : a.shape[1]].astype(int) - a[: b.shape[0], : b.shape[1]].astype(int)).astype(np.uint8), max(d, 1))
        for a, b, d in zip(frames, frames[1:], delays[1:])
    ]
    motion = unit(sum(color_vector(m, size) * d for m, d in moves))
    return unit((1 - min(max(weight, 0.0), 1.0)) * content + weight * motion)  # a weight over 1 counts as it is


def dct_hash(gray: np.ndarray, side: int = 32, kept: int = 8) -> str:
    """A 64-bit perceptual hash: low frequencies of a cosine transform against their median.

    Built from the published method; hashes of other programs differ.
    """
    rows = (np.arange(side) * gray.shape[0] // side).clip(0, gray.shape[0] - 1)
    cols = (np.arange(side) * gray.shape[1] // side).clip(0, gray.shape[1] - 1)
    small = gray[np.ix_(rows, cols)].astype(np.float64)
    basis = np.cos(np.pi * np.outer(np.arange(kept), 2 * np.arange(side) + 1) / (2 * side))
    low = (basis @ small @ basis.T).ravel()
    bits = low > np.median(low[1:])
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


def with_color_vectors(images: DataFrame, size: int, data: str = "data", name: str = "visual") -> DataFrame:
    @F.pandas_udf("array<float>")
    def kernel(frames: pd.Series) -> pd.Series:
        return frames.map(lambda b: None if b is None else color_vector(np.frombuffer(b, np.uint8), size).astype(np.float32).tolist())

    return images.withColumn(name, kernel(data))


def with_hashes(images: DataFrame) -> DataFrame:
    """``images`` (data, width, height) with a perceptual hash; null where the bytes are not those of width x height pixels."""

    @F.pandas_udf("string")
    def kernel(data: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
        def one(b, w, h):
            if b is None or pd.isna(w) or pd.isna(h) or min(w, h) < 1 or len(b) != w * h * 3:
                return None
            w, h = int(w), int(h)
            rgb = np.frombuffer(b, np.uint8).reshape(h, w, 3)
            return dct_hash(rgb @ np.array([0.299, 0.587, 0.114]))

        return pd.Series([one(b, w, h) for b, w, h in zip(data, width, height)])

    return images.withColumn("phash", kernel("data", "width", "height"))


def speech_spans(samples: DataFrame, rate: int = 16_000, level: float = 0.01, least: float = 0.12, gap: float = 0.08) -> DataFrame:
    """(media_id, start_seconds, end_seconds) of runs of loud frames in ``samples`` (media_id, samples)."""
    frame, hop = int(0.03 * rate), int(0.01 * rate)

    def run(batches):
        for pdf in batches:
            rows = []
            for media_id, wave in zip(pdf["media_id"], pdf["samples"]):
                x = np.concatenate([[0.0], np.cumsum(np.square(np.asarray(wave, dtype=np.float64)))])
                starts = np.arange(0, max(len(x) - 1 - frame, 0) + 1, hop)
                ends = np.minimum(starts + frame, len(x) - 1)
                loud = np.sqrt((x[ends] - x[starts]) / frame) >= level
                edges = np.diff(np.concatenate([[False], loud, [False]]).astype(int))
                spans = [[starts[a] / rate, ends[b - 1] / rate] for a, b in zip(np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0])]
                joined: list[list[float]] = []
                for s in spans:
                    if joined and s[0] - joined[-1][1] <= gap:
                        joined[-1][1] = s[1]
                    else:
                        joined.append(s)
                rows += [(media_id, a, b) for a, b in joined if b - a >= least]
            yield pd.DataFrame(rows, columns=["media_id", "start_seconds", "end_seconds"])

    kind = dict(samples.dtypes)["media_id"]
    return samples.select("media_id", "samples").mapInPandas(run, f"media_id {kind}, start_seconds double, end_seconds double")


def onset_times(wave: np.ndarray, rate: int, strength: float = 0.03, apart: float = 0.08) -> list[float]:
    """Seconds at which loudness rises: peaks of the rise of the frames' level over ``strength``, ``apart`` seconds from the last."""
    frame, hop = max(rate // 20, 1), max(rate // 100, 1)
    x = np.concatenate([[0.0], np.cumsum(np.square(np.asarray(wave, dtype=np.float64)))])
    starts = np.arange(0, max(len(x) - 1 - frame, 0) + 1, hop)
    level = np.sqrt((x[np.minimum(starts + frame, len(x) - 1)] - x[starts]) / frame)
    rise = np.maximum(np.diff(level, prepend=0.0), 0.0)
    after = np.append(rise[1:], 0.0)
    before = np.append(0.0, rise[:-1])
    out: list[float] = []
    for k in np.nonzero((rise >= strength) & (rise >= after) & (rise > before))[0]:
        at = float(starts[k] / rate)
        if not out or at - out[-1] >= apart:
            out.append(at)
    return out


def tempo_of(onsets: list[float]) -> tuple[float | None, float]:
    """Beats a minute by the median interval, halved or doubled into 60 to 180, with one decimal; and the share of intervals near it."""
    gaps = np.diff(onsets)
    if len(gaps) < 2:
        return None, 0.0
    beat = float(np.median(gaps))
    near = float((np.abs(gaps - beat) <= 0.15 * beat).mean())
    while 60.0 / beat > 180:
        beat *= 2
    while 60.0 / beat < 60:
        beat /= 2
    return round(60.0 / beat, 1), near


def with_tempo(samples: DataFrame, rate: int = 16_000) -> DataFrame:
    """(media_id, onsets, tempo_bpm, tempo_confidence, tempo_onset_count) of ``samples`` (media_id, samples).

    Built from the published idea of energy onsets; figures of other programs differ.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for media_id, wave in zip(pdf["media_id"], pdf["samples"]):
                onsets = onset_times(wave, rate) if wave is not None else []
                rows.append((media_id, onsets, *tempo_of(onsets), len(onsets)))
            yield pd.DataFrame(rows, columns=["media_id", "onsets", "tempo_bpm", "tempo_confidence", "tempo_onset_count"])

    kind = dict(samples.dtypes)["media_id"]
    return samples.select("media_id", "samples").mapInPandas(run, f"media_id {kind}, onsets array<double>, tempo_bpm double, tempo_confidence double, tempo_onset_count int")


#: Fixed order: earlier namespaces win, but coordinates come from xmp first.
METADATA_PRIORITY = {"exif": 0, "iptc": 1, "xmp": 2}


def first_metadata(raw: DataFrame) -> DataFrame:
    """(media_id, key, value): of each key the first non-blank value by namespace.

    ``raw`` is (media_id, namespace, key, value).
    """
    order = F.coalesce(*[F.when(F.lower("namespace") == k, F.lit(v)) for k, v in METADATA_PRIORITY.items()], F.lit(9))
    gps = F.startswith(F.lower("key"), F.lit("gps"))
    rank = F.when(gps & (F.lower("namespace") == "xmp"), F.lit(-1)).otherwise(order)
    clean = raw.where(F.trim("value") != "").withColumn("_rank", rank)
    return clean.groupBy("media_id", F.lower("key").alias("key")).agg(F.min_by("value", F.struct("_rank", "value")).alias("value"))


def collected_keywords(raw: DataFrame) -> DataFrame:
    """(media_id, keywords): distinct by case, in order of place."""
    return raw.groupBy("media_id").agg(
        keep_first(F.transform(F.sort_array(F.collect_list(F.struct("place", "keyword"))), lambda x: x["keyword"])).alias("keywords")
    )
