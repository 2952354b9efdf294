"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text whole, one on those parts of toxic text
that set it off (words that are ``contrast`` times as frequent in toxic rows; whole toxic text gives
a dictionary that is mostly ordinary prose, and half the recall: the README has figures).  Every
word of a text is a window (framed by a constant run, so that short words still form a
compressible block).  A window's code lengths under the two dictionaries give its cell
in a table of calibrated log ratios; a text's evidence is the sum over its distinct
windows, and a logistic curve fitted on labelled rows outside the dictionaries' sample
turns evidence into a score.

Results in the edge cases: a null or empty text, or one without words, has no windows and
gets the score of zero evidence; very long texts are read whole; repeated rows and ties are scored
alike; a labelled row whose text shares half of a sketch of its shingles with one row of its label that is in
use is not used for fitting; of an id's repeated labels the highest counts, and of its several texts the one
that is first in order fits (all are scored); an empty table gives an empty result; other columns of the input are not read.  If the labelled rows lack one of
the classes there is no model and every score is 0.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import digest_of

FRAME = b" " * 24
WORD_BYTES = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else 32 for b in range(256))
CELLS = 24  # code lengths from this on share a cell
CACHE_WINDOWS = 300_000  # per worker: windows whose cell is remembered; results don't depend on it


@dataclass(frozen=True)
class ToxicityParams:
    """Bounds of the fitting sample, sizes of the dictionaries, and the decision threshold."""

    sample_per_class: int = 3_000
    sample_text_bytes: int = 32_768  # longer rows are not used for fitting (they are scored)
    ordinary_dictionary: int = 110 * 1024
    toxic_dictionary: int = 4_096
    contrast: float = 50.0  # a toxic training window is this many times as frequent in toxic rows
    least_share: float = 0.01  # and occurs in this share of them
    least_evidence: float = 0.5  # log ratios below this are noise
    level: int = 19
    threshold: float = 0.7


@dataclass(frozen=True)
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    log_ratio: np.ndarray
    weights: tuple[float, float]
    level: int
    key: str = field(default="")


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(WORD_BYTES).split()


def _compressor(dictionary: bytes, level: int):
    import zstandard as zs

    p = zs.ZstdCompressionParameters.from_level(
        level, format=zs.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0
    )
    d = zs.ZstdCompressionDict(dictionary)
    d.precompute_compress(compression_params=p)
    return zs.ZstdCompressor(dict_data=d, compression_params=p).compress


class _Scorer:
    def __init__(self, model: ToxicityModel):
        self.model = model
        self.ordinary = _compressor(model.ordinary, model.level)
        self.toxic = _compressor(model.toxic, model.level)
        self.cells: dict[bytes, int] = {}

    def cell(self, word: bytes) -> int:
        known = self.cells.get(word)
        if known is None:
            window = FRAME + word + b" "
            known = min(len(self.ordinary(window)), CELLS - 1) * CELLS + min(len(self.toxic(window)), CELLS - 1)
            if len(self.cells) >= CACHE_WINDOWS:
                self.cells.clear()
            if len(word) <= 64:
                self.cells[word] = known
        return known

    def evidence(self, text: bytes | None) -> float:
        distinct = set(words_of(text or b""))
        if not distinct:
            return 0.0
        table = self.model.log_ratio
        return math.fsum(table[self.cell(w)] for w in distinct)

    def score(self, text: bytes | None) -> float:
        a, b = self.model.weights
        z = a + b * self.evidence(text)
        return 1.0 / (1.0 + math.exp(-min(max(z, -500.0), 500.0)))


_scorers: dict[str, _Scorer] = {}


def scorer(model: ToxicityModel) -> _Scorer:
    """One scorer per worker process and model."""
    if model.key not in _scorers:
        _scorers.clear()
        _scorers[model.key] = _Scorer(model)
    return _scorers[model.key]


def _train_dictionary(words: list[bytes], size: int, k: int) -> bytes:
    import zstandard as zs

    samples = [b" " + b" ".join(words[i : i + 8]) + b" " for i in range(0, len(words), 8)]
    try:
        return zs.train_dictionary(size, samples, k=k, d=6).as_bytes()
    except zs.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"".join(samples)[-size:]


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Maximum-likelihood line for one feature, slope at least 0, by Newton steps from slope 0."""
    scale = max(float(np.abs(x).max()), 1e-9)
    X = np.stack([np.ones_like(x), x / scale], axis=1)
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    w = np.array([math.log(share / (1 - share)), 0.0])
    pull = np.diag([0.0, 1e-3])
    for _ in range(100):
        p = 1.0 / (1.0 + np.exp(-np.clip(X @ w, -30, 30)))
        g = X.T @ (y - p) - pull @ w
        h = (X * np.maximum(p * (1 - p), 1e-4)[:, None]).T @ X + pull
        step = np.linalg.solve(h, g)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(max(w[1] / scale, 0.0))


def fit(rows: list[tuple[str, int]], params: ToxicityParams = ToxicityParams()) -> ToxicityModel | None:
    """Fit on (text, label) rows; of copies and near copies with one label the first counts."""
    docs: list[tuple[list[bytes], int]] = []
    with_mark: dict[tuple[int, int], list[int]] = {}  # rows in use, by label and mark
    for text, label in rows:
        words = words_of((text or "").encode("utf-8", "replace"))
        marks = sketch(words)
        shared = Counter(i for m in marks for i in with_mark.get((label, m), ()))
        if words and 2 * max(shared.values(), default=0) < len(marks):  # copies would count as independent evidence
            for m in marks:
                with_mark.setdefault((label, m), []).append(len(docs))
            docs.append((words, label))
    by_class = [[w for w, y in docs if y == c] for c in (0, 1)]
    if min(map(len, by_class)) < 2:
        return None
    # two thirds train the dictionaries, one third calibrates
    (ord_a, ord_b), (tox_a, tox_b) = (([w for i, w in enumerate(d) if i % 3], d[0::3]) for d in by_class)
    df_tox, df_ord = (Counter(w for d in part for w in set(d)) for part in (tox_a, ord_a))
    least = max(2 if len(tox_a) < 100 else 3, params.least_share * len(tox_a))
    rate = lambda w: (df_tox[w] / len(tox_a)) / ((df_ord[w] + 0.5) / len(ord_a))
    telling = {w for w, n in df_tox.items() if n >= least and rate(w) >= params.contrast}
    if not telling:
        telling = {w for w in df_tox if rate(w) > 1} or set(df_tox)
    ordinary = _train_dictionary([w for d in ord_a for w in d], params.ordinary_dictionary, 64)
    toxic = _train_dictionary([w for d in tox_a for w in d if w in telling], params.toxic_dictionary, 24)
    draft = ToxicityModel(ordinary, toxic, np.zeros(CELLS * CELLS), (0.0, 1.0), params.level)
    s = _Scorer(draft)

    def cells(part: list[list[bytes]]) -> np.ndarray:
        return np.array([np.bincount([s.cell(w) for w in set(d)], minlength=CELLS * CELLS) for d in part], dtype=float)

    c_tox, c_ord = cells(tox_b), cells(ord_b)
    n_tox, n_ord = c_tox.sum(axis=0), c_ord.sum(axis=0)
    # a cell is evidence by as much as its log ratio of rates exceeds the ratio's own standard error
    rate_tox, rate_ord = (n_tox + 0.5) / (n_tox.sum() + 1.0), (n_ord + 0.5) / (n_ord.sum() + 1.0)
    error = np.sqrt(1.0 / (n_tox + 0.5) + 1.0 / (n_ord + 0.5))
    raw = np.log(rate_tox / rate_ord)
    log_ratio = np.where(n_tox + n_ord > 0, np.sign(raw) * np.maximum(np.abs(raw) - error, 0.0), 0.0)
    log_ratio[np.abs(log_ratio) < params.least_evidence] = 0.0
    x = np.concatenate([c_tox @ log_ratio, c_ord @ log_ratio])
    y = np.concatenate([np.ones(len(c_tox)), np.zeros(len(c_ord))])
    key = digest_of(ordinary, toxic, log_ratio.tobytes())
    return ToxicityModel(ordinary, toxic, log_ratio, _logistic(x, y), params.level, key)


def sketch(words: list[bytes], size: int = 8) -> set[int]:
    """The smallest checksums of a whole text's five-word shingles: near copies share most of them."""
    shingles = {zlib.crc32(b" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))}
    return set(heapq.nsmallest(size, shingles)) if words else set()


def labelled_sample(docs: DataFrame, labels: DataFrame, params: ToxicityParams) -> list[tuple[str, int]]:
    """At most ``sample_per_class`` labelled training rows of each class.

    The ids are drawn from the labels alone, by hash, so the documents are read once with a
    join whose small side is bounded by that parameter.  Rows of the held-out fold
    (crc32 of the id as text, modulo 3, is 1) never enter.
    """
    chosen = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    parts = [
        chosen.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(params.sample_per_class)
        for c in (0, 1)
    ]
    ids = F.broadcast(parts[0].unionByName(parts[1]))
    rows = (
        docs.select("doc_id", "text")
        .where(F.octet_length("text") <= params.sample_text_bytes)
        .join(ids, "doc_id")
        .groupBy("doc_id", "toxic")
        .agg(F.min("text").alias("text"))
        .select("doc_id", "text", "toxic")
        .collect()  # bounded: 2 x sample_per_class rows of at most sample_text_bytes
    )
    return [(r.text, r.toxic) for r in sorted(rows, key=lambda r: r.doc_id)]


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score_texts(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """(doc_id, score) for every row: the whole text is read, in one pass without a shuffle."""
    rows = docs.select("doc_id", "text")
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"))

    def run(batches):
        import pyarrow as pa

        s = scorer(model)
        for batch in batches:
            text = batch.column("text").cast(pa.large_binary())
            scores = [s.score(t.as_py()) for t in text]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"]
            )

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, score double")


def score_documents(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """Fit on the labelled training rows of ``docs`` and score all rows."""
    scored = score_texts(docs, fit(labelled_sample(docs, labels, params), params))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= params.threshold).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """The rows of ``docs`` whose text scores below the threshold, with all their columns.

    Scoring runs inside the pass that copies the rows, so nothing is joined back.
    """
    model = fit(labelled_sample(docs, labels, params), params)
    if model is None:
        return docs
    threshold = params.threshold

    def run(batches):
        import pyarrow as pa

        s = scorer(model)
        for batch in batches:
            text = batch.column("text").cast(pa.large_binary())
            yield batch.filter(pa.array([s.score(t.as_py()) < threshold for t in text], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
