"""Quality scores from random Fourier features.

Statistics of each text (shares of byte classes, word and line repetition, lengths)
are standardised and mapped to cosine features that approximate a Gaussian kernel
(Rahimi and Recht).  Every task sums its part of the normal equations; the sums meet
in a tree, and the driver solves one ridge system of FEATURES + 1 unknowns.  Isotonic
regression over BINS bins of the raw scores of a fifth of the labelled rows, which the system has not seen, turns them into shares of label 1.

Defined cases: a null or empty text has statistics of 0 and is scored like any other; rows
whose label is null, or whose doc_id is null, teach nothing; if several labels share
a doc_id each teaches once per document row; without any label, or with labels of one kind only, every score is
that kind's share (0.5 without any); repeated rows are scored row by row; other columns play no part.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, chunks, cut, held_out, merged, read

FEATURES = 256
RIDGE = 1e-3
BINS = 2048
SEED = 20240229

_CLASSES = np.zeros((7, 256), np.float64)
for _b in range(256):
    _CLASSES[0 if 0x61 <= _b <= 0x7A else 1 if 0x41 <= _b <= 0x5A else 2 if 0x30 <= _b <= 0x39 else 3 if _b in (32, 9, 10, 11, 12, 13) else 4 if 0x80 <= _b < 0xC0 else 5 if _b >= 0xC0 else 6, _b] = 1
_MARKS = [ord(c) for c in ".,!?#$%*@<>/=|{}_"]
STATISTICS = 6 + 7 + len(_MARKS) + 9
#: The kernel's width: two rows of standardised statistics are the square root of twice their number apart, on average.
WIDTH = (2 * STATISTICS) ** 0.5 / 2
#: A row of so many labelled ones calibrates, and does not fit.
FOLDS = 5


def statistics(text: bytes | None) -> np.ndarray:
    """The numbers that stand for a text."""
    out = np.zeros(STATISTICS)
    if not text:
        return out
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256).astype(np.float64)
    n = len(text)
    words = text.lower().split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    distinct = Counter(words)
    n_words, n_lines = max(1, len(words)), max(1, len(lines))
    share = counts[counts > 0] / n
    top = distinct.most_common(10)
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    out[:6] = (np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), sizes.mean(), sizes.std(), np.log1p(sizes.max()))
    out[6:13] = _CLASSES @ counts / n
    out[13 : 13 + len(_MARKS)] = np.sqrt(counts[_MARKS] / n_words)
    out[13 + len(_MARKS) :] = (
        len(distinct) / n_words,
        len(distinct) / n_words**0.7,
        (top[0][1] / n_words) if top else 0,
        sum(c for _, c in top) / n_words,
        len(set(lines)) / n_lines,
        max(Counter(lines).values()) / n_lines if lines else 0,
        -(share * np.log2(share)).sum(),
        sum(1 for a, b in zip(words, words[1:], strict=False) if a == b) / n_words,
        n / n_lines / 1000,
    )
    return out


def document_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, x``; the one pass over the texts."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                x = [statistics(t) for t in bytes_of(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(measure, "doc_id long, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), STATISTICS)


class Fourier:
    """Standardised statistics to cosine features, and a constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray) -> None:
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.turn = rng.normal(size=(STATISTICS, FEATURES)) / WIDTH
        self.shift = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.turn + self.shift
        return np.concatenate([np.cos(z) * np.sqrt(2 / FEATURES), np.ones((len(x), 1))], axis=1)


def _summed(df: DataFrame, part: object) -> object:
    """Sums what ``part(x, y)`` gives (a tuple of arrays) over all rows ``x, y``, by task and then in a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if len(b):
                got = part(_matrix(b.column(0)), np.asarray(b.column(1), np.float64))
                total = got if total is None else tuple(p + q for p, q in zip(total, got, strict=True))
        if total is not None:
            yield pa.RecordBatch.from_pydict({"blob": pa.array([pickle.dumps(total)], pa.binary())})

    def add(blobs: list[bytes]) -> bytes:
        a, b = map(pickle.loads, blobs)
        return pickle.dumps(tuple(p + q for p, q in zip(a, b, strict=True)))

    blob = merged(df.select("x", "y").mapInArrow(run, "blob binary"), add)
    return None if blob is None else pickle.loads(blob)


def isotonic(ones: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Shares of ones that never fall from bin to bin (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for one, n in zip(ones.tolist(), rows.tolist(), strict=True):
        blocks.append([one, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            one, n, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + one, blocks[-1][1] + n, blocks[-1][2] + k]
    return np.concatenate([np.full(int(k), one / n if n else 0.5) for one, n, k in blocks])


class Scorer:
    """Raw ridge scores, bent to calibrated shares between the bins' middles."""

    def __init__(self, fourier: Fourier | None, weights: np.ndarray | None, curve: np.ndarray | None, share: float) -> None:
        self.fourier, self.weights, self.curve, self.share = fourier, weights, curve, share

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.fourier(x) @ self.weights, -0.5, 1.5)

    @staticmethod
    def bins(raw: np.ndarray) -> np.ndarray:
        return np.minimum(((raw + 0.5) / 2 * BINS).astype(int), BINS - 1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.fourier is None:
            return np.full(len(x), self.share)
        raw = self.raw(x)
        middles = (np.arange(BINS) + 0.5) / BINS * 2 - 0.5
        # a little of the raw score keeps the order inside a level stretch
        return np.clip(np.interp(raw, middles, self.curve), 0, 1) * 0.999 + (raw + 0.5) / 2 * 0.001


def fit(labelled: DataFrame) -> Scorer:
    """Fits on all rows ``id, x, y``: three sums over them, each of a fixed size.  The calibrating fold goes by the id's hash; where it or the rest is empty, all rows do both."""
    labelled = cut(labelled)
    calibrates = F.pmod(F.xxhash64("id"), F.lit(FOLDS)) == 0
    fitting, calibrating = labelled.where(~calibrates), labelled.where(calibrates)
    if fitting.isEmpty() or calibrating.isEmpty():
        fitting = calibrating = labelled
    got = _summed(labelled, lambda x, y: (x.sum(0), (x**2).sum(0), np.array([len(y), y.sum()])))
    if got is None:
        return Scorer(None, None, None, 0.5)
    s1, s2, (n, ones) = got
    if not 0 < ones < n:
        return Scorer(None, None, None, float(ones / n))
    scale = np.sqrt(np.maximum(s2 / n - (s1 / n) ** 2, 0))
    fourier = Fourier(s1 / n, np.where(scale > 1e-9, scale, 1.0))

    def equations(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = fourier(x)
        return z.T @ z, z.T @ y

    a, b = _summed(fitting, equations)
    scorer = Scorer(fourier, np.linalg.solve(a + RIDGE * a[-1, -1] * np.eye(len(a)) / FEATURES, b), None, 0.5)

    def histogram(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = scorer.bins(scorer.raw(x))
        return np.bincount(at, y, BINS), np.bincount(at, minlength=BINS).astype(float)

    one, rows = _summed(calibrating, histogram)
    seen = np.flatnonzero(rows)
    middles = (np.arange(BINS) + 0.5) / BINS * 2 - 0.5
    scorer.curve = np.interp(middles, middles[seen], isotonic(one[seen], rows[seen]))
    return scorer


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, score``: learned from the labelled rows outside the held-out third, given to every row."""
    measured = cut(document_statistics(docs))
    y = labels.where("quality is not null").select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("y"))
    train = measured.where(~held_out(F.col("doc_id"), 3, 1)).join(y, F.col("doc_id") == F.col("_id")).select(F.col("_id").alias("id"), "x", "y")
    held = docs.sparkSession.sparkContext.broadcast(fit(train))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = held.value(_matrix(b.column(1))) if len(b) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return measured.mapInArrow(score, "doc_id long, score double")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_scores(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "quality"))
    return found.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op4_quality_classifier": op4_quality_classifier}
ORACLE_SQL: dict[str, str] = {}
