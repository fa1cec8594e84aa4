"""Whitening of embeddings by merged covariances.

Vectors become whole numbers (``floor(64 c) + 1000000``), each distinct one is fitted once.
Every partition computes the count, the exact sums and the scatter around its own mean
of its vectors; two of these merge by Chan's formula, in a tree.  The driver holds one such matrix
and takes its eigenvectors.  A second pass over the fit list computes the covariance of the
whitened vectors in the same way, and so tells how far it is from the identity.

Sums are exact (whole numbers that grow beyond 64 bits where they must), and every row is
centred as ``n x - S`` before anything is multiplied, so nothing is lost to the size of the offset.

Defined cases: rows whose vector is null or holds null or non-finite entries have no result;
where vectors differ in length, those of the most common length (of the longest of equally common
ones) are whitened and the others have no result; an entry whose whole number lies beyond 2**52 leaves its row without one too; components whose variance is no more than
the rounding of the largest one's (all of them for a single vector) have null ``whitened``, and the error is that of
the others (null if there is none); ``explained`` is null where there is no variance; a ``deviation`` that no long holds is null; repeated rows and null ids have
their rows; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_dir, merged, read

#: Steps of an entry's whole number, and what is added to it.
STEPS, SHIFT = 64, 1_000_000
#: Components that are returned, at most.
COMPONENTS = 16
#: Whole numbers beyond this are not taken, so that doubles hold them.
LARGEST = 1 << 52
#: Vectors that a task turns into a matrix at a time.
ROWS = 4096


def whole(embedding: Column) -> Column:
    """The whole numbers of a vector; null if an entry has none."""
    x = F.transform(embedding, lambda c: F.floor(c.cast("double") * STEPS) + SHIFT)
    sound = F.forall(embedding, lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST / STEPS, F.lit(False)) & ~F.isnan(c))
    return F.when(embedding.isNotNull() & sound, x)


def vectors(df: DataFrame, name: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``vec_id, x`` of the rows that take part."""
    found = df.select(F.col(key).alias("vec_id"), whole(F.col(name)).alias("x")).where("x is not null")
    lengths = found.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    common = lengths.agg(F.max(F.struct("n", "d"))["d"]).first()[0]
    return found.where(F.size("x") == F.lit(common if common is not None else 0))


def distinct_vectors(found: DataFrame) -> DataFrame:
    """The fit list: each distinct vector once, written to the shared folder, as two passes read it."""
    spark = found.sparkSession
    folder = f"{checkpoint_dir(spark)}/fit-{uuid.uuid4().hex}"
    found.groupBy("x").agg(F.lit(1)).select("x").write.parquet(folder)
    return spark.read.parquet(folder)


def matrices(batches: Iterator[pa.RecordBatch], column: str = "x") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of batches and their vectors, a row each."""
    for batch in batches:
        for k in range(0, len(batch), ROWS):
            part = batch.slice(k, ROWS)
            yield part, np.asarray(part.column(part.schema.get_field_index(column)).flatten()).reshape(len(part), -1)


@dataclass
class Moments:
    """Count, exact sums and centred scatter of whole or real vectors."""

    n: int
    sums: np.ndarray  # of Python's whole numbers, or doubles
    scatter: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        # sums of so few whole numbers below 2**52 stay below 2**64, and the sums of their high and low halves are exact
        sums = (x >> 26).sum(0).astype(object) * (1 << 26) + (x & ((1 << 26) - 1)).sum(0).astype(object) if x.dtype.kind == "i" else x.sum(0)
        middle = (sums // len(x)).astype(np.int64) if x.dtype.kind == "i" else 0.0
        near = (x - middle).astype(np.float64)
        near -= near.mean(0)
        return cls(len(x), sums, near.T @ near)

    def __add__(self, other: Moments) -> Moments:
        """Chan's merge: the scatters, and that of the two means."""
        n = self.n + other.n
        apart = (self.sums * other.n - other.sums * self.n).astype(np.float64) / self.n / other.n  # of whole numbers: exact before it is rounded
        return Moments(n, self.sums + other.sums, self.scatter + other.scatter + np.outer(apart, apart) * (self.n / n * other.n))


def moments(df: DataFrame, turned: object = None) -> Moments | None:
    """Moments of all vectors ``x`` (or of what ``turned`` makes of them), by partition and then in a tree."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in matrices(batches):
            part = Moments.of(x if turned is None else turned(x))
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"blob": pa.array([pickle.dumps(total)], pa.binary())})

    blob = merged(df.select("x").mapInArrow(local, "blob binary"), lambda two: pickle.dumps(pickle.loads(two[0]) + pickle.loads(two[1])))
    return None if blob is None else pickle.loads(blob)


class Whitening:
    """Components of a covariance by falling variance, and what they make of vectors."""

    def __init__(self, m: Moments, components: int) -> None:
        e, v = np.linalg.eigh(m.scatter / m.n)
        e, v = e[::-1], v[:, ::-1]
        k = min(components, len(e))
        self.n, self.sums, self.variance, self.total = m.n, m.sums, e[:k], float(np.trace(m.scatter / m.n))
        sound = e[:k] > max(float(e[0]), 0.0) * len(e) * np.finfo(float).eps
        self.sound = sound
        self.turn = np.where(sound, v[:, :k] / np.sqrt(np.where(sound, e[:k], 1.0)), np.nan)
        self.explained = [float(x) / self.total if self.total > 0 else None for x in e[:k]]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``n x - S`` as whole numbers, of 64 bits where they fit."""
        most = self.n * max(abs(int(x.max())), abs(int(x.min())), 1) + max(abs(int(s)) for s in self.sums)
        kind = np.int64 if most < 1 << 62 else object
        return x.astype(kind) * self.n - self.sums.astype(kind)

    def white(self, x: np.ndarray) -> np.ndarray:
        return self._turned(self.centred(x))

    def _turned(self, c: np.ndarray) -> np.ndarray:
        return c.astype(np.float64) / self.n @ self.turn

    def both(self, x: np.ndarray) -> tuple[list[int | None], np.ndarray]:
        """Deviations and whitened vectors."""
        c = self.centred(x)
        most = max(abs(int(c.max())), abs(int(c.min())))
        if c.dtype.kind == "i" and most**2 * c.shape[1] < 1 << 63:
            return (c * c).sum(1).tolist(), self._turned(c)
        exact = [sum(int(y) ** 2 for y in row) for row in c]
        return [y if y < 1 << 63 else None for y in exact], self._turned(c)


def whitened(df: DataFrame, name: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, n, deviation, whitened, explained, identity_error`` of every vector that takes part; an array entry a component."""
    schema = "vec_id long, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    found = vectors(df, name, key)
    fit = distinct_vectors(found)
    m = moments(fit)
    if m is None or not len(m.sums):
        return df.sparkSession.createDataFrame([], schema)
    w = Whitening(m, components)
    error = None
    if w.sound.any():
        again = moments(fit, lambda x: w.white(x)[:, w.sound])
        error = float(np.abs(again.scatter / again.n - np.eye(int(w.sound.sum()))).max())
    held = df.sparkSession.sparkContext.broadcast(w)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in matrices(batches):
            t, rows = held.value, len(part)
            deviation, z = t.both(x)
            made = pa.array([[y if s else None for y, s in zip(row, t.sound.tolist(), strict=True)] for row in z.tolist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([t.n] * rows, pa.int64()), pa.array(deviation, pa.int64()), made, pa.array([t.explained] * rows, pa.list_(pa.float64())), pa.array([error] * rows, pa.float64())],
                names=[x.split()[0] for x in schema.split(", ")],
            )

    return found.mapInArrow(apply, schema)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitened(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    pair = F.arrays_zip("whitened", "explained")
    return found.select("vec_id", "n", "deviation", "identity_error", F.posexplode(pair).alias("at", "pair")).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("pair.whitened").alias("whitened"), F.col("pair.explained").alias("explained"), "identity_error"
    )


QUERIES = {"op13_embedding_whitening": op13_embedding_whitening}
ORACLE_SQL: dict[str, str] = {}
