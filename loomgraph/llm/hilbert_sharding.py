"""Sharding along a Hilbert curve.

Source, language and size are each quantised to ``2**bits`` cells, in the order of their values: a name's cell
is its rank among the distinct names where they are few, else that among names at equal distances in their order.  Rows are sorted
by their cell's place on the Hilbert curve, and the order is cut into runs.  Rows
that are near in all dimensions meet in the same run, so the files' minima and
maxima prune in every dimension at once.

The one law that holds is ``bytes`` (or ``rows``): it cuts groups of equal texts where a run ends, and equal texts of different
source or language lie apart; equal texts of one cell follow one another, as ties fall by the texts' hash.

Defined cases: a null source, language or text takes cell 0 of its dimension; an
empty or null text has size 1; ties on the curve fall by text hash, then doc_id
(nulls first); repeated rows each take a slot of their own; an empty table gives an
empty result; other columns play no part and may have any name (``shard`` and ``curve_index`` are
replaced by those of :func:`shard_documents`).
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read

BITS = 8
SHARDS = 16


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the curve of points of shape (n, d): Gray-code unrolling of the axes (Skilling, 2004)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for axis in range(dims):
            inside = (x[axis] >> level & 1).astype(bool)
            swap = (x[0] ^ x[axis]) & low
            x[0] = np.where(inside, x[0] ^ low, x[0] ^ swap)
            if axis:
                x[axis] = np.where(inside, x[axis], x[axis] ^ swap)
    for axis in range(1, dims):
        x[axis] ^= x[axis - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where(x[-1] >> level & 1, turn ^ ((1 << level) - 1), turn)
    x ^= turn
    place = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in range(dims):
            place = place << 1 | (x[axis] >> level & 1)
    return place


#: Distinct names that the driver ranks, at most; of more it ranks about 2**bits at equal distances.
NAMES = 1 << 16


def cell_bounds(docs: DataFrame, column: str, bits: int = BITS) -> list[str]:
    """Sorted names at which the cells of a column begin: all distinct ones, or as many as there are cells, in their order."""
    cells = (1 << bits) - 1
    names = docs.select(F.col(column).cast("string").alias("name")).where("name is not null").distinct()
    few = sorted((r.name for r in names.limit(NAMES + 1).collect()), key=str.encode)
    if len(few) <= NAMES:
        step = -(-len(few) // cells) if few else 1
        return few[::step]
    dealt = cut(names.repartitionByRange("name").sortWithinPartitions("name"))
    total = dealt.count()
    parts = dealt.rdd.getNumPartitions()
    step = max(1, total // max(1, cells - parts))

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for b in batches:
            yield b.take(pa.array(range(-at % step, len(b), step), pa.int64()))
            at += len(b)

    return sorted((r.name for r in dealt.mapInArrow(every, "name string").collect()), key=str.encode)[:cells]


def category_cells(names: pd.Series, bounds: list[bytes], bits: int) -> np.ndarray:
    """Cells of names: 0 for null, else by the number of bounds up to the name, spread over all cells, so that few names part the curve first; each distinct name is looked up once."""
    codes, distinct = pd.factorize(names)
    last = (1 << bits) - 1
    cells = np.array([0 if x is None else bisect_right(bounds, x.encode()) * last // len(bounds) for x in distinct] + [0], np.int64)
    return cells[codes]


def size_cell(size: Column, bits: int) -> Column:
    """Logarithmic cells, twelve for each doubling."""
    return F.least(F.floor(F.log2(size.cast("double")) * 12), F.lit((1 << bits) - 1)).cast("int")


def keyed(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Adds the size, the place on the curve and the tie-breaking hash; the text itself stays in the JVM."""

    bounds = [[x.encode() for x in cell_bounds(docs, c, bits)] for c in ("source", "lang")]

    @F.pandas_udf("long")
    def place(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([category_cells(a, bounds[0], bits), category_cells(b, bounds[1], bits), c], axis=1), bits))

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    df = docs.withColumns({"__curve_size": size, "__curve_tie": F.xxhash64("text")})
    return df.withColumn("__curve_place", place(F.col("source").cast("string"), F.col("lang").cast("string"), size_cell(F.col("__curve_size"), bits)))


def runs(docs: DataFrame, shards: int = SHARDS, law: str = "bytes", bits: int = BITS) -> DataFrame:
    """Shard and slot of every row: ``doc_id, size, text_crc32, curve, tie, shard, slot``.

    Two small jobs give each sorted partition its offset (one row a partition is
    collected), so the running sums need no single-task window and a cell with a
    third of all rows is spread over many partitions.
    """
    if law not in ("bytes", "rows"):
        raise ValueError(f"law {law}")
    compact = keyed(docs.select("doc_id", "text", "source", "lang"), bits).select(
        "doc_id", F.col("__curve_size").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.col("__curve_place").alias("curve"), F.col("__curve_tie").alias("tie")
    )
    order = ["curve", "tie", "doc_id"]
    ordered = cut(cut(compact).repartitionByRange(*order).sortWithinPartitions(*order))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for b in batches:
            n += len(b)
            total += int(pc.sum(b.column(0)).as_py() or 0)
        yield pa.RecordBatch.from_pydict({"p": [TaskContext.get().partitionId()], "n": [n], "total": [total]})

    parts = sorted(ordered.select("size").mapInArrow(sums, "p long, n long, total long").collect())
    rows_before: dict[int, int] = {}
    size_before: dict[int, int] = {}
    n = total = 0
    for r in parts:
        rows_before[r.p], size_before[r.p] = n, total
        n, total = n + r.n, total + r.total

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = TaskContext.get().partitionId()
        row, before = rows_before[p], size_before[p]
        for b in batches:
            size = np.asarray(b.column(1), dtype=np.int64)
            at = before + np.cumsum(size) - size
            pos = row + np.arange(len(size), dtype=np.int64)
            shard = (2 * at + size) * shards // max(1, 2 * total) if law == "bytes" else pos * shards // max(1, n)
            row, before = row + len(size), before + int(size.sum())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard.astype(np.int32)), pa.array(pos)], names=[*b.schema.names, "shard", "pos"])

    placed = ordered.mapInArrow(place, "doc_id long, size long, text_crc32 long, curve long, tie long, shard int, pos long")
    first = {r.shard: r.pos for r in placed.groupBy("shard").agg(F.min("pos").alias("pos")).collect()}
    starts = F.array(*[F.lit(first.get(s, 0)).cast("long") for s in range(shards)])
    return placed.withColumn("slot", F.col("pos") - F.element_at(starts, F.col("shard") + 1))


def shard_documents(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """Whole rows with ``shard`` and ``curve_index``, sorted along the curve, so each written file is a stretch of it; a file in which a shard ends holds the next one's first rows too.

    The shards' first keys (at most ``shards`` of them) are compared as constants; the
    texts are moved once, by range, and no shard is gathered into one task.
    """
    placed = runs(docs, shards, "bytes", bits)
    key = F.struct("curve", "tie", "doc_id")
    bounds = placed.groupBy("shard").agg(F.min(F.struct("pos", key.alias("key"))).alias("first")).orderBy("shard").select("shard", "first.key").collect()
    df = keyed(docs, bits)
    shard = F.lit(bounds[0].shard if bounds else 0)
    own = F.struct(F.col("__curve_place").alias("curve"), F.col("__curve_tie").alias("tie"), F.col("doc_id"))
    for r in bounds[1:]:
        bound = F.struct(F.lit(r.key.curve).cast("long").alias("curve"), F.lit(r.key.tie).cast("long").alias("tie"), F.lit(r.key.doc_id).cast("long").alias("doc_id"))
        shard = F.when(own >= bound, F.lit(r.shard)).otherwise(shard)
    df = df.withColumn("__curve_shard", shard.cast("int")).repartitionByRange("__curve_place", "__curve_tie", "doc_id").sortWithinPartitions("__curve_place", "__curve_tie", "doc_id")
    own = [c for c in docs.columns if c.lower() not in ("shard", "curve_index")]
    return df.select(*own, F.col("__curve_shard").alias("shard"), F.col("__curve_place").alias("curve_index"))


def op1_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = runs(read(spark, sf_dir, "documents", "doc_id", "text", "source", "lang"))
    return df.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("curve").alias("curve_index"))


QUERIES = {"op1_hilbert_sharding": op1_hilbert_sharding}
ORACLE_SQL: dict[str, str] = {}
