"""Shared pieces: words, Arrow iteration, lineage cuts, connected components."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python loop turns into NumPy arrays at a time.
BATCH_ROWS = 512
BATCH_BYTES = 4 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where it is unset, an own one in local mode (tests), and an error on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="loomgraph-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """The same rows in splits that do not change when they are read again: scans as they are, anything else checkpointed."""
    plans = [df._jdf.queryExecution().optimizedPlan()]
    while plans:
        plan = plans.pop()
        if plan.getClass().getSimpleName() not in ("Project", "Filter", "LogicalRelation", "DataSourceV2ScanRelation", "LogicalRDD", "LocalRelation"):
            return cut(df)
        children = plan.children()
        plans += [children.apply(k) for k in range(children.size())]
    return df


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def bytes_of(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def chunks(batch: pa.RecordBatch, text: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with few rows and few bytes, so that Python's memory stays bounded."""
    col = batch.column(batch.schema.get_field_index(text))
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
    start = total = 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and (i - start >= BATCH_ROWS or total + size > most):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if len(sizes) > start:
        yield batch.slice(start)


def lower_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; null has none."""
    return text.lower().split() if text else []


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of the id's decimal text falls into the given fold; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def is_star(edges: DataFrame) -> bool:
    """Each node has one edge at most, and no centre has one of its own."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("own"), F.lit(0).alias("hub")).unionByName(
        edges.select(F.col("v").alias("n"), F.lit(0).alias("own"), F.lit(1).alias("hub"))
    )
    per = ends.groupBy("n").agg(F.sum("own").alias("own"), F.max("hub").alias("hub"))
    return per.where("own > 1 or (own > 0 and hub > 0)").isEmpty()


#: A node with more than a HUB-th of all edges meets its least neighbour by broadcast (so fewer than 2 * HUB of them are).
HUB = 512


def _with_least(rows: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """Rows ``u, v`` with ``m`` of their u.  Rows of hubs stay where they are, all others are dealt by u; so no task gathers a hub's rows."""
    hub = F.col("n") > total / HUB
    hubs = cut(least.where(hub).select("u", "m"))
    if hubs.isEmpty():
        return rows.join(least.select("u", "m"), "u")
    few = F.broadcast(hubs)
    return rows.join(few, "u").unionByName(rows.join(few.select("u"), "u", "left_anti").join(least.where(~hub).select("u", "m"), "u"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    Takes pairs of long ids; gives ``node, component`` (the smallest id reachable)
    for every node that is not the smallest of its component.  Each round is two
    aggregations with map-side minima and two joins; nothing is collected, and a
    hub's rows are met by broadcast of its least neighbour, where they lie.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    e = cut(e)
    while not is_star(e):
        total = e.count()
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = cut(_with_least(both, least, 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = (
            _with_least(large, least, large.count())
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .where("u > v")
            .distinct()
        )
        e = cut(small)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))


def merged(blobs: DataFrame, merge: Callable[[list[bytes]], bytes], fan: int = 16) -> bytes | None:
    """Merges a column ``blob`` (about one a partition) in a tree; each task meets ``fan`` of them, the driver the last one."""

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: bytes | None = None
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                held = blob if held is None else merge([held, blob])
        if held is not None:
            yield pa.RecordBatch.from_pydict({"blob": pa.array([held], pa.binary())})

    df = cut(blobs.select("blob"))
    n = df.count()
    while n > 1:
        n = -(-n // fan)
        df = cut(df.repartition(n).mapInArrow(level, "blob binary"))
    row = df.first()
    return bytes(row.blob) if row else None


class Forest:
    """Union-find whose roots are the smallest ids."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up, root = self.up, x
        while (p := up.get(root, root)) != root:
            root = p
        while (p := up.get(x, x)) != root:
            up[x], x = root, p
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.up.setdefault(min(a, b), min(a, b))
        return True

    def links(self) -> Iterator[tuple[int, int]]:
        for x in list(self.up):
            if (r := self.find(x)) != x:
                yield x, r
