"""Lineage cuts and numbering for iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that one task may number; more are numbered by ranges.
FEW = 1 << 16
#: Rows that a loop may send to every task in a round.
SENT = 1 << 12
#: Rows, about, that one task may hold to tell them apart.
PART = 1 << 19
#: Written tables that a growing one may consist of before they are written as one.
PIECES = 8


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, an own one in local mode, and an error on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="loomgraph-"))
    return sc.getCheckpointDir()


def write(df: DataFrame) -> str:
    """Writes a table into the shared folder; gives its place."""
    folder = f"{checkpoint_dir(df.sparkSession)}/loop-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return folder


def cut(spark: SparkSession, df: DataFrame, turn: int = 0, every: int = 1) -> DataFrame:
    """The rows written to the shared folder and read again, each so many turns.

    A checkpoint of a DataFrame keeps its plan's constraints and its estimate of size, and both grow from round to round of a
    loop until planning takes longer than the work; a written table has neither, and its true size lets small sides be broadcast.
    """
    if turn % every:
        return df
    return spark.read.schema(df.schema).parquet(write(df))


def dealt(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: it meets the other by shuffling, as a small file may hold many rows, and each round of a loop would send them all to the driver."""
    return df.hint("merge")


def held(df: DataFrame) -> DataFrame:
    """The side of a join whose rows, far fewer than the other's and with unique keys, a task may hold by parts: the other is shuffled and streams past, and is neither sorted nor spilled."""
    return df.hint("shuffle_hash")


def parted(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Rows dealt by keys into parts of about PART, given their number (or more): what a task then tells apart does not grow with the input."""
    return df.repartition(max(1, -(-rows // PART)), *keys)


class Grown:
    """A table that a loop adds to: each addition is written once, and now and then all of them as one."""

    def __init__(self, first: DataFrame) -> None:
        self.spark, self.schema, self.folders = first.sparkSession, first.schema, [write(first)]

    def add(self, more: DataFrame, merge: object = None) -> DataFrame:
        """Writes rows and gives them back; ``merge`` makes of all the table that is kept, where rows replace one another or are used up."""
        self.folders.append(write(more.select(*self.schema.names)))
        added = self.spark.read.schema(self.schema).parquet(self.folders[-1])
        if len(self.folders) > PIECES:
            self.folders = [write(merge(self.all()) if merge else self.all())]
        return added

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.folders)


def numbered(df: DataFrame, order: list[Column], name: str, start: int = 0, few: int = FEW) -> DataFrame:
    """Adds the rows' places in an order, from start on.

    Many rows are dealt by ranges, each range is numbered in its task, and the ranges' sizes (one number a
    partition) give the offsets; so no task holds them all.
    """
    spark = df.sparkSession
    df = cut(spark, df)
    if df.count() <= few:
        return df.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1 + start).cast("long"))
    dealt = cut(spark, df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes = {r[0]: r[1] for r in dealt.groupBy("__range").count().collect()}
    offsets, at = [], start
    for k in range(max(sizes) + 1):
        offsets.append(at)
        at += sizes.get(k, 0)
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return dealt.withColumn(name, (own + F.element_at(F.array(*map(F.lit, offsets)), F.col("__range") + 1)).cast("long")).drop("__range")
