"""Streams: a change feed that keeps fingerprints current, and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

FEED = "path string, content string, op string, ts timestamp"
CHANGE = "path string, content_hash string, since int, at int"


#: Batches between two snapshots; a batch between them writes its own changes alone.
COMPACT = 16


def state(spark: SparkSession, table: str, upto: int) -> DataFrame:
    """``path, content_hash, since`` after the batch of that number: the last snapshot, and the changes of the batches after it."""
    full = (upto + 1) // COMPACT * COMPACT - 1
    parts = [f"{table}/changes/{k}" for k in range(full + 1, upto + 1)]
    rows = spark.createDataFrame([], CHANGE)
    if full >= 0:
        rows = rows.unionByName(spark.read.schema(CHANGE).parquet(f"{table}/snapshots/{full}"))
    if parts:
        rows = rows.unionByName(spark.read.schema(CHANGE).parquet(*parts))
    newest = rows.groupBy("path").agg(F.max_by(F.struct("content_hash", "since"), "at").alias("r"))
    return newest.where("r.content_hash is not null").select("path", "r.content_hash", "r.since")


def current(spark: SparkSession, table: str) -> DataFrame:
    """The state after the newest batch."""
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(f"{table}/changes")
    names = [f.getPath().getName() for f in folder.getFileSystem(sc._jsc.hadoopConfiguration()).listStatus(folder)]
    return state(spark, table, max(int(n) for n in names if n.isdigit()))


def refresh(feed: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Keeps ``table`` (a folder) at one row a path: its newest hash and the batch that brought it, or none once deleted.

    A batch writes the changes of its own number, a row a changed path, so its cost follows the batch; each COMPACT-th writes
    a snapshot too.  A batch that is run again after a failure writes the same again.  Contents that come again unchanged keep their batch.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = batch.groupBy("path").agg(F.max_by(F.struct("content", "op"), "ts").alias("r"))
        fresh = newest.select("path", F.when(F.col("r.op") != "delete", F.sha2("r.content", 256)).alias("content_hash"), F.lit(number).alias("since"), F.lit(number).alias("at"))
        if number:
            old = state(spark, table, number - 1).select("path", F.col("content_hash").alias("old"))
            fresh = fresh.join(old, "path", "left").where(~F.col("content_hash").eqNullSafe(F.col("old"))).drop("old")
        fresh.write.mode("overwrite").parquet(f"{table}/changes/{number}")
        if (number + 1) % COMPACT == 0:
            # from the changes alone: the snapshot of this number is what is being written
            before = state(spark, table, number - 1).select("path", "content_hash", "since", F.lit(number - 1).alias("at"))
            whole = before.unionByName(spark.read.schema(CHANGE).parquet(f"{table}/changes/{number}")).groupBy("path").agg(F.max_by(F.struct("content_hash", "since"), "at").alias("r"))
            whole.where("r.content_hash is not null").select("path", "r.content_hash", "r.since", F.lit(number).alias("at")).write.mode("overwrite").parquet(f"{table}/snapshots/{number}")

    return feed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums by type in tumbling windows; state older than the watermark is dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("window.start", "event_type", "n", "total")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", "session_window.start", "session_window.end", "n")


def read_feed(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(FEED).json(folder)
