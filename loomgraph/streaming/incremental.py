"""A graph that is kept current batch by batch: structural fingerprints, nodes, edges and those that wait for an end.

A feed brings fragments: a path with what parsing made of it (a hash of its content, its signature, its nodes and edges), or
the news that it is gone.  A batch compares fragments with the fingerprints that are kept: equal content changes nothing, an equal signature changes
the fingerprint alone, and only other paths have their nodes and edges replaced.  Edges whose
ends came or went are looked at again, so one that waited joins the graph in the batch that brings its end, and waits again when that goes.

Every table is keyed and versioned: a batch writes, under its own number, the rows that it changes (or tombstones), each
COMPACT-th batch the whole table too.  A batch reads only what batches before it wrote, so running it again after a failure writes the
same again; and what all batches leave does not depend on how the feed was cut into batches.

Defined cases: of several fragments of a path in one batch the newest counts (the greatest content on a tie); a null path is
passed over; an edge that stands twice in a path counts once, with its greatest weight; a node that several paths have is there while one of them has it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import WAITING

FRAGMENT = (
    "path string, ts timestamp, op string, content_hash string, signature string, "
    "nodes array<struct<id:string,type:string,name:string>>, edges array<struct<source:string,target:string,type:string,weight:double>>"
)
COMPACT = 16


class Versioned:
    """A keyed table of a folder, as of any batch."""

    def __init__(self, spark: SparkSession, folder: str, key: list[str], values: str) -> None:
        self.spark, self.folder, self.key = spark, folder, key
        self.values = [x.split()[0] for x in values.split(", ")]
        self.schema = ", ".join([*(f"{k} string" for k in key), values, "gone boolean, at int"])

    def state(self, upto: int) -> DataFrame:
        """The rows after a batch: the last whole table, and what the batches after it changed."""
        full = (upto + 1) // COMPACT * COMPACT - 1
        parts = [f"{self.folder}/whole/{full}"] * (full >= 0) + [f"{self.folder}/changes/{k}" for k in range(full + 1, upto + 1)]
        rows = self.spark.read.schema(self.schema).parquet(*parts) if parts else self.spark.createDataFrame([], self.schema)
        return self._newest(rows).select(*self.key, *self.values)

    def _newest(self, rows: DataFrame) -> DataFrame:
        last = rows.groupBy(*self.key).agg(F.max_by(F.struct(*self.values, "gone"), "at").alias("r")).where("not r.gone")
        return last.select(*self.key, "r.*")

    def put(self, rows: DataFrame, number: int) -> None:
        """Writes a batch's rows (with ``gone``), and now and then all."""
        rows.select(*self.key, *self.values, "gone", F.lit(number).alias("at")).write.mode("overwrite").parquet(f"{self.folder}/changes/{number}")
        if (number + 1) % COMPACT == 0:
            fresh = self.spark.read.schema(self.schema).parquet(f"{self.folder}/changes/{number}")
            before = self.state(number - 1).withColumn("gone", F.lit(False)).withColumn("at", F.lit(number - 1))
            self._newest(before.unionByName(fresh)).withColumn("at", F.lit(number)).write.mode("overwrite").parquet(f"{self.folder}/whole/{number}")

    def changes(self, number: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/changes/{number}")


class GraphState:
    """The kept tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.files = Versioned(spark, f"{folder}/files", ["path"], "content_hash string, signature string, level string, since int")
        self.nodes = Versioned(spark, f"{folder}/nodes", ["path", "id"], "type string, name string")
        self.edges = Versioned(spark, f"{folder}/edges", ["path", "source", "target", "type"], "weight double, status string")

    def apply(self, batch: DataFrame, number: int) -> None:
        """Takes in a batch of fragments under its number."""
        newest = batch.where("path is not null").groupBy("path").agg(F.max_by(F.struct("op", "content_hash", "signature", "nodes", "edges"), F.struct("ts", "content_hash")).alias("r")).select("path", "r.*")
        known = self.files.state(number - 1).select("path", F.col("content_hash").alias("h"), F.col("signature").alias("s"), "since", F.lit(True).alias("known"))
        met = newest.join(known, "path", "left")
        gone = F.col("op") == "delete"
        level = F.when(F.col("known").isNull(), "new").when(F.col("h").eqNullSafe(F.col("content_hash")), "unchanged").when(F.col("s").eqNullSafe(F.col("signature")) & F.col("s").isNotNull(), "cosmetic").otherwise("structural")
        told = met.select("path", "content_hash", "signature", "nodes", "edges", gone.alias("gone"), F.when(gone, "deleted").otherwise(level).alias("level"), F.lit(number).alias("since"))
        told = told.where("level != 'unchanged'")
        self.files.put(told, number)
        other = told.where("level in ('new', 'structural', 'deleted')").select("path", "gone", "nodes", "edges")
        paths = other.select("path")

        def replaced(table: Versioned, fresh: DataFrame) -> DataFrame:
            """Old rows of the changed paths that do not come again, as tombstones, and the new rows."""
            old = table.state(number - 1).join(paths, "path", "left_semi").withColumn("gone", F.lit(True))
            fresh = fresh.withColumn("gone", F.lit(False))
            return old.join(fresh.select(*table.key), table.key, "left_anti").unionByName(fresh.select(old.columns))

        shown = other.where("not gone")
        own_nodes = shown.select("path", F.inline("nodes")).where("id is not null").groupBy("path", "id").agg(F.max(F.struct("type", "name")).alias("r")).select("path", "id", "r.*")
        self.nodes.put(replaced(self.nodes, own_nodes), number)
        own_edges = shown.select("path", F.inline("edges")).where("source is not null and target is not null and type is not null").groupBy("path", "source", "target", "type").agg(F.max("weight").alias("weight"))
        there = self.nodes.state(number).select("id").distinct()
        moved = self.nodes.changes(number).select("id").distinct()
        # edges of other paths whose ends came or went
        kept = self.edges.state(number - 1).drop("status").join(paths, "path", "left_anti")
        touched = kept.join(moved.withColumnRenamed("id", "source"), "source", "left_semi").unionByName(kept.join(moved.withColumnRenamed("id", "target"), "target", "left_semi").select(kept.columns)).distinct()
        open_ = own_edges.unionByName(touched.select(own_edges.columns))
        ends = open_.join(there.select(F.col("id").alias("source"), F.lit(True).alias("a")), "source", "left").join(there.select(F.col("id").alias("target"), F.lit(True).alias("b")), "target", "left")
        status = F.when(F.col("a") & F.col("b"), "live").when(F.col("type").isin(list(WAITING)), "waiting").otherwise("dangling")
        looked = ends.select("path", "source", "target", "type", "weight", status.alias("status"), F.lit(False).alias("gone"))
        lost = self.edges.state(number - 1).join(paths, "path", "left_semi").join(own_edges.select(*self.edges.key), self.edges.key, "left_anti").withColumn("gone", F.lit(True))
        self.edges.put(looked.unionByName(lost), number)

    def graph(self, upto: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Nodes, edges and waiting edges after a batch, each once."""
        nodes = self.nodes.state(upto).groupBy("id").agg(F.max(F.struct("type", "name")).alias("r")).select("id", "r.*")
        edges = self.edges.state(upto).groupBy("source", "target", "type").agg(F.max("weight").alias("weight"), F.max("status").alias("status"), F.min("status").alias("least"))
        return nodes, edges.where("least = 'live' or status = 'live'").drop("status", "least"), edges.where("status = 'waiting'").drop("status", "least")


def follow(feed: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keeps a folder's graph current with a stream of fragments."""
    return feed.writeStream.foreachBatch(lambda batch, number: GraphState(batch.sparkSession, folder).apply(batch.persist(), number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fragments(files: DataFrame) -> DataFrame:
    """Fragments of source files (``path, language, content, op, ts``): a node for the file and each declaration, edges that contain them; the signature is what is declared, with parameters, types and exports."""
    from ..operators import syntax

    declared = syntax.declarations(syntax.tokens(files.where("op != 'delete'")))
    file_id = F.concat(F.lit("file:"), "path")
    own = declared.where("kind in ('class', 'function')").withColumn("id", F.concat("kind", F.lit(":"), "path", F.lit(":"), F.concat_ws(".", "owner", "name")))
    said = F.concat_ws(" ", "kind", F.concat_ws(".", "owner", "name"), F.array_join("params", ","), "returns", F.col("exported").cast("string"))
    per = own.groupBy("path").agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(said)), "\n"), 256).alias("signature"),
        F.array_sort(F.collect_set(F.struct("id", F.col("kind").alias("type"), "name"))).alias("inside"),
    )
    met = files.join(per, "path", "left")
    node = F.array(F.struct(file_id.alias("id"), F.lit("file").alias("type"), F.col("path").alias("name")))
    inside = F.coalesce("inside", F.array().cast("array<struct<id:string,type:string,name:string>>"))
    edges = F.transform(inside, lambda x: F.struct(F.concat(F.lit("file:"), F.col("path")).alias("source"), x["id"].alias("target"), F.lit("contains").alias("type"), F.lit(1.0).alias("weight")))
    return met.select("path", "ts", "op", F.sha2("content", 256).alias("content_hash"), F.coalesce("signature", F.lit("")).alias("signature"), F.concat(node, inside).alias("nodes"), edges.alias("edges"))
