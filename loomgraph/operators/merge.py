"""Merges: batches into one graph, graphs of parts into one, new layers for new files, design summaries, wiki layers."""

from __future__ import annotations

import hashlib
import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.loops import cut
from . import change, imports, repair

# fixed values: structural edges that wait for their ends in a later run
WAITING = ["contains_flow", "flow_step", "cross_domain"]


def merge_batches(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """Nodes (``id, type, name, file_path, complexity, ord``) and edges of all batches as one graph, and the report.

    Ids are normalised, complexities too; edge ends follow the ids; of equal ids the last node stays at the first one's place; tests are
    put behind what they test; edges without an end go; of equal edges the heaviest stays.  ``report`` counts what was done, most common first.
    """
    fixed = nodes.withColumn("__new", repair.canonical_id(F.col("id"), F.col("type"), F.col("name"), F.col("file_path")))
    status = repair.canonical_complexity(F.col("complexity"))
    fixed = fixed.withColumn("__c", status)
    moved = fixed.where("id != __new").groupBy("id").agg(F.max_by("__new", "ord").alias("new")).withColumnRenamed("id", "old")
    renamed = fixed.select(F.col("__new").alias("id"), "type", "name", "file_path", F.col("__c.complexity").alias("complexity"), "ord")
    kept = renamed.groupBy("id").agg(F.max_by(F.struct("type", "name", "file_path", "complexity"), "ord").alias("r"), F.min("ord").alias("ord"), F.count(F.lit(1)).alias("copies"))
    to = edges.join(moved.select(F.col("old").alias("source"), F.col("new").alias("__s")), "source", "left").join(moved.select(F.col("old").alias("target"), F.col("new").alias("__t")), "target", "left")
    own = ["source", "target", "type", "direction", "weight", "ord"]
    followed = to.select(F.coalesce("__s", "source").alias("source"), F.coalesce("__t", "target").alias("target"), "type", "direction", "weight", "ord")
    tested = imports.canonical_tests(followed).select(own)
    turned = followed.where("type != 'tested_by'").unionByName(tested)
    ids = kept.select("id")
    sound = turned.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(own)
    best = sound.groupBy("source", "target", "type").agg(F.max_by(F.struct("direction", "weight"), F.struct(F.coalesce("weight", F.lit(0.0)), -F.col("ord"))).alias("r"), F.min("ord").alias("ord"))
    count = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    report = reduce(
        DataFrame.unionByName,
        [
            count(fixed.where("id != __new"), "ids normalised"),
            count(fixed.where("__c.status != 'valid'"), "complexities normalised"),
            kept.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("n")).select(F.lit("duplicate nodes").alias("what"), "n"),
            count(turned.join(ids.withColumnRenamed("id", "source"), "source", "left_anti"), "edges without source"),
            count(turned.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_anti"), "edges without target"),
        ],
    )
    return {
        "nodes": kept.select("id", "r.*", "ord"),
        "edges": best.select("source", "target", "type", "r.direction", "r.weight", "ord"),
        "report": report.where("n > 0").orderBy(F.desc("n"), "what"),
    }


def pruned_merge(nodes: DataFrame, edges: DataFrame, changed: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> dict[str, DataFrame]:
    """The graph without the changed files comes first, then the new batches; all are merged as batches are."""
    n, e = change.merge_update(nodes.withColumn("__new", F.lit(0)), edges.withColumn("__new", F.lit(0)), changed, new_nodes.withColumn("__new", F.lit(1)), new_edges.withColumn("__new", F.lit(1)))
    later = lambda df: df.withColumn("ord", F.col("ord") + F.col("__new") * F.lit(1 << 50)).drop("__new")
    return merge_batches(later(n), later(e))


def split_pending(edges: DataFrame, nodes: DataFrame, waiting: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with both ends, of this run's and those that waited; and those that wait on: structural ones with an end missing."""
    every = edges.unionByName(waiting.select(edges.columns))
    ids = nodes.select("id")
    met = every.join(ids.select(F.col("id").alias("source"), F.lit(True).alias("__s")), "source", "left").join(ids.select(F.col("id").alias("target"), F.lit(True).alias("__t")), "target", "left")
    whole = F.col("__s").isNotNull() & F.col("__t").isNotNull()
    return met.where(whole).select(edges.columns), met.where(~whole & F.col("type").isin(WAITING)).select(edges.columns)


def merge_tours(steps: DataFrame) -> DataFrame:
    """``step, title, description, nodes``: tours (``ord, title, description, nodes``) one after the other; equal titles are one step, with the longer description and all nodes in order."""
    per = steps.groupBy("title").agg(
        F.min("ord").alias("ord"),
        F.max_by("description", F.struct(F.length("description"), -F.col("ord"))).alias("description"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "nodes"))), lambda x: x["nodes"]))).alias("nodes"),
    )
    return per.withColumn("step", F.row_number().over(Window.orderBy("ord"))).select("step", "title", "description", "nodes")  # one row a step


def merge_projects(projects: DataFrame) -> DataFrame:
    """One row of several (``ord, name, languages, description, analyzed_at, commit``): lists in order without repeats, descriptions joined, the latest commit."""
    rows = F.array_sort(F.collect_list(F.struct("ord", "name", "languages", "description")))
    one = projects.agg(rows.alias("r"), F.max("analyzed_at").alias("analyzed_at"), F.max_by("commit", "analyzed_at").alias("commit"))
    said = F.array_distinct(F.filter(F.transform("r", lambda x: x["description"]), lambda d: d.isNotNull() & (d != "")))
    return one.select(F.col("r")[0]["name"].alias("name"), F.array_distinct(F.flatten(F.transform("r", lambda x: x["languages"]))).alias("languages"), F.array_join(said, " | ").alias("description"), "analyzed_at", "commit")


def place_files(members: DataFrame, files: DataFrame, deleted: DataFrame, catch_all: str = "layer:other") -> DataFrame:
    """``layer_id, node_id``: new files (``node_id, path``) go to the layer that most files of their folder are in (the smallest name of equal ones), else to the last layer; deleted ones leave.

    ``members`` holds ``layer_id, node_id, path``; a layer that loses all members is gone.
    """
    left = members.join(deleted.select("path"), "path", "left_anti")
    folder = imports.directory(F.col("path"))
    votes = left.groupBy(folder.alias("dir"), "layer_id").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("dir").agg(F.min_by("layer_id", F.struct(-F.col("n"), F.col("layer_id"))).alias("layer_id"))
    fresh = files.join(left.select("node_id"), "node_id", "left_anti").withColumn("dir", folder).join(best, "dir", "left")
    return left.select("layer_id", "node_id").unionByName(fresh.select(F.coalesce("layer_id", F.lit(catch_all)).alias("layer_id"), "node_id"))


def patch_fingerprints(store: DataFrame, fresh: DataFrame, deleted: DataFrame, known: int | None = None) -> DataFrame:
    """The store with the rows of re-analysed paths replaced and deleted ones gone; an error if it was loaded empty though it held ``known`` rows."""
    if known and store.isEmpty():
        raise ValueError("the fingerprint store was loaded empty")
    gone = fresh.select("path").unionByName(deleted.select("path")).distinct()
    return store.join(gone, "path", "left_anti").select(store.columns).unionByName(fresh.select(store.columns))


def changed_files(names: DataFrame) -> DataFrame:
    """``path`` of a name list (``line``) without blanks and repeats."""
    return names.select(F.trim("line").alias("path")).where("path != ''").distinct()


def patch_nodes(nodes: DataFrame, patches: DataFrame) -> DataFrame:
    """Summaries and tags (``id, ord, summary, tags``) on nodes that exist; the last patch holds, fields it lacks stay."""
    last = patches.groupBy("id").agg(F.max_by(F.struct(F.col("summary").alias("s"), F.col("tags").alias("t")), "ord").alias("__p"))
    met = nodes.join(last, "id", "left")
    return met.withColumns({"summary": F.coalesce("__p.s", "summary"), "tags": F.coalesce("__p.t", "tags")}).select(nodes.columns)


def page_layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``layer_id, node_id``: a layer for each page with all it contains, and one of the design system for what no page holds.

    Parents are climbed a step a round, until no node moves.
    """
    spark = nodes.sparkSession
    up = edges.where("type = 'contains'").groupBy(F.col("target").alias("at")).agg(F.min("source").alias("above"))
    at = cut(spark, nodes.select("id", F.col("id").alias("at")))
    while True:
        step = at.join(up, "at", "left").select("id", F.coalesce("above", "at").alias("at"), F.col("above").isNotNull().alias("moved"))
        step = cut(spark, step)
        at = step.select("id", "at")
        if step.where("moved").isEmpty():
            break
    page = nodes.where("type = 'page'").select(F.col("id").alias("at"), F.lit(True).alias("__page"))
    return at.join(page, "at", "left").select(F.when(F.col("__page"), F.concat(F.lit("layer:"), "at")).otherwise("layer:design-system").alias("layer_id"), F.col("id").alias("node_id"))


def category_layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``layer_id, node_id`` of a wiki graph: a layer for each topic with its articles; entities and claims follow the first article tied to them; the rest are Other."""
    filed = edges.where("type = 'categorized_under'").select(F.col("source").alias("node_id"), F.col("target").alias("layer_id"), "ord")
    topics = nodes.where("type = 'topic'").select(F.col("id").alias("node_id"), F.col("id").alias("layer_id"))
    own = filed.groupBy("node_id").agg(F.min_by("layer_id", "ord").alias("layer_id"))
    articles = nodes.where("type = 'article'").select("id")
    children = nodes.where("type in ('entity', 'claim')").select("id")
    both = edges.select(F.col("source").alias("a"), F.col("target").alias("b"), "ord").unionByName(edges.select(F.col("target").alias("a"), F.col("source").alias("b"), "ord"))
    tied = both.join(articles.withColumnRenamed("id", "a"), "a", "left_semi").join(children.withColumnRenamed("id", "b"), "b", "left_semi").groupBy(F.col("b").alias("id")).agg(F.min_by("a", "ord").alias("article"))
    follow = tied.join(own.select(F.col("node_id").alias("article"), "layer_id"), "article").select(F.col("id").alias("node_id"), "layer_id")
    placed = own.join(topics.select("node_id"), "node_id", "left_anti").unionByName(follow.join(own.select("node_id"), "node_id", "left_anti")).unionByName(topics)
    rest = nodes.where("type in ('article', 'entity', 'claim', 'source')").select(F.col("id").alias("node_id")).join(placed.select("node_id"), "node_id", "left_anti")
    return placed.select("layer_id", "node_id").unionByName(rest.select(F.lit("layer:other").alias("layer_id"), "node_id"))


def category_tour(layers: DataFrame, nodes: DataFrame, most: int = 3) -> DataFrame:
    """``layer_id, place, node_id``: the first articles of each layer, by the nodes' order."""
    met = layers.join(nodes.where("type = 'article'").select(F.col("id").alias("node_id"), "ord"), "node_id")
    place = F.row_number().over(Window.partitionBy("layer_id").orderBy("ord"))
    return met.withColumn("place", place).where(F.col("place") <= most).select("layer_id", "place", "node_id")


#: Hashes of one inner node of a digest's tree, on average, at most.
FAN = 256


def canonical_digest(rows: DataFrame) -> DataFrame:
    """One row: a digest of a table that depends on its rows alone, not on their order or partitions.

    Leaves are the SHA-256 of a row as JSON with sorted keys, with the number of rows that are equal to it.  They are the leaves
    of a tree over the hashes' own digits: a node is the hash of what is below it in order, and there are as many levels as it takes for a
    node to have about FAN below it (hashes spread evenly).
    """
    cols = sorted(rows.columns)
    text = F.to_json(F.struct(*[F.col(c) for c in cols]), {"ignoreNullFields": "false"})
    equal = rows.groupBy(F.sha2(text, 256).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    spark = rows.sparkSession
    level = cut(spark, equal.select(F.col("h").alias("at"), F.sha2(F.concat_ws(":", "h", F.col("n").cast("string")), 256).alias("x")))
    below, digits = level.count(), 64
    while True:
        digits = min(digits - 1, max(0, math.ceil(math.log(max(1, below) / FAN, 16))))  # as many nodes as leave FAN below each
        inside = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda r: r["x"]), "")
        level = level.groupBy(F.substring("at", 1, digits).alias("at")).agg(F.sha2(inside, 256).alias("x"))
        if digits == 0:
            break
        below = 16**digits
    empty = spark.createDataFrame([("", hashlib.sha256(b"").hexdigest())], "at string, y string")
    return empty.join(level, "at", "left").select(F.coalesce("x", "y").alias("digest"))


def bounded_warnings(warnings: DataFrame, most: int = 5) -> DataFrame:
    """``stage, n, messages, truncated``: how many warnings (``stage, ord, message``) a stage has, and its first ones."""
    rank = F.row_number().over(Window.partitionBy("stage").orderBy("ord"))
    first = warnings.withColumn("__rank", rank).where(F.col("__rank") <= most).groupBy("stage").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "message"))), lambda x: x["message"]).alias("messages"))
    per = warnings.groupBy("stage").agg(F.count(F.lit(1)).alias("n"))
    return per.join(first, "stage").select("stage", "n", "messages", (F.col("n") > most).alias("truncated"))


def structure_sums(metrics: DataFrame) -> DataFrame:
    """One row of sums of all counters of files."""
    return metrics.agg(F.count(F.lit(1)).alias("files"), *[F.sum(c).alias(c) for c in metrics.columns if c.endswith("_count")])


