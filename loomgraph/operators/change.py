"""Change analysis: fingerprints, differences, update classes, merges, impact."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import neighbours


def fingerprints(files: DataFrame) -> DataFrame:
    """``path, content_hash, lines``; content null: no file."""
    lines = F.length("content") - F.length(F.replace("content", F.lit("\n"))) + 1
    return files.where("content is not null").select("path", F.sha2("content", 256).alias("content_hash"), lines.cast("long").alias("lines"))


def changes(old: DataFrame, new: DataFrame, signature: str = "signature") -> DataFrame:
    """``path, change``: new, deleted, structural (another signature), cosmetic (another hash alone), unchanged."""
    o = old.select("path", F.col("content_hash").alias("__h"), F.col(signature).alias("__s"), F.lit(True).alias("__o"))
    met = o.join(new.select("path", "content_hash", F.col(signature).alias("__n"), F.lit(True).alias("__p")), "path", "full_outer")
    what = (
        F.when(F.col("__o").isNull(), "new")
        .when(F.col("__p").isNull(), "deleted")
        .when(F.col("__h") == F.col("content_hash"), "unchanged")
        .when(F.col("__s").eqNullSafe(F.col("__n")) & F.col("__s").isNotNull(), "cosmetic")
        .otherwise("structural")
    )
    return met.select("path", what.alias("change"))


def update_class(found: DataFrame) -> DataFrame:
    """One row: SKIP, FULL (over 30 changes of structure, or over half of all), ARCHITECTURE (a new top folder, or over 10), PARTIAL."""
    c = F.col("change")
    top = F.substring_index("path", "/", 1)
    one = found.agg(
        F.count(F.when(c.isin("new", "deleted", "structural"), 1)).alias("structural"),
        F.count(F.when(c != "deleted", 1)).alias("total"),
        F.collect_set(F.when(c == "new", top)).alias("fresh"),
        F.collect_set(F.when(c != "new", top)).alias("known"),
    )
    full = (F.col("structural") > 30) | (F.col("structural") > F.col("total") * 0.5)
    opened = F.size(F.array_except("fresh", "known")) > 0
    kind = F.when(F.col("structural") == 0, "SKIP").when(full, "FULL").when(opened | (F.col("structural") > 10), "ARCHITECTURE").otherwise("PARTIAL")
    return one.select("structural", "total", kind.alias("update"))


def merge_update(nodes: DataFrame, edges: DataFrame, changed: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the changed files (``file_path``) and every edge that touches them make room for the new ones."""
    gone = nodes.join(changed.select("file_path"), "file_path", "left_semi").select("id")
    kept = nodes.join(gone, "id", "left_anti").select(nodes.columns)
    left = edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti").select(edges.columns)
    return kept.unionByName(new_nodes), left.unionByName(new_edges)


def merge_layers(members: DataFrame) -> DataFrame:
    """``layer_id, nodes``: layers of the same id from several graphs have the union of their members."""
    return members.groupBy("layer_id").agg(F.count_distinct("node_id").alias("nodes"))


def pending(dropped: DataFrame, kinds: list[str] = ("contains_flow", "flow_step", "cross_domain")) -> DataFrame:
    """Structural edges that found no end: kept for the next run."""
    return dropped.where(F.col("reason").isNotNull() & F.col("type").isin(list(kinds)))


def contains_growth(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``id, at``: what one pass over the contains edges in order reaches from the seeds.

    Least fixpoint of: a target is reached at the smallest place of an edge that comes after its source was reached; seeds at -1.
    """
    spark = edges.sparkSession
    e = edges.where("type = 'contains'").select("source", "target", "ord")
    reached = seeds.select("id", F.lit(-1).cast("long").alias("at")).distinct()
    frontier = reached
    from ..plans.loops import cut

    for k in count():
        step = e.join(frontier.select(F.col("id").alias("source"), "at"), "source").where("ord > at").groupBy(F.col("target").alias("id")).agg(F.min("ord").alias("at"))
        better = step.join(reached.select("id", F.col("at").alias("old")), "id", "left").where("old is null or at < old").select("id", "at")
        frontier = cut(spark, better)
        if frontier.isEmpty():
            break
        reached = cut(spark, reached.unionByName(frontier).groupBy("id").agg(F.min("at").alias("at")), k)
    return reached


def impact(nodes: DataFrame, edges: DataFrame, members: DataFrame, changed_paths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Changed nodes (with what they contain), affected ones an edge away, and the layers of both."""
    hit = nodes.join(changed_paths.select("file_path"), "file_path", "left_semi").select("id")
    changed = contains_growth(edges, hit).select("id")
    affected = neighbours(edges, changed).join(changed, "id", "left_anti")
    layers = members.join(changed.unionByName(affected).select(F.col("id").alias("node_id")), "node_id", "left_semi").select("layer_id").distinct()
    return changed, affected, layers


def structural_fingerprints(files: DataFrame, found: DataFrame) -> DataFrame:
    """``path, content_hash, analysed, functions, classes, imports, exports`` of files and the rows that parsing gave (see structure)."""
    line_count = F.col("end") - F.col("start") + 1
    own = found.groupBy("path").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == "function", F.struct("name", F.coalesce("params", F.lit("")).alias("params"), F.coalesce("returns", F.lit("")).alias("returns"), "exported", line_count.alias("lines"))))).alias("functions"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "class", F.struct("name", "exported")))).alias("classes"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "method", F.struct(F.col("parent").alias("owner"), "name")))).alias("methods"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "import", F.col("name")))).alias("imports"),
        F.array_sort(F.collect_list(F.when(F.col("exported") & F.col("kind").isin("function", "class", "export"), F.col("name")))).alias("exports"),
        F.bool_or(F.col("kind") == "parsed").alias("analysed"),
    )
    return files.select("path", F.sha2("content", 256).alias("content_hash")).join(own, "path", "left").withColumn("analysed", F.coalesce("analysed", F.lit(False)))


def _named(items: Column, name: Column) -> Column:
    return F.get(F.filter(items, lambda x: x["name"] == name), F.lit(0))


def compare_fingerprints(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path, level, details`` of files in both: NONE, COSMETIC or STRUCTURAL, and what changed of functions, classes, imports and exports.

    A function whose length grows beyond 1.5 times or falls below half is a change of structure too.
    """
    o = old.select("path", F.struct(*[c for c in old.columns if c != "path"]).alias("o"))
    met = o.join(new.select("path", F.struct(*[c for c in new.columns if c != "path"]).alias("n")), "path")
    names = lambda xs: F.transform(xs, lambda x: x["name"])
    said = lambda text, xs: F.transform(xs, lambda x: F.concat(F.lit(text), x))
    gone = lambda kind: said(f"removed {kind}: ", F.array_except(names(F.col(f"o.{kind}s".replace("classs", "classes"))), names(F.col(f"n.{kind}s".replace("classs", "classes")))))
    fresh = lambda kind: said(f"new {kind}: ", F.array_except(names(F.col(f"n.{kind}s".replace("classs", "classes"))), names(F.col(f"o.{kind}s".replace("classs", "classes")))))

    def altered(text: str, items: str, differs) -> Column:
        both = F.filter(F.col(f"n.{items}"), lambda x: _named(F.col(f"o.{items}"), x["name"]).isNotNull() & differs(_named(F.col(f"o.{items}"), x["name"]), x))
        return said(text, names(both))

    methods = lambda side, name: F.array_sort(F.transform(F.filter(F.col(f"{side}.methods"), lambda m: m["owner"] == name), lambda m: m["name"]))
    details = F.concat(
        fresh("function"), gone("function"),
        altered("params changed: ", "functions", lambda a, b: a["params"] != b["params"]),
        altered("return type changed: ", "functions", lambda a, b: a["returns"] != b["returns"]),
        altered("export status changed: ", "functions", lambda a, b: a["exported"] != b["exported"]),
        altered("significant size change: ", "functions", lambda a, b: (b["lines"] / a["lines"] > 1.5) | (b["lines"] / a["lines"] < 0.5)),
        fresh("class"), gone("class"),
        altered("methods changed: ", "classes", lambda a, b: methods("o", b["name"]) != methods("n", b["name"])),
        altered("export status changed: ", "classes", lambda a, b: a["exported"] != b["exported"]),
        F.when(F.col("o.imports") != F.col("n.imports"), F.array(F.lit("imports changed"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("o.exports") != F.col("n.exports"), F.array(F.lit("exports changed"))).otherwise(F.array().cast("array<string>")),
    )
    same = F.col("o.content_hash") == F.col("n.content_hash")
    blind = ~F.col("o.analysed") | ~F.col("n.analysed")
    what = met.select("path", same.alias("same"), blind.alias("blind"), F.when(~same & ~blind, details).alias("d"))
    level = F.when(F.col("same"), "NONE").when(F.col("blind") | (F.size("d") > 0), "STRUCTURAL").otherwise("COSMETIC")
    told = F.when(F.col("same"), F.array().cast("array<string>")).when(F.col("blind"), F.array(F.lit("no structural analysis"))).when(F.size("d") > 0, F.col("d")).otherwise(F.array(F.lit("internal logic changed")))
    return what.select("path", level.alias("level"), told.alias("details"))


def equal_contents(files: DataFrame, content: str, key: str) -> DataFrame:
    """``content_hash, n, first``: contents that several files have."""
    return files.groupBy(F.sha2(content, 256).alias("content_hash")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first")).where("n > 1")
