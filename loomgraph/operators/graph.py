"""Graph queries: filters, neighbourhoods, layers, containers, overviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import lookup
from ..functions.vocabulary import EDGE_CATEGORIES, NODE_CATEGORIES
from ..plans.loops import held


def node_category(node_type: Column) -> Column:
    """Filter category of a node type; unknown types are code."""
    return lookup(node_type, NODE_CATEGORIES, default=F.lit("code"))


def edge_category(edge_type: Column) -> Column:
    """Filter category of an edge type, null for unknown ones."""
    return lookup(edge_type, EDGE_CATEGORIES)


def filter_nodes(nodes: DataFrame, types: list[str], complexities: list[str], members: DataFrame | None = None, layers: list[str] = ()) -> DataFrame:
    """Nodes of a type in types and, if they have one, a complexity in complexities; in any of the layers, if one is given."""
    kept = nodes.where(F.col("type").isin(types) & (F.col("complexity").isNull() | F.col("complexity").isin(complexities)))
    if not layers:
        return kept
    inside = members.where(F.col("layer_id").isin(list(layers))).select(F.col("node_id").alias("id"))
    return kept.join(inside, "id", "left_semi")


def induced(edges: DataFrame, ids: DataFrame, few: bool = False) -> DataFrame:
    """Edges with both ends among ``ids.id``; few of them may be sent to every task."""
    ids = ids if few else held(ids)
    out = edges.join(ids.select(F.col("id").alias("source")), "source", "left_semi")
    return out.join(ids.select(F.col("id").alias("target")), "target", "left_semi").select(edges.columns)


def filter_edges(edges: DataFrame, visible: DataFrame, categories: list[str]) -> DataFrame:
    """Edges between visible nodes, of a category in categories or of none."""
    category = edge_category(F.col("type"))
    return induced(edges.where(category.isNull() | category.isin(categories)), visible)


def persona(nodes: DataFrame, technical: bool) -> DataFrame:
    """Others than technical readers see no functions and classes."""
    return nodes if technical else nodes.where(~F.col("type").isin("function", "class"))


def neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``id`` of the nodes one edge away, in either direction, seeds included."""
    s = seeds.select("id").distinct()
    out = edges.join(s.withColumnRenamed("id", "source"), "source", "left_semi").select(F.col("target").alias("id"))
    into = edges.join(s.withColumnRenamed("id", "target"), "target", "left_semi").select(F.col("source").alias("id"))
    return out.unionByName(into).unionByName(s).distinct()


def touched_layers(members: DataFrame, ids: DataFrame) -> DataFrame:
    return members.join(ids.select(F.col("id").alias("node_id")), "node_id", "left_semi").select("layer_id").distinct()


def first_layer(members: DataFrame) -> DataFrame:
    """``node_id, layer_id``: the first layer of each node."""
    return members.groupBy("node_id").agg(F.min_by("layer_id", "layer_ord").alias("layer_id"))


def all_layers(members: DataFrame) -> DataFrame:
    return members.groupBy("node_id").agg(F.array_join(F.array_sort(F.collect_set("layer_id")), ",").alias("layers"))


def degrees(edges: DataFrame) -> DataFrame:
    """``id, degree``: both ends count, a self-loop twice."""
    out = edges.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    into = edges.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return out.unionByName(into).groupBy("id").agg(F.sum("n").alias("degree"))


def node_scale(edges: DataFrame) -> DataFrame:
    """``id, degree, scale``: how large the knowledge view draws a node, by its edges."""
    n = degrees(edges)
    return n.select("id", "degree", F.round(F.least(F.greatest(0.85 + 0.03 * F.col("degree"), F.lit(0.85)), F.lit(1.5)), 4).alias("scale"))


def most_connected(nodes: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """The k nodes of highest degree, the earlier one first on a tie."""
    return nodes.join(degrees(edges), "id").orderBy(F.desc("degree"), "ord").limit(k).select("id", "degree")


def container_edges(edges: DataFrame, containers: DataFrame) -> DataFrame:
    """``source_container, target_container, count, types`` between different containers (``id, container``); edges with an end in none are left out."""
    s = containers.select(F.col("id").alias("source"), F.col("container").alias("source_container"))
    t = containers.select(F.col("id").alias("target"), F.col("container").alias("target_container"))
    # edges are counted by ends and type before the containers are joined
    few = edges.groupBy("source", "target", "type").agg(F.count(F.lit(1)).alias("n"))
    met = few.join(s, "source").join(t, "target").where("source_container != target_container")
    return met.groupBy("source_container", "target_container").agg(F.sum("n").alias("count"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))


def layer_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``source_layer, target_layer, count`` across layers, by first layers (inferred definition)."""
    c = first_layer(members)
    s = c.select(F.col("node_id").alias("source"), F.col("layer_id").alias("source_layer"))
    t = c.select(F.col("node_id").alias("target"), F.col("layer_id").alias("target_layer"))
    met = edges.join(held(s), "source").join(held(t), "target").where("source_layer != target_layer")
    return met.groupBy("source_layer", "target_layer").agg(F.count(F.lit(1)).alias("count"))


def portals(edges: DataFrame, members: DataFrame, layer: str) -> DataFrame:
    """``layer_id, connections`` of the layers tied to one, in either direction (inferred definition)."""
    across = layer_edges(edges, members)
    out = across.where(F.col("source_layer") == layer).select(F.col("target_layer").alias("layer_id"), "count")
    into = across.where(F.col("target_layer") == layer).select(F.col("source_layer").alias("layer_id"), "count")
    return out.unionByName(into).groupBy("layer_id").agg(F.sum("count").alias("connections"))


def crossing_nodes(edges: DataFrame, members: DataFrame, layer: str, other: str) -> DataFrame:
    """``id`` of a layer's nodes with an edge to or from another layer (inferred definition)."""
    first = first_layer(members)
    a, b = (first.where(F.col("layer_id") == x).select("node_id") for x in (layer, other))
    ends = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target")))
    met = ends.join(b.withColumnRenamed("node_id", "target"), "target", "left_semi").join(a.withColumnRenamed("node_id", "source"), "source", "left_semi")
    return met.select(F.col("source").alias("id")).distinct()


def layer_stats(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """``layer_id, members, complexity``: complex beyond 30 % complex members, moderate beyond 30 % moderate ones, else simple."""
    c = F.col("complexity")
    per = members.join(nodes.select(F.col("id").alias("node_id"), "complexity"), "node_id").groupBy("layer_id")
    per = per.agg(F.count(F.lit(1)).alias("members"), F.count(F.when(c == "complex", 1)).alias("hard"), F.count(F.when(c == "moderate", 1)).alias("middle"))
    share = F.when(F.col("hard") > F.col("members") * 0.3, "complex").when(F.col("middle") > F.col("members") * 0.3, "moderate").otherwise("simple")
    return per.select("layer_id", "members", share.alias("complexity"))


def children(edges: DataFrame) -> DataFrame:
    """``id, children``: what a node contains."""
    return edges.where("type = 'contains'").groupBy(F.col("source").alias("id")).agg(F.count_distinct("target").alias("children"))


def directory_groups(nodes: DataFrame) -> DataFrame:
    """``id, container``: the first path segment after all paths' common prefix of directories (``~`` for files at its end)."""
    paths = nodes.where("file_path is not null").select("id", F.expr("slice(split(file_path, '/'), 1, size(split(file_path, '/')) - 1)").alias("dirs"))
    ends = paths.agg(F.min("dirs").alias("a"), F.max("dirs").alias("b"))
    common = F.expr("size(filter(sequence(1, least(size(a), size(b))), i -> i <= least(size(a), size(b)) and slice(a, 1, i) = slice(b, 1, i)))")
    shared = F.when((F.size("a") == 0) | (F.size("b") == 0), F.lit(0)).otherwise(common)
    met = paths.crossJoin(F.broadcast(ends.select(shared.alias("n"))))  # one row
    return met.select("id", F.coalesce(F.try_element_at("dirs", F.col("n") + 1), F.lit("~")).alias("container"))


def risk(changed: DataFrame, affected: DataFrame, layers: DataFrame, unmapped: int) -> DataFrame:
    """One row of the rules that hold for a change."""
    a = changed.agg(F.count(F.when(F.col("complexity") == "complex", 1)).alias("complex_changes"))
    b = affected.agg(F.count(F.lit(1)).alias("affected"))
    c = layers.agg(F.count(F.lit(1)).alias("layers"))
    one = a.crossJoin(b).crossJoin(c)  # one row each
    return one.select("*", F.lit(unmapped).cast("long").alias("unmapped"), (F.col("complex_changes") > 0).alias("has_complex"), (F.col("layers") > 1).alias("crosses_layers"), (F.col("affected") > 5).alias("wide"))


def ranked_first(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__rank = 1").drop("__rank")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, type`` of nodes that no edge touches."""
    ends = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id")))
    return nodes.join(ends, "id", "left_anti").select("id", "type")


def in_several_layers(members: DataFrame) -> DataFrame:
    """``node_id, n`` of nodes that more than one layer names."""
    return members.groupBy("node_id").agg(F.count_distinct("layer_id").alias("n")).where("n > 1")
