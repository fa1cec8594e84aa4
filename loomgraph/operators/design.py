"""Design documents (recursive JSON) to pages, screens, components and tokens, by a walk of one level of the tree a round."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import mapped
from ..plans.loops import cut

# fixed values: node types of a design tree
DESIGN_TYPES = {"CANVAS": "page", "FRAME": "screen", "COMPONENT": "component", "COMPONENT_SET": "componentSet", "INSTANCE": "instance"}


def flatten(documents: DataFrame) -> DataFrame:
    """Every element of the trees (``doc, json``): ``doc, id, kind, node, name, component, styles, owner, owner_node, variant``.

    ``node`` is the node type it becomes, if any: pages, what lies on a page or in its
    sections, the variants of a set, and instances at any depth of a screen.  ``owner``
    is the nearest element above that became a node other than an instance.
    """
    spark = documents.sparkSession
    root = documents.select("doc", F.variant_get(F.try_parse_json("json"), "$.document", "variant").alias("x"))
    level = root.select("doc", "x", *[F.lit(None).cast("string").alias(c) for c in ("owner", "owner_node", "parent_kind")], F.lit(False).alias("open"))
    done = None
    for depth in count():
        eid, kind = F.variant_get("x", "$.id", "string"), F.variant_get("x", "$.type", "string")
        styles = F.map_values(F.coalesce(F.variant_get("x", "$.styles", "map<string,string>"), F.create_map().cast("map<string,string>")))
        variant = (kind == "COMPONENT") & F.coalesce(F.col("parent_kind") == "COMPONENT_SET", F.lit(False)) & F.coalesce(F.col("owner_node") == "componentSet", F.lit(False))
        becomes = (
            F.when((kind == "CANVAS") & F.lit(depth == 1), "page")
            .when(F.col("open") & kind.isin("FRAME", "COMPONENT", "COMPONENT_SET"), mapped(kind, DESIGN_TYPES))
            .when(variant, "component")
            .when((kind == "INSTANCE") & (F.col("owner_node") == "screen"), "instance")
        )
        this = level.select("doc", eid.alias("id"), kind.alias("kind"), becomes.alias("node"), F.variant_get("x", "$.name", "string").alias("name"), F.variant_get("x", "$.componentId", "string").alias("component"), styles.alias("styles"), "owner", "owner_node", variant.alias("variant"))
        done = this if done is None else done.unionByName(this)
        owns = becomes.isNotNull() & (becomes != "instance")
        level = level.select(
            "doc", F.when(owns, eid).otherwise(F.col("owner")).alias("owner"), F.when(owns, becomes).otherwise(F.col("owner_node")).alias("owner_node"), kind.alias("parent_kind"),
            (F.coalesce(becomes == "page", F.lit(False)) | (F.col("open") & (kind == "SECTION"))).alias("open"), F.explode(F.variant_get("x", "$.children", "array<variant>")).alias("x"),
        )
        level = cut(spark, level)
        if level.isEmpty():
            break
    return cut(spark, done)


def design_graph(flat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes ``id, type, name`` and edges: contains, variant_of, instance_of, uses_token (each style once a consumer)."""
    own, above = F.concat_ws(":", "node", "id"), F.concat_ws(":", "owner_node", "owner")
    made = flat.where("node is not null")
    nodes = made.groupBy(own.alias("id")).agg(F.first("node").alias("type"), F.first("name").alias("name"))
    edge = lambda df, s, t, k, w: df.select(s.alias("source"), t.alias("target"), F.lit(k).alias("type"), F.lit(w).alias("weight")).distinct()
    consumer = F.when(F.col("node").isNotNull(), own).when(F.col("owner").isNotNull(), above)
    tokens = flat.select(consumer.alias("c"), F.explode(F.transform("styles", lambda x: F.concat(F.lit("token:"), x))).alias("t")).where("c is not null")
    edges = (
        edge(made.where("owner is not null and not variant"), above, own, "contains", 1.0)
        .unionByName(edge(made.where("variant"), own, above, "variant_of", 0.9))
        .unionByName(edge(made.where("node = 'instance' and component is not null"), own, F.concat(F.lit("component:"), "component"), "instance_of", 0.8))
        .unionByName(edge(tokens, F.col("c"), F.col("t"), "uses_token", 0.5))
    )
    named = tokens.select(F.col("t").alias("id"), F.lit("token").alias("type"), F.substring("t", 7, 1 << 20).alias("name")).distinct()
    return nodes.unionByName(named), edges
