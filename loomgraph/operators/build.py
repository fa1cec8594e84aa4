"""Nodes and edges from parsed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from ..functions.columns import basename, lookup

# fixed values: node types of file categories and of definitions
FILE_NODES = {"config": ["config"], "document": ["docs"], "resource": ["infra"], "table": ["data"]}
DEFINITION_NODES = {"table": ["table", "view", "index"], "schema": ["message", "enum", "type", "input", "interface", "union", "scalar"], "resource": ["resource", "module"], "config": ["variable", "output", "key"]}


def default_weight(edge_type: Column) -> Column:
    return lookup(edge_type, v.EDGE_WEIGHTS, default=F.lit(0.5))


def complexity_of_lines(lines: Column) -> Column:
    """Non-empty lines: below 50 simple, to 200 moderate."""
    return F.when(lines < 50, "simple").when(lines <= 200, "moderate").otherwise("complex")


def significant(kind: Column, lines: Column, methods: Column, exported: Column) -> Column:
    """Functions of 10 lines, classes of 2 methods or 20 lines, and all that is exported, get nodes."""
    return exported | ((kind == "function") & (lines >= 10)) | ((kind == "class") & ((methods >= 2) | (lines >= 20)))


def file_nodes(files: DataFrame) -> DataFrame:
    """``id, type, name, file_path, complexity, ord`` of files (``path, category, lines, ord``)."""
    kind = lookup(F.col("category"), FILE_NODES, default=F.lit("file"))
    return files.select(F.concat(kind, F.lit(":"), "path").alias("id"), kind.alias("type"), basename(F.col("path")).alias("name"), F.col("path").alias("file_path"), complexity_of_lines(F.col("lines")).alias("complexity"), "ord")


def children(declared: DataFrame, parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and contains edges of declarations (``path, kind, name, line``) in files (``id, file_path``); of equal ids the first stays."""
    kind = F.when(F.col("kind").isin("function", "class"), F.col("kind")).otherwise(lookup(F.col("kind"), DEFINITION_NODES, default=F.lit("concept")))
    named = declared.select(F.concat_ws(":", kind, "path", "name").alias("id"), kind.alias("type"), "name", F.col("path").alias("file_path"), "line")
    nodes = named.groupBy("id").agg(F.min_by(F.struct("type", "name", "file_path"), "line").alias("r"), F.min("line").alias("ord")).select("id", "r.*", "ord")
    edges = nodes.join(parents.select(F.col("id").alias("source"), "file_path"), "file_path").select("source", F.col("id").alias("target"), F.lit("contains").alias("type"), F.lit("forward").alias("direction"), F.lit(1.0).alias("weight"), "ord")
    return nodes, edges


def linked(kind: str, pairs: DataFrame) -> DataFrame:
    """Edges of a type between ``source, target``, each pair once, of the type's weight."""
    return pairs.select("source", "target").distinct().select("source", "target", F.lit(kind).alias("type"), F.lit("forward").alias("direction"), default_weight(F.lit(kind)).alias("weight"))


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "-"), "^-|-$", "")


def step_slugs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, flow``: the slug of the flow that a step belongs to; the last edge wins."""
    flows = nodes.where("type = 'flow'").select(F.col("id").alias("source"), slug(F.col("name")).alias("flow"))
    return edges.where("type = 'flow_step'").join(flows, "source").groupBy(F.col("target").alias("id")).agg(F.max_by("flow", "ord").alias("flow"))
