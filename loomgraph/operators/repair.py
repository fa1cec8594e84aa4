"""Normalisation and repair of nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from ..functions.columns import lookup, number_prefix
from ..plans.loops import held

PREFIXES = sorted({t for types in v.NODE_TYPES.values() for t in types})


def canonical_node_type(kind: Column, design: bool = False) -> Column:
    tables = v.NODE_ALIASES, v.DESIGN_NODE_ALIASES if design else v.OTHER_NODE_ALIASES
    low = F.lower(kind)
    return lookup(low, *tables, default=low)


def canonical_edge_type(kind: Column, design: bool = False) -> Column:
    tables = v.EDGE_ALIASES, v.DESIGN_EDGE_ALIASES if design else v.OTHER_EDGE_ALIASES
    low = F.lower(kind)
    return lookup(low, *tables, default=low)


def canonical_direction(direction: Column) -> Column:
    low = F.lower(direction)
    known = lookup(low, v.DIRECTION_ALIASES, {d: [d] for d in v.DIRECTION_ALIASES})
    return F.coalesce(known, F.lit("forward"))


def canonical_complexity(value: Column) -> Column:
    """Names and aliases, numbers up to 3 and 6, else moderate; ``struct(complexity, status)``."""
    low = F.lower(F.trim(value))
    number = F.floor(F.when(low.rlike(r"^[+-]?\d+(\.\d+)?$"), low).try_cast("double"))
    named, alias = low.isin(v.COMPLEXITIES), lookup(low, v.COMPLEXITY_ALIASES)
    found = F.when(named, low).when(alias.isNotNull(), alias).when(number <= 3, "simple").when(number <= 6, "moderate").when(number.isNotNull(), "complex").otherwise("moderate")
    status = F.when(named, "valid").when(alias.isNotNull() | number.isNotNull(), "mapped").otherwise("unknown")
    return F.struct(found.alias("complexity"), status.alias("status"))


def sound_edges(edges: DataFrame) -> DataFrame:
    """Edges (``source, target, type, direction, weight`` as text) as they are kept: without a type they depend on their target, without a known direction they go forward."""
    kind = F.trim(F.coalesce("type", F.lit("")))
    return edges.withColumns({"type": F.when(kind == "", "depends_on").otherwise(canonical_edge_type(kind)), "direction": canonical_direction(F.trim("direction")), "weight": canonical_weight(F.col("weight"))})


def canonical_weight(weight: Column) -> Column:
    """A number from the string's beginning, 0.5 without one, held within 0 and 1."""
    return F.least(F.greatest(F.coalesce(number_prefix(weight), F.lit(0.5)), F.lit(0.0)), F.lit(1.0))


def canonical_id(node_id: Column, node_type: Column, name: Column, file_path: Column) -> Column:
    """Doubled and project prefixes go, ``func:`` becomes ``function:``, a missing prefix is added."""
    any_prefix = "|".join(PREFIXES)
    once = F.regexp_replace(node_id, f"^({any_prefix}):\\1:", "$1:")
    project = F.when(once.rlike(f"^(?!({any_prefix}):)[^:]+:({any_prefix}):"), F.regexp_replace(once, "^[^:]+:", "")).otherwise(once)
    full = F.regexp_replace(project, "^func:", "function:")
    prefix = F.when(node_type.isin(PREFIXES), node_type).otherwise("file")
    inside = F.concat(prefix, F.lit(":"), F.when(F.coalesce(file_path, F.lit("")) == "", F.lit("__nofilepath__")).otherwise(file_path), F.lit(":"), F.coalesce(name, full))
    added = F.when(node_type.isin("function", "class"), inside).otherwise(F.concat(prefix, F.lit(":"), full))
    return F.when(full.rlike(f"^({any_prefix}):"), full).otherwise(added)


def id_fix(original: Column, corrected: Column) -> Column:
    """What was mended about an id, for the report."""
    any_prefix = "|".join(PREFIXES)
    return (
        F.when(original == corrected, F.lit(None).cast("string"))
        .when(original.rlike(f"^({any_prefix}):\\1:"), "double prefix")
        .when(original.rlike(f"^(?!({any_prefix}):)[^:]+:({any_prefix}):"), "project-name prefix")
        .when(original.startswith("func:"), "prefix canonicalization")
        .otherwise("missing prefix")
    )


def last_nodes(nodes: DataFrame) -> DataFrame:
    """Of nodes with equal ids the last one's values, at the first one's place; an aggregate with a map-side part."""
    rest = [c for c in nodes.columns if c not in ("id", "ord")]
    best = nodes.groupBy("id").agg(F.max_by(F.struct(*rest), "ord").alias("__row"), F.min("ord").alias("ord"))
    return best.select(*[F.col(c) if c in ("id", "ord") else F.col(f"__row.{c}") for c in nodes.columns])


def dedup_edges(edges: DataFrame, keys: tuple[str, ...] = ("source", "target", "type", "direction"), winner: str = "weight") -> DataFrame:
    """One edge for each key: of the greatest weight, the earliest on a tie; or, with winner ``first``, the earliest.

    An aggregate with a map-side part, not a window: a key with very many edges never meets in one task.
    """
    rest = [c for c in edges.columns if c not in keys]
    row = F.struct(*rest)
    if winner == "first":
        best = F.min_by(row, "ord")
    else:
        best = F.max_by(row, F.struct(F.coalesce("weight", F.lit(0.0)), -F.col("ord")))
    return edges.groupBy(*keys).agg(best.alias("__row")).select(*[F.col(c) if c in keys else F.col(f"__row.{c}") for c in edges.columns])


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """All edges with ``reason``: missing-source, missing-target, missing-both, or null for sound ones."""
    s = nodes.select(F.col("id").alias("source"), F.lit(True).alias("__s")).distinct()
    t = nodes.select(F.col("id").alias("target"), F.lit(True).alias("__t")).distinct()
    met = edges.join(held(s), "source", "left").join(held(t), "target", "left")
    reason = F.when(F.col("__s").isNull() & F.col("__t").isNull(), "missing-both").when(F.col("__s").isNull(), "missing-source").when(F.col("__t").isNull(), "missing-target")
    return met.select(*edges.columns, reason.alias("reason"))


def remap_ends(edges: DataFrame, moved: DataFrame) -> DataFrame:
    """Ends by ``old, new``; others stay."""
    m = moved.groupBy("old").agg(F.max_by("new", "ord").alias("new"))
    out = edges.join(m.select(F.col("old").alias("source"), F.col("new").alias("__s")), "source", "left").join(m.select(F.col("old").alias("target"), F.col("new").alias("__t")), "target", "left")
    return out.select(F.coalesce("__s", "source").alias("source"), F.coalesce("__t", "target").alias("target"), *[c for c in edges.columns if c not in ("source", "target")])


def node_defaults(nodes: DataFrame) -> DataFrame:
    """Missing types, complexities, tags and summaries filled in; ``issues`` lists what was."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    issues = F.array_compact(F.array(*[F.when(blank(c), F.lit(f"missing {c}")) for c in ("type", "complexity", "summary")], F.when(F.col("tags").isNull(), F.lit("missing tags"))))
    return nodes.select(
        *[c for c in nodes.columns if c not in ("type", "complexity", "summary", "tags")],
        F.when(blank("type"), F.lit("file")).otherwise(canonical_node_type(F.col("type"))).alias("type"),
        canonical_complexity(F.col("complexity"))["complexity"].alias("complexity"),
        F.when(~blank("summary"), F.col("summary")).otherwise(F.coalesce("name", F.lit("No summary"))).alias("summary"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        issues.alias("issues"),
    )


def issue_counts(df: DataFrame) -> DataFrame:
    return df.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


def recovered_imports(edges: DataFrame, imports: DataFrame, files: DataFrame) -> DataFrame:
    """``imports`` edges between known files that the graph lacks."""
    ids = files.select("id")
    want = imports.select("source", "target").distinct().where("source != target")
    want = want.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    have = edges.where("type = 'imports'").select("source", "target")
    return want.join(have, ["source", "target"], "left_anti").select("source", "target", F.lit("imports").alias("type"), F.lit("forward").alias("direction"), F.lit(0.7).alias("weight"))


def peeled_id(node_id: Column, node_type: Column, name: Column, file_path: Column, flow: Column) -> Column:
    """The other dialect of ids: segments before the last valid prefix go; bare paths get their type's prefix.

    Functions and classes without a prefix are named after file and name, steps after flow, file and slug.
    """
    any_prefix = "|".join(PREFIXES)
    path = F.coalesce(file_path, F.lit(""))
    plain = F.trim(node_id)
    # what stands before the first valid prefix goes, then all valid prefixes but the last of a row of them
    led = F.regexp_replace(plain, rf"^(?:(?!(?:{any_prefix}):)[^:]+:)+(?=(?:{any_prefix}):)", "")
    once = F.regexp_replace(led, rf"^(?:(?:{any_prefix}):)+(?=(?:{any_prefix}):)", "")
    valid = once.rlike(f"^(?:{any_prefix}):")
    rest = F.regexp_replace(once, "^[^:]+:", "")
    parts = F.split(rest, ":")
    own = F.element_at(F.split(once, ":"), 1)
    step = F.when(F.size(parts) > 1, F.concat_ws(":", own, F.element_at(parts, -2), path, F.element_at(parts, -1))).otherwise(F.concat_ws(":", own, path, F.element_at(parts, -1)))
    bare = F.regexp_replace(plain, r"^(?:[^:]+:)+", "")
    slug = F.regexp_replace(F.lower(bare), r"\s+", "-")
    named = (
        F.when(node_type.isin("function", "class") & (path != "") & (F.coalesce(name, F.lit("")) != ""), F.concat_ws(":", node_type, path, name))
        .when((node_type == "step") & (path != ""), F.concat_ws(":", F.lit("step"), flow, path, slug))
        .otherwise(F.concat_ws(":", node_type, bare))
    )
    return F.when(plain == "", plain).when(valid, F.when((node_type == "step") & (path != ""), step).otherwise(once)).when(node_type.isin(PREFIXES), named).otherwise(plain)
