"""Analytics over graphs: fans, scores, matrices, batches, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import basename, lookup, utf16_order
from ..functions.vocabulary import ENTRY_FILES, FILE_LABELS, FOLDER_LABELS, LAYER_PATTERNS
from ..plans.loops import held, numbered, parted


def fan(edges: DataFrame, inward: bool, k: int = 20) -> DataFrame:
    """``id, fan``: the k nodes with most distinct others that point to them (or that they point to)."""
    own, other = ("target", "source") if inward else ("source", "target")
    few = parted(edges.where("source != target").select(own, other), edges.count(), own, other).distinct()
    return few.groupBy(F.col(own).alias("id")).agg(F.count(F.lit(1)).alias("fan")).orderBy(F.desc("fan"), "id").limit(k)


def type_matrix(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``source_type, target_type, type, n``."""
    s = nodes.select(F.col("id").alias("source"), F.col("type").alias("source_type"))
    t = nodes.select(F.col("id").alias("target"), F.col("type").alias("target_type"))
    return edges.join(held(s), "source").join(held(t), "target").groupBy("source_type", "target_type", "type").agg(F.count(F.lit(1)).alias("n"))


def group_density(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """``container, inner, total, density`` (edges inside by edges that touch, 4 places)."""
    s = groups.select(F.col("id").alias("source"), F.col("container").alias("a"))
    t = groups.select(F.col("id").alias("target"), F.col("container").alias("b"))
    met = edges.join(s, "source").join(t, "target").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    ends = met.select(F.col("a").alias("container"), F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0).alias("inner"), "n").unionByName(
        met.where("a != b").select(F.col("b").alias("container"), F.lit(0).alias("inner"), "n")
    )
    per = ends.groupBy("container").agg(F.sum("inner").cast("long").alias("inner"), F.sum("n").alias("total"))
    return per.select("*", F.round(F.col("inner") / F.col("total"), 4).alias("density"))


def dominant_direction(between: DataFrame) -> DataFrame:
    """For each pair of groups (``source_container, target_container, count``) the direction with more edges, by name on a tie."""
    a, b = F.col("source_container"), F.col("target_container")
    pair = between.select(F.least(a, b).alias("first"), F.greatest(a, b).alias("second"), F.when(a < b, F.col("count")).otherwise(0).alias("out"), F.when(a < b, F.lit(0)).otherwise(F.col("count")).alias("back"))
    per = pair.groupBy("first", "second").agg(F.sum("out").cast("long").alias("out"), F.sum("back").cast("long").alias("back"))
    return per.select("first", "second", "out", "back", F.when(F.col("out") >= F.col("back"), F.concat_ws("->", "first", "second")).otherwise(F.concat_ws("->", "second", "first")).alias("dominant"))


def entry_scores(nodes: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """Entry points: name 3, shallow path 1, fan-out in the top tenth 1, fan-in in the bottom quarter 1; the root's README 5, its other Markdown files 2."""
    base = basename(F.col("file_path"))
    depth = F.size(F.split("file_path", "/")) - 1
    out = edges.groupBy(F.col("source").alias("id")).agg(F.count_distinct("target").alias("fan_out"))
    into = edges.groupBy(F.col("target").alias("id")).agg(F.count_distinct("source").alias("fan_in"))
    df = nodes.where("file_path is not null").join(out, "id", "left").join(into, "id", "left").fillna(0, ["fan_out", "fan_in"])
    # the two cuts are order statistics, found without ordering all nodes in one task
    cuts = df.agg(F.expr("percentile_disc(0.9) within group (order by fan_out)").alias("high"), F.expr("percentile_disc(0.25) within group (order by fan_in)").alias("low"))
    named = base.rlike(r"^(index|main|app|server|cli|__main__|manage)(\..*)?$") | base.isin(ENTRY_FILES)
    root = F.when(F.col("file_path") == "README.md", 5).when(F.col("file_path").rlike(r"^[^/]+\.md$"), 2).otherwise(0)
    score = root + F.when(named, 3).otherwise(0) + F.when(depth <= 1, 1).otherwise(0) + F.when((F.col("fan_out") >= F.col("high")) & (F.col("fan_out") > 0), 1).otherwise(0) + F.when(F.col("fan_in") <= F.col("low"), 1).otherwise(0)
    return df.crossJoin(F.broadcast(cuts)).select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)  # cuts: one row


def distribution(values: DataFrame, column: str) -> DataFrame:
    """``n, min, p50, p95, max, mean`` by nearest rank."""
    kind = dict(values.dtypes)[column]
    at = lambda p: F.expr(f"percentile_disc({p}) within group (order by {column})").cast(kind)
    return values.agg(F.count(column).alias("n"), F.min(column).alias("min"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.max(column).alias("max"), F.round(F.avg(column), 2).alias("mean"))


def layer_of_path(path: Column) -> Column:
    """The first layer, by priority, one of whose patterns (or its plural) is a segment of the path; null if none."""
    segments = F.split(F.lower(F.regexp_replace(path, r"\\", "/")), "/")
    out = None
    for name, patterns in LAYER_PATTERNS.items():
        hit = F.arrays_overlap(segments, F.array(*[F.lit(p + s) for p in patterns for s in ("", "s")]))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def detect_layers(nodes: DataFrame) -> DataFrame:
    """``id, layer``: files by path patterns, all others to Core."""
    return nodes.select("id", F.coalesce(layer_of_path(F.col("file_path")), F.lit("Core")).alias("layer"))


def apply_patterns(nodes: DataFrame, layers: list[tuple[str, list[str]]]) -> DataFrame:
    """``id, layer``: the first layer with a pattern that the path starts with or holds after a slash; else Other."""
    out = None
    for name, patterns in layers:
        hit = None
        for p in patterns:
            one = F.col("file_path").startswith(p) | F.col("file_path").contains("/" + p)
            hit = one if hit is None else hit | one
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return nodes.select("id", F.coalesce(out, F.lit("Other")).alias("layer"))


def count_batches(paths: DataFrame, size: int = 12) -> DataFrame:
    """``path, batch``: paths in code-unit order, so many a batch."""
    return numbered(paths.select("path"), [utf16_order(F.col("path"))], "at").select("path", F.floor(F.col("at") / size).alias("batch"))


def split_large(groups: DataFrame, most: int = 35) -> DataFrame:
    """``container, id, part``: groups of more than most members in ceil(n / most) parts of near-equal size, by id."""
    n = groups.groupBy("container").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("container").orderBy("id")) - 1
    parts = F.ceil(F.col("n") / most)
    met = groups.join(n, "container").withColumn("rank", rank)
    return met.select("container", "id", F.floor(F.col("rank") / F.ceil(F.col("n") / parts)).alias("part"))


def merge_small(groups: DataFrame, least: int = 3, size: int = 25) -> DataFrame:
    """``id, batch``: members of groups below least are pooled, by id, in batches of size; others keep their group's name."""
    n = groups.groupBy("container").agg(F.count(F.lit(1)).alias("n"))
    met = groups.join(n, "container")
    small = numbered(met.where(F.col("n") < least).select("id"), [F.col("id")], "rank")
    pooled = small.select("id", F.concat(F.lit("misc/"), F.floor(F.col("rank") / size).cast("string")).alias("batch"))
    return met.where(F.col("n") >= least).select("id", F.col("container").alias("batch")).unionByName(pooled)


def batch_neighbours(edges: DataFrame, batches: DataFrame, most: int = 50) -> DataFrame:
    """``id, neighbour`` in other batches, either direction; the most most-connected where a node has more."""
    both = edges.where("source != target").select(F.inline(F.array(F.struct(F.col("source").alias("id"), F.col("target").alias("neighbour")), F.struct(F.col("target").alias("id"), F.col("source").alias("neighbour"))))).where("id is not null and neighbour is not null").distinct()
    degree = both.groupBy(F.col("id").alias("neighbour")).agg(F.count(F.lit(1)).alias("degree"))
    own = batches.select("id", "batch")
    other = batches.select(F.col("id").alias("neighbour"), F.col("batch").alias("other")).join(degree, "neighbour")
    met = both.join(held(other), "neighbour").join(held(own), "id").where("batch != other")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("degree"), "neighbour"))
    return met.withColumn("rank", rank).where(F.col("rank") <= most).select("id", "neighbour")


def mutual_pairs(edges: DataFrame) -> DataFrame:
    """``a, b`` that point to each other."""
    e = edges.select("source", "target").distinct()
    back = e.select(F.col("target").alias("source"), F.col("source").alias("target"))
    return e.join(back, ["source", "target"]).where("source < target").select(F.col("source").alias("a"), F.col("target").alias("b"))


def folder_label(name: Column) -> Column:
    """What a folder's name says about what is in it; null if nothing."""
    return lookup(name, FOLDER_LABELS)


def path_label(path: Column) -> Column:
    """A file's own pattern, else the label of the nearest folder above that has one."""
    own = None
    for label, pattern in FILE_LABELS:
        own = F.when(path.rlike(pattern), label) if own is None else own.when(path.rlike(pattern), label)
    folders = F.reverse(F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1))
    named = F.get(F.filter(F.transform(folders, folder_label), lambda x: x.isNotNull()), F.lit(0))
    # the layout of some build tools says more than a folder's name
    tree = F.when(path.rlike("(^|/)src/main/java/"), "service").when(path.rlike("(^|/)src/test/java/"), "test")
    return F.coalesce(own, tree, named)


def deployment(files: DataFrame, by: list[str] = ()) -> DataFrame:
    """Whether trees (grouped ``by``) hold a Dockerfile, compose files, Kubernetes manifests, Terraform, CI; and how many such files."""
    base, path = F.element_at(F.split("path", "/"), -1), F.col("path")
    kinds = {
        "dockerfile": base.rlike(r"^Dockerfile(\..*)?$"),
        "compose": base.rlike(r"^(docker-)?compose[^/]*\.ya?ml$"),
        "k8s": path.rlike(r"(^|/)(k8s|kubernetes|helm|charts)/"),
        "terraform": base.rlike(r"\.tf(vars)?$"),
        "ci": path.rlike(r"(^|/)\.(github/workflows|circleci)/") | base.isin(".gitlab-ci.yml", "Jenkinsfile"),
    }
    every = None
    for hit in kinds.values():
        every = hit if every is None else every | hit
    return files.groupBy(*by).agg(*[F.coalesce(F.bool_or(hit), F.lit(False)).alias(f"has_{k}") for k, hit in kinds.items()], F.count_if(every).alias("infra_files"))


def documented_groups(files: DataFrame, by: list[str] = ()) -> DataFrame:
    """``groups, with_docs, coverage`` of trees: top folders that hold a README or that a file in docs is named after."""
    top, base = F.substring_index("path", "/", 1), F.element_at(F.split("path", "/"), -1)
    groups = files.where(F.col("path").contains("/") & (top != "docs")).groupBy(*by, top.alias("grp")).agg(F.bool_or(F.lower(base).startswith("readme.")).alias("own"))
    named = files.where("path like 'docs/%.md'").select(*by, F.regexp_replace(base, r"\.md$", "").alias("grp"), F.lit(True).alias("named")).distinct()
    met = groups.join(named, [*by, "grp"], "left")
    return met.groupBy(*by).agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("own") | F.coalesce("named", F.lit(False))).alias("with_docs")).withColumn("coverage", F.round(F.col("with_docs") / F.col("groups"), 4))


def inventory_families(nodes: DataFrame) -> DataFrame:
    """``family, id`` of nodes that are no code: documents, infrastructure, data, configuration."""
    families = {"documents": ["document"], "infrastructure": ["service", "resource", "pipeline"], "data": ["table", "schema", "endpoint"], "configuration": ["config"]}
    return nodes.select(lookup(F.col("type"), families).alias("family"), "id").where("family is not null")


def grouped_folders(paths: DataFrame, by: list[str] = ()) -> DataFrame:
    """``path, grp``: by the first folder after what all paths of a tree share; trees without folders by extension."""
    parts = F.split("path", "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    shared = lambda a, b: F.slice(a, F.lit(1), F.size(F.filter(F.transform(F.sequence(F.lit(1), F.least(F.size(a), F.size(b)) + 1), lambda n: (n <= F.least(F.size(a), F.size(b))) & (F.slice(a, F.lit(1), n) == F.slice(b, F.lit(1), n))), lambda x: x)))
    # the first and the last path in order share what all of them do
    ends = paths.groupBy(*by).agg(F.min(folders).alias("__a"), F.max(folders).alias("__b"), F.bool_or(F.col("path").contains("/")).alias("__deep"))
    ends = ends.select(*by, F.size(shared(F.col("__a"), F.col("__b"))).alias("__n"), "__deep")
    met = paths.join(ends, by) if by else paths.crossJoin(F.broadcast(ends))
    inner = F.when(F.size(parts) - 1 > F.col("__n"), F.get(parts, F.col("__n"))).otherwise("(root)")
    ext = F.regexp_extract("path", r"\.([^./]+)$", 1)
    return met.select(*by, "path", F.when(F.col("__deep"), inner).otherwise(F.when(ext != "", ext).otherwise("(none)")).alias("grp"))


def histogram(rows: DataFrame, *by: str) -> DataFrame:
    """How many rows there are of each combination of values."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def cross_check(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, problem``: files (``id``) without a node, nodes without a file."""
    f, n = files.select("id", F.lit(1).alias("__f")).distinct(), nodes.select("id", F.lit(1).alias("__n")).distinct()
    return f.join(n, "id", "full_outer").where("__f is null or __n is null").select("id", F.when(F.col("__f").isNull(), "no file").otherwise("no node").alias("problem"))


def coverage(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """One row: how many ids were expected and are covered, and their share to four places; 1 where nothing was expected."""
    met = wanted.select("id").join(found.select("id", F.lit(1).alias("__c")).distinct(), "id", "left")
    share = F.when(F.col("expected") == 0, 1.0).otherwise(F.round(F.col("covered") / F.col("expected"), 4))
    return met.agg(F.count(F.lit(1)).alias("expected"), F.count("__c").alias("covered")).select("expected", "covered", share.alias("coverage"))
