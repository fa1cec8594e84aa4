"""Source trees as tables: listing, languages, categories, sizes, digests."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from ..functions.columns import basename, lookup, mapped, utf16_order
from .ignore import ignored


def read_tree(spark: SparkSession, root: str, patterns: list[str] = ()) -> DataFrame:
    """``path (relative), size, content`` of the files that no pattern ignores, whole."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/") + "/"
    # the root may hold characters that patterns take for their own, so it is cut off by its length
    begin = F.instr("path", base.removeprefix("file:")) + len(base.removeprefix("file:"))
    path = F.substr(F.col("path"), begin)
    df = files.select(path.alias("path"), F.col("length").alias("size"), F.col("content").cast("string").alias("content"))
    return df.where(~ignored(F.col("path"), list(patterns)))


def ignore_accounting(paths: DataFrame, patterns: list[str]) -> DataFrame:
    """One row: files, and those that only the given patterns drop."""
    default, all_of = ignored(F.col("path")), ignored(F.col("path"), patterns)
    return paths.agg(F.count(F.when(~all_of, 1)).alias("files"), F.count(F.when(all_of & ~default, 1)).alias("filtered"))


def extension(path: Column) -> Column:
    """Lower case, without the dot; none for dot files."""
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]+)$", 1))


def detect_language(path: Column) -> Column:
    base, ext = basename(path), extension(path)
    dotted = F.regexp_extract(base, r"^\.(env)(?:\..*)?$", 1)
    by_ext = lookup(ext, v.LANGUAGE_EXTENSIONS)
    by_name = lookup(base, v.LANGUAGE_FILES)
    return F.when(base.rlike(r"^Dockerfile(\..*)?$"), "dockerfile").when(dotted != "", "config").when(by_ext.isNotNull(), by_ext).when(ext != "", ext).otherwise(F.coalesce(by_name, F.lit("unknown")))


def detect_category(path: Column) -> Column:
    base = basename(path)
    infra = (
        base.isin(v.INFRA_FILES)
        | base.startswith("Dockerfile.")
        | base.startswith("docker-compose.")
        | path.startswith(".github/workflows/")
        | path.startswith(".circleci/")
        | path.rlike(r"(^|/)(k8s|kubernetes)/")
        | base.rlike(r"(?i)\.k8s\.ya?ml$")
    )
    dotted = F.regexp_extract(base, r"^\.(env)(?:\..*)?$", 1)
    by_ext = lookup(F.when(extension(path) != "", extension(path)).otherwise(dotted), v.CATEGORY_EXTENSIONS)
    return F.when(base == "LICENSE", "code").when(infra, "infra").when(dotted != "", "config").otherwise(F.coalesce(by_ext, F.lit("code")))


def size_class(lines: Column) -> Column:
    return F.when(lines <= 30, "small").when(lines <= 150, "moderate").when(lines <= 500, "large").otherwise("very-large")


def inventory(tree: DataFrame) -> DataFrame:
    """``path, language, category, lines`` of a tree."""
    lines = F.length("content") - F.length(F.replace("content", F.lit("\n")))
    return tree.select("path", detect_language(F.col("path")).alias("language"), detect_category(F.col("path")).alias("category"), F.coalesce(lines, F.lit(0)).cast("long").alias("lines"))


def grouped_counts(rows: DataFrame, first: str, second: str) -> DataFrame:
    """Rows by one column, by the other and in all, ``level`` telling which."""
    return rows.groupingSets([[first], [second], []], first, second).agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"))


def scan_stats(found: DataFrame) -> DataFrame:
    """Counts by category, by language and in all."""
    return found.groupingSets([["category"], ["language"], []], "category", "language").agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"))


def content_digest(tree: DataFrame) -> str:
    """A hash of all files, framed: a tag, then of each file in code-unit order of the paths the path's length (4 bytes), the path, the content's length (8 bytes) and the content.

    The fold is sequential by its nature; files come one after the other and the driver holds one of them at a time.
    """
    h = hashlib.sha256(b"tree\0")
    for r in tree.select("path", F.col("content").cast("binary").alias("content")).orderBy(utf16_order(F.col("path"))).toLocalIterator():
        name, content = r.path.encode(), bytes(r.content or b"")
        h.update(len(name).to_bytes(4, "big") + name + len(content).to_bytes(8, "big") + content)
    return h.hexdigest()


def tree_digests(files: DataFrame) -> DataFrame:
    """``root, digest`` of many trees (``root, path, content``): of each file a hash of path and content, and of these, in order, one of the tree."""
    each = files.select("root", utf16_order(F.col("path")).alias("at"), F.sha2(F.concat("path", F.lit("\n"), F.sha2(F.coalesce("content", F.lit("")), 256)), 256).alias("h"))
    return each.groupBy("root").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: x["h"]), ""), 256).alias("digest"))


def frameworks(manifests: DataFrame) -> DataFrame:
    """``path, framework``: manifests (``path, content``) by name that hold one of a framework's words, in any case."""
    base, low = basename(F.col("path")), F.lower("content")
    found = []
    for name, (files, words) in v.FRAMEWORKS.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w.lower())
        found.append(F.when(base.isin(files) & hit, F.lit(name)))
    return manifests.select("path", F.explode(F.array_compact(F.array(*found))).alias("framework"))


def registered_language(path: Column, names: dict[str, str], extensions: dict[str, str]) -> Column:
    """By file name in any case, else by the last extension; null if neither is registered."""
    base = F.lower(basename(path))
    ext = F.regexp_extract(base, r"\.([^.]+)$", 1)
    by_name = mapped(base, {k.lower(): x for k, x in names.items()})
    return F.coalesce(by_name, mapped(ext, {k.lower(): x for k, x in extensions.items()}))


def starter_ignore(files: DataFrame) -> DataFrame:
    """``root, line``: commented suggestions for trees (``root, path, content``): folders that are known to hold no source, tests by language, and what their .gitignore names beyond the defaults."""
    folder = F.regexp_extract("path", "^([^/]+)/", 1)
    known = files.select("root", folder.alias("f")).where(F.col("f").isin("docs", "examples", "fixtures", "scripts", "public", "assets", "migrations")).select("root", F.concat(F.lit("# "), "f", F.lit("/")).alias("line"))
    language = detect_language(F.col("path"))
    tests = files.select("root", F.when(language.isin("typescript", "javascript"), "# **/*.test.*").when(language == "python", "# **/test_*.py").when(language == "go", "# **/*_test.go").alias("line")).where("line is not null")
    own = files.where("path = '.gitignore'").select("root", F.explode(F.split("content", "\n")).alias("p")).select("root", F.trim("p").alias("p"))
    rest = own.where((F.col("p") != "") & ~F.col("p").startswith("#") & ~F.col("p").isin(v.IGNORED)).select("root", F.concat(F.lit("# "), "p").alias("line"))
    return known.unionByName(tests).unionByName(rest).distinct()


def safe_path(path: Column, root: str) -> Column:
    """Absolute paths inside the root become relative, others their base name."""
    inside = path.startswith(root.rstrip("/") + "/")
    return F.when(inside, F.substr(path, F.lit(len(root.rstrip("/")) + 2))).when(path.startswith("/"), basename(path)).otherwise(path)
