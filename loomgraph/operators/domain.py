"""The domain scan: which files are looked at, entry points, signatures, project metadata, and an answer of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .imports import directory

# fixed values: the scan's bounds, which are its feature
DEPTH, PER_FOLDER, FILES, ENTRIES, SAMPLED, LINES = 6, 50, 5000, 200, 40, 80
# fixed values: extensions of source files
EXTENSIONS = ["ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "pyi", "go", "rs", "java", "kt", "scala", "rb", "cs", "php", "swift", "c", "cpp", "h", "hpp", "ex", "exs", "hs", "lua", "r", "R"]
# fixed values: words of paths that make a file's signature likely to matter
PRIORITY = [
    "controller", "service", "handler", "router", "route", "api", "model", "entity", "repository", "usecase", "use_case", "command", "query",
    "event", "subscriber", "listener", "middleware", "guard", "interceptor", "resolver", "workflow", "flow", "process", "pipeline", "job", "task",
]
# fixed values: what entry points look like (type, pattern with the name, if any, in a group)
ENTRY_POINTS = [
    ("http", r"(?i)(?:app|router|server)\s*\.\s*(?:get|post|put|patch|delete|all|use)\s*\(\s*['\"](/[^'\"]*?)['\"]"),
    ("http", r"(?i)@(?:app\.)?(?:route|get|post|put|patch|delete|api_view|RequestMapping|GetMapping|PostMapping)\s*\(\s*['\"](/[^'\"]*?)['\"]"),
    ("http", r"export\s+(?:async\s+)?function\s+(?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\b"),
    ("cli", r"\.command\s*\(\s*['\"][\w\-:]+['\"]"),
    ("cli", r"add_parser\s*\(\s*['\"][\w\-]+['\"]"),
    ("event", r"\.on\s*\(\s*['\"][\w\-:.]+['\"]"),
    ("event", r"@(?:EventHandler|Subscribe|Listener|on_event)\s*\(\s*['\"][\w\-:.]+['\"]"),
    ("cron", r"(?i)@?(?:Cron|Schedule|Scheduled|crontab)\s*\(\s*['\"][^'\"]+['\"]"),
    ("http", r"@(?:Query|Mutation|Subscription|Resolver)\s*\("),
    ("http", r"(?m)^service\s+\w+\s*\{"),
    ("manual", r"export\s+(?:async\s+)?function\s+(?:handle\w+|process\w+|on\w+)\b"),
]
# fixed values: files that tell about a project, and how much of each is kept
METADATA = {"go.mod": 500, "Cargo.toml": 1000, "pyproject.toml": 1000, "Makefile": 1000, "README.md": 2000}
_TESTS = r"\.test\.|\.spec\.|__tests__|_test\.py|test_\w+\.py"


def scanned(files: DataFrame) -> DataFrame:
    """Source files (``path``, and any other columns): no deeper than DEPTH folders, the first PER_FOLDER of a folder, the first FILES in all, by path."""
    depth = F.size(F.split("path", "/")) - 1
    kept = files.where((depth <= DEPTH) & F.regexp_extract("path", r"\.([^./]+)$", 1).isin(EXTENSIONS))
    ranked = kept.withColumn("__rank", F.row_number().over(Window.partitionBy(directory(F.col("path"))).orderBy("path")))
    return ranked.where(F.col("__rank") <= PER_FOLDER).drop("__rank").orderBy("path").limit(FILES)


def entry_points(files: DataFrame, most: int = ENTRIES) -> DataFrame:
    """``path, line, type, match`` (120 characters) and ``snippet`` (5 lines, 300 characters), tests left out; the first ``most`` by path, pattern and place."""
    found = None
    for k, (kind, pattern) in enumerate(ENTRY_POINTS):
        # the text between matches gives their places
        parts = F.split("content", pattern)
        matches = F.regexp_extract_all("content", F.lit(pattern), 0)
        feeds = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n")))
        line = lambda i: F.aggregate(F.slice(parts, F.lit(1), i + 1), F.lit(1), lambda s, x: s + feeds(x)) + F.aggregate(F.slice(matches, F.lit(1), i), F.lit(0), lambda s, x: s + feeds(x))
        at = F.transform(matches, lambda m, i: F.struct(i.alias("i"), m.alias("match"), line(i).alias("line")))
        one = files.where(~F.col("path").rlike(_TESTS)).select("path", "content", F.lit(k).alias("k"), F.lit(kind).alias("type"), F.explode(at).alias("m"))
        found = one if found is None else found.unionByName(one)
    lines = F.array_join(F.slice(F.split("content", "\n"), F.col("m.line"), F.lit(5)), "\n")
    out = found.select("path", "k", "m.i", F.col("m.line").cast("long").alias("line"), "type", F.substring("m.match", 1, 120).alias("match"), F.substring(lines, 1, 300).alias("snippet"))
    return out.orderBy("path", "k", "i").limit(most).select("path", "line", "type", "match", "snippet")


def priority(path: Column) -> Column:
    low, score = F.lower(path), F.lit(0)
    for word in PRIORITY:
        score = score + low.contains(word).cast("int")
    return score


def signatures(files: DataFrame, most: int = SAMPLED) -> DataFrame:
    """``path, exports, imports, lines, preview`` of the files of highest priority (``path, ord, content``), from their first LINES lines."""
    top = files.withColumn("__score", priority(F.col("path"))).orderBy(F.desc("__score"), "ord").limit(most)
    head = F.array_join(F.slice(F.split("content", "\n"), 1, LINES), "\n")
    script = F.regexp_extract_all(head, F.lit(r"export\s+(?:default\s+)?(?:async\s+)?(?:function|class|const|let|var|interface|type|enum)\s+(\w+)"), 1)
    plain = F.regexp_extract_all(head, F.lit(r"(?m)^(?:def|class)\s+(\w+)"), 1)
    found = F.regexp_extract_all(head, F.lit(r"(import\s+.*?from\s+['\"][^'\"]+['\"]|from\s+[\w.]+\s+import)"), 1)
    source = F.transform(found, lambda x: F.regexp_extract(x, r"^(?:import\s+.*?from\s+['\"]([^'\"]+)['\"]|from\s+[\w.]+\s+import)$", 1))
    named = F.transform(found, lambda x: F.regexp_extract(x, r"^from\s+([\w.]+)\s+import$", 1))
    imports = F.zip_with(source, named, lambda a, b: F.when(a != "", a).otherwise(b))
    total = F.size(F.split("content", "\n")) - F.when(F.col("content").endswith("\n"), 1).otherwise(0)
    return top.select("path", F.slice(F.when(F.size(script) > 0, script).otherwise(plain), 1, 20).alias("exports"), F.slice(imports, 1, 20).alias("imports"), total.cast("long").alias("lines"), F.substring(head, 1, 500).alias("preview"))


def metadata(files: DataFrame) -> DataFrame:
    """``path, keys, text``: a package file's top keys; of the others as much text as is kept of their kind."""
    name = F.element_at(F.split("path", "/"), -1)
    kept = files.withColumn("__name", name).where(F.col("__name").isin("package.json", *METADATA))
    size = None
    for file, n in METADATA.items():
        size = F.when(F.col("__name") == file, n) if size is None else size.when(F.col("__name") == file, n)
    package = F.col("__name") == "package.json"
    return kept.select("path", F.when(package, F.json_object_keys("content")).alias("keys"), F.when(~package, F.substr("content", F.lit(1), size)).alias("text"))


def fitted(size: Column, most: int = 512 * 1024) -> Column:
    """How many of four cuts (snippets, previews, imports, half of the entries) an answer of parts' sizes needs to fit; 4 at most."""
    out = F.lit(4)
    for k in range(3, -1, -1):
        out = F.when(F.aggregate(F.slice(size, k + 1, 16), F.lit(0).cast("long"), lambda s, x: s + x) <= most, k).otherwise(out)
    return out


# fixed values: folders that no scan enters (the caller adds its own data folder)
SKIPPED = [
    "node_modules", ".git", ".svn", ".hg", "__pycache__", ".tox", "venv", ".venv", "env", ".env", "dist", "build", "out", ".next", ".nuxt", "target", "vendor",
    ".idea", ".vscode", "coverage", ".pytest_cache", ".mypy_cache", "Pods", "DerivedData", ".gradle", "bin", "obj",
]
# fixed values: files at a project's root that tell about it
ABOUT = [
    "package.json", "Cargo.toml", "go.mod", "pyproject.toml", "setup.py", "setup.cfg", "pom.xml", "build.gradle", "Gemfile", "composer.json", "mix.exs", "Makefile",
    "docker-compose.yml", "docker-compose.yaml", "README.md", "README.rst", "README.txt", "README",
]
#: Bytes of a whole context.
CONTEXT = 512 * 1024


def scanned_trees(files: DataFrame, skip: list[str] = (), most: int = FILES, per_folder: int = PER_FOLDER) -> DataFrame:
    """Source files of many trees (``root, path``, and any other columns) with their place ``ord`` in a walk that takes folders before files, both by name in any case.

    Folders of SKIPPED (and skip) are not entered, nor is what lies deeper than DEPTH folders; of a folder the first per_folder files count, of a tree the first ``most``.
    """
    parts = F.split("path", "/")
    inside = F.slice(parts, 1, F.size(parts) - 1)
    kept = files.where((F.size(inside) <= DEPTH) & ~F.arrays_overlap(inside, F.array(*map(F.lit, [*SKIPPED, *skip]))) & F.regexp_extract("path", r"[^/]\.([^./]+)$", 1).isin(EXTENSIONS))
    key = F.transform(parts, lambda x, k: F.concat(F.when(k < F.size(parts) - 1, "0").otherwise("1"), F.lower(x), F.lit("\x00"), x))
    walked = kept.withColumn("__key", key)
    first = walked.withColumn("__rank", F.row_number().over(Window.partitionBy("root", directory(F.col("path"))).orderBy("__key"))).where(F.col("__rank") <= per_folder)
    return first.withColumn("ord", F.row_number().over(Window.partitionBy("root").orderBy("__key"))).where(F.col("ord") <= most).drop("__rank", "__key")


def project_facts(files: DataFrame) -> DataFrame:
    """``root, file, name, description, scripts, dependencies, dev_dependencies, text`` of the ABOUT files at the roots of trees (``root, path, content``).

    A package file gives its name, description and the names of its scripts and dependencies, in their order, or its first 500 characters if it is no JSON object;
    readmes give 2,000 characters, files of settings 1,000, others nothing.
    """
    kept = files.where(F.col("path").isin(ABOUT))
    package = F.col("path") == "package.json"
    keys = F.json_object_keys("content")
    sound = package & keys.isNotNull()
    names = lambda k: F.when(sound, F.coalesce(F.json_object_keys(F.get_json_object("content", f"$.{k}")), F.array().cast("array<string>")))
    value = lambda k: F.when(sound, F.get_json_object("content", f"$.{k}"))
    size = F.when(package, 500).when(F.col("path").rlike(r"^README|\.(?:md|rst|txt)$"), 2000).when(F.col("path").rlike(r"\.(?:toml|cfg|mod|json|yml|yaml|xml|gradle)$"), 1000)
    told = kept.where(size.isNotNull())
    return told.select("root", F.col("path").alias("file"), value("name").alias("name"), value("description").alias("description"), names("scripts").alias("scripts"), names("dependencies").alias("dependencies"), names("devDependencies").alias("dev_dependencies"), F.when(~sound, F.substr(F.col("content"), F.lit(1), size)).alias("text"))


def fitted_context(tree: DataFrame, entries: DataFrame, found: DataFrame, most: int = CONTEXT) -> dict[str, DataFrame]:
    """``tree`` (root, ord, path), ``entries`` (root, ord, snippet, ...) and ``signatures`` (root, ord, preview, ...) of contexts that are cut until they fit, and ``cuts`` (root, cuts).

    The cuts, one after the other: the list of files to 200; previews to 200 characters; snippets to 100; signatures to 20 and entries to 100.
    A context's size is that of its rows as JSON, in bytes.
    """
    sized = lambda df, text, keep: (
        df.select("root", "ord", F.octet_length(F.to_json(F.struct(*[c for c in df.columns if c not in ("root", "ord")]))).alias("whole"), (F.octet_length(F.to_json(F.struct(F.col(text)))) - F.octet_length(F.to_json(F.struct(F.substring(text, 1, keep).alias(text))))).alias("saved"))
    )
    rows = sized(tree, "path", 1 << 30).withColumn("kind", F.lit("tree")).unionByName(sized(found, "preview", 200).withColumn("kind", F.lit("signature"))).unionByName(sized(entries, "snippet", 100).withColumn("kind", F.lit("entry")))
    is_ = lambda k: F.col("kind") == k
    sums = rows.groupBy("root").agg(
        F.sum("whole").alias("s0"),
        F.sum(F.when(is_("tree") & (F.col("ord") > 200), F.col("whole")).otherwise(0)).alias("c1"),
        F.sum(F.when(is_("signature"), F.col("saved")).otherwise(0)).alias("c2"),
        F.sum(F.when(is_("entry"), F.col("saved")).otherwise(0)).alias("c3"),
    )
    size = [F.col("s0"), F.col("s0") - F.col("c1"), F.col("s0") - F.col("c1") - F.col("c2"), F.col("s0") - F.col("c1") - F.col("c2") - F.col("c3")]
    cuts = F.lit(4)
    for k in range(3, -1, -1):
        cuts = F.when(size[k] <= most, k).otherwise(cuts)
    told = sums.select("root", cuts.alias("cuts"))
    met = lambda df: df.join(told, "root")
    at = F.col("cuts")
    return {
        "tree": met(tree).where((at < 1) | (F.col("ord") <= 200)).drop("cuts"),
        "signatures": met(found).where((at < 4) | (F.col("ord") <= 20)).withColumn("preview", F.when(at >= 2, F.substring("preview", 1, 200)).otherwise(F.col("preview"))).drop("cuts"),
        "entries": met(entries).where((at < 4) | (F.col("ord") <= 100)).withColumn("snippet", F.when(at >= 3, F.substring("snippet", 1, 100)).otherwise(F.col("snippet"))).drop("cuts"),
        "cuts": told,
    }
