"""Import resolution: candidates are spread out with their order, met with the files by equality, and the first is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: what a relative import may stand for, in order
PROBES = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]

# fixed values: sources of compiled names, in order
COMPILED = {".js": [".ts", ".tsx", ".js", ".jsx"], ".jsx": [".tsx", ".jsx"], ".mjs": [".mts", ".mjs", ".ts"], ".cjs": [".cts", ".cjs", ".ts"]}


def normal_path(path: Column) -> Column:
    """Without ``.`` and ``..`` parts; null if it leaves the root."""
    empty = F.array().cast("array<string>")
    folded = F.aggregate(
        F.split(path, "/"),
        F.struct(empty.alias("parts"), F.lit(True).alias("inside")),
        lambda s, p: F.when(p.isin("", "."), s)
        .when((p == "..") & (F.size(s["parts"]) > 0), F.struct(F.slice(s["parts"], F.lit(1), F.size(s["parts"]) - 1).alias("parts"), s["inside"].alias("inside")))
        .when(p == "..", F.struct(s["parts"].alias("parts"), F.lit(False).alias("inside")))
        .otherwise(F.struct(F.concat(s["parts"], F.array(p)).alias("parts"), s["inside"].alias("inside"))),
    )
    return F.when(folded["inside"], F.array_join(folded["parts"], "/"))


def ancestors(directory: Column) -> Column:
    """A folder and those above it, deepest first, the root as ``''``."""
    parts = F.filter(F.split(directory, "/"), lambda p: p != "")
    return F.transform(F.reverse(F.sequence(F.lit(0), F.size(parts))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def _first(candidates: DataFrame, files: DataFrame) -> DataFrame:
    met = candidates.join(files.select(F.col("path").alias("candidate")).distinct(), "candidate")
    return met.groupBy("source", "raw").agg(F.min_by("candidate", "rank").alias("target"))


def relative_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``source, raw, target`` of imports that begin with a dot: exact, then the source of a compiled name, then the probes."""
    rel = imports.where("raw rlike '^[.]{1,2}(/|$)'").select("source", "raw", normal_path(F.concat_ws("/", directory(F.col("source")), "raw")).alias("base")).where("base is not null")
    return _first(rel.select("source", "raw", F.posexplode(script_candidates(F.col("base"))).alias("rank", "candidate")), files)


def script_candidates(base: Column) -> Column:
    """What a script's path may stand for, in order: of a compiled name itself and its sources, and nothing else; of others the probes."""
    stem, out = F.regexp_replace(base, r"\.[^./]+$", ""), F.transform(F.array(*map(F.lit, PROBES)), lambda x: F.concat(base, x))
    for compiled, sources in COMPILED.items():
        out = F.when(base.endswith(compiled), F.concat(F.array(base), F.transform(F.array(*map(F.lit, sources)), lambda x: F.concat(stem, x)))).otherwise(out)
    return out


def python_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``source, raw, target``: dots climb; absolute names are tried from every folder above, the deepest first.

    Names that are imported from a package (``names``, where there is such a column) are tried as its modules too.
    """
    if "names" in imports.columns:
        whole = imports.select("source", "raw")
        parts = imports.select("source", F.col("raw").alias("own"), F.explode("names").alias("n")).select("source", F.concat("own", F.when(F.col("own").rlike(r"^\.*$"), "").otherwise("."), "n").alias("raw"))
        return python_imports(whole.unionByName(parts).distinct(), files)
    dots = F.length(F.regexp_extract("raw", r"^(\.*)", 1))
    name = F.replace(F.regexp_replace("raw", r"^\.+", ""), F.lit("."), F.lit("/"))
    above = ancestors(directory(F.col("source")))
    roots = F.when(dots > 0, F.slice(above, dots, F.lit(1))).otherwise(above)
    spread = imports.withColumn("name", name).withColumn("roots", roots).select("source", "raw", F.explode(F.transform("roots", lambda r, i: F.struct(i.alias("i"), F.concat_ws("/", F.when(r != "", r), F.when(F.col("name") != "", F.col("name"))).alias("base")))).alias("x"))
    ends = F.array(F.lit(".py"), F.lit("/__init__.py"))
    spread = spread.select("source", "raw", (F.col("x.i") * 2).alias("i"), "x.base", F.posexplode(ends).alias("j", "end"))
    return _first(spread.select("source", "raw", (F.col("i") + F.col("j")).alias("rank"), F.concat("base", "end").alias("candidate")), files)


def suffix_imports(imports: DataFrame, files: DataFrame, extension: str) -> DataFrame:
    """``source, raw, target`` of dotted names (Java, Kotlin, C#): every file whose path ends so; suffixes make it an equality join."""
    parts = F.split("path", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))
    index = files.where(F.col("path").endswith(extension)).select(F.col("path").alias("target"), F.explode(suffixes).alias("suffix"))
    want = imports.select("source", "raw", F.concat(F.replace("raw", F.lit("."), F.lit("/")), F.lit(extension)).alias("suffix"))
    return want.join(index, "suffix").where("target != source").select("source", "raw", "target")


def nearest_config(files: DataFrame, configs: DataFrame) -> DataFrame:
    """``path, config``: the configuration in the deepest folder above each file."""
    own = files.select("path", F.explode(ancestors(directory(F.col("path")))).alias("dir"))
    at = configs.select(directory(F.col("config")).alias("dir"), "config")
    return own.join(at, "dir").groupBy("path").agg(F.max_by("config", F.struct(F.length("dir"), "config")).alias("config"))


def go_imports(imports: DataFrame, files: DataFrame, modules: DataFrame) -> DataFrame:
    """``source, raw, target``: the module's prefix goes, and all of the folder's files are met (``modules``: config, module)."""
    near = nearest_config(imports.select(F.col("source").alias("path")).distinct(), modules.select("config"))
    met = imports.join(near.withColumnRenamed("path", "source"), "source").join(modules, "config")
    inside = met.where((F.col("raw") == F.col("module")) | F.expr("startswith(raw, concat(module, '/'))"))
    rest = F.expr("substring(raw, length(module) + 2)")
    folder = F.concat_ws("/", F.when(directory(F.col("config")) != "", directory(F.col("config"))), F.when(rest != "", rest))
    index = files.where("path like '%.go'").select(F.col("path").alias("target"), directory(F.col("path")).alias("folder"))
    return inside.select("source", "raw", folder.alias("folder")).join(index, "folder").select("source", "raw", "target")


def import_map(files: DataFrame, resolved: DataFrame) -> DataFrame:
    """``path, targets``: sorted, without repeats; files without imports have an empty list."""
    per = resolved.groupBy(F.col("source").alias("path")).agg(F.array_sort(F.collect_set("target")).alias("targets"))
    return files.select("path").join(per, "path", "left").select("path", F.coalesce("targets", F.array().cast("array<string>")).alias("targets"))


def is_test_path(path: Column) -> Column:
    """Test files by their names (specs of Kotlin too)."""
    base = F.element_at(F.split(path, "/"), -1)
    return (
        base.rlike(r"\.(test|spec)\.([jt]sx?|[cm]js|vue)$")
        | base.rlike(r"^(test_.*|.*_test)\.py$")
        | base.endswith("_test.go")
        | base.rlike(r"(Test|Tests|IT)\.java$")
        | base.rlike(r"(Test|Tests)\.cs$")
        | base.rlike(r"(Spec|Test|Tests)\.kt$")
        | base.rlike(r"(Spec|Suite|Test|Tests)\.scala$")
        | base.rlike(r"(^test_.*|_test)\.(c|cc|cpp)$")
    )


def canonical_tests(edges: DataFrame) -> DataFrame:
    """tested_by edges from production to test: turned where they point the other way, dropped between files of one kind; the heavier of a pair stays."""
    path = lambda c: F.regexp_replace(c, "^[a-z]+:", "")
    t = edges.where("type = 'tested_by'").withColumns({"__s": is_test_path(path(F.col("source"))), "__t": is_test_path(path(F.col("target")))}).where("__s != __t")
    turned = t.select(F.when(F.col("__s"), F.col("target")).otherwise(F.col("source")).alias("source"), F.when(F.col("__s"), F.col("source")).otherwise(F.col("target")).alias("target"), "type", "direction", "weight", "ord")
    best = turned.groupBy("source", "target").agg(F.max_by(F.struct("type", "direction", "weight"), F.struct("weight", -F.col("ord"))).alias("r"), F.min("ord").alias("ord"))
    return best.select("source", "target", "r.type", "r.direction", "r.weight", "ord")


def required_literals(files: DataFrame) -> DataFrame:
    """``source, raw`` of ``require('…')`` with a literal, comments left out."""
    plain = F.regexp_replace(F.regexp_replace("content", r"(?s)/\*.*?\*/", ""), r"(?m)(^|\s)//[^\n]*", "$1")
    return files.select(F.col("path").alias("source"), F.explode(F.regexp_extract_all(plain, F.lit(r"\brequire\(\s*['\"]([^'\"]+)['\"]\s*\)"), 1)).alias("raw"))


def alias_imports(imports: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """``source, raw, target`` by the nearest configuration's path aliases (``config, ord, pattern, substitute, base_url``).

    A pattern has one ``*`` at most; the first pattern in declared order that meets a file wins; no target leaves the root.
    The rules of a configuration are few, and met by equality on the configuration.
    """
    near = nearest_config(imports.select(F.col("source").alias("path")).distinct(), aliases.select("config").distinct())
    met = imports.join(near.withColumnRenamed("path", "source"), "source").join(aliases, "config")
    head, tail = F.substring_index("pattern", "*", 1), F.when(F.col("pattern").contains("*"), F.substring_index("pattern", "*", -1)).otherwise("")
    star = F.col("pattern").contains("*")
    fits = F.when(star, F.col("raw").startswith(head) & F.col("raw").endswith(tail) & (F.length("raw") >= F.length(head) + F.length(tail))).otherwise(F.col("raw") == F.col("pattern"))
    middle = F.when(star, F.substr("raw", F.length(head) + 1, F.length("raw") - F.length(head) - F.length(tail))).otherwise("")
    base = normal_path(F.concat_ws("/", F.when(directory(F.col("config")) != "", directory(F.col("config"))), "base_url", F.replace("substitute", F.lit("*"), middle)))
    kept = met.where(fits).select("source", "raw", "ord", base.alias("base")).where("base is not null")
    spread = kept.select("source", "raw", "ord", F.posexplode(script_candidates(F.col("base"))).alias("probe", "candidate"))
    return _first(spread.select("source", "raw", (F.col("ord") * len(PROBES) + F.col("probe")).alias("rank"), "candidate"), files)


def ruby_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``require_relative`` from the file's folder, ``require`` from lib, app and the root (``relative``: which of them)."""
    name = F.regexp_replace("raw", r"\.rb$", "")
    here = F.array(normal_path(F.concat_ws("/", directory(F.col("source")), name)))
    roots = F.transform(F.array(F.lit("lib/"), F.lit("app/"), F.lit("")), lambda r: F.concat(r, name))
    spread = imports.select("source", "raw", F.posexplode(F.when(F.col("relative"), here).otherwise(roots)).alias("rank", "base")).where("base is not null")
    return _first(spread.select("source", "raw", "rank", F.concat("base", F.lit(".rb")).alias("candidate")), files)


def psr4_imports(imports: DataFrame, files: DataFrame, rules: DataFrame) -> DataFrame:
    """PHP classes by the nearest composer file's longest fitting prefix (``config, prefix, ord, folder``), whole segments of it, the first folder that has the file."""
    near = nearest_config(imports.select(F.col("source").alias("path")).distinct(), rules.select("config").distinct())
    met = imports.join(near.withColumnRenamed("path", "source"), "source").join(rules, "config").withColumn("whole", F.when(F.col("prefix") == "", "").otherwise(F.concat(F.rtrim("prefix", F.lit("\\")), F.lit("\\")))).where("startswith(raw, whole)")
    rest = F.translate(F.expr("substring(raw, length(whole) + 1)"), "\\", "/")
    base = normal_path(F.concat_ws("/", F.when(directory(F.col("config")) != "", directory(F.col("config"))), "folder", rest))
    return _first(met.select("source", "raw", F.struct((-F.length("whole")).alias("a"), (F.col("ord") if "ord" in rules.columns else F.col("folder")).alias("b")).alias("rank"), F.concat(base, F.lit(".php")).alias("candidate")), files)


def rust_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``crate``, ``super`` and ``self`` paths: the longest part of the path that is a file, ``x.rs`` before ``x/mod.rs``."""
    parts = F.split(F.regexp_replace("raw", r"::\{.*$|::\*$", ""), "::")
    folder = directory(F.col("source"))
    stem = F.regexp_extract("source", r"([^/]+)\.rs$", 1)
    own = F.when(stem.isin("mod", "lib", "main"), folder).otherwise(F.concat_ws("/", F.when(folder != "", folder), stem))
    crate = F.regexp_extract("source", r"^(.*?src)(?:/|$)", 1)
    mods = imports.where("raw rlike '^mod '").select("source", "raw", own.alias("own"), F.regexp_extract("raw", r"^mod\s+(\w+)", 1).alias("m"))
    named = mods.select("source", "raw", F.posexplode(F.array(*[F.concat_ws("/", F.when(F.col("own") != "", F.col("own")), F.concat("m", F.lit(e))) for e in (".rs", "/mod.rs")])).alias("rank", "candidate"))
    base = F.when(parts[0] == "crate", crate).when(parts[0] == "self", own).when(parts[0] == "super", directory(own))
    cut = F.explode(F.transform(F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), lambda n: F.struct((F.size(parts) - n).alias("i"), F.array_join(F.slice(parts, F.lit(2), n), "/").alias("rest"))))
    spread = imports.where("raw rlike '^(crate|self|super)::'").select("source", "raw", base.alias("base"), cut.alias("x"))
    ends = F.posexplode(F.array(F.lit(".rs"), F.lit("/mod.rs")))
    spread = spread.select("source", "raw", (F.col("x.i") * 2).alias("i"), F.concat_ws("/", F.when(F.col("base") != "", F.col("base")), "x.rest").alias("base"), ends.alias("j", "end"))
    return _first(spread.select("source", "raw", (F.col("i") + F.col("j")).alias("rank"), F.concat("base", "end").alias("candidate")).unionByName(named), files)


def include_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """C and C++ includes: the file's folder, include, src, the root."""
    here = normal_path(F.concat_ws("/", directory(F.col("source")), "raw"))
    places = F.array(here, F.concat(F.lit("include/"), "raw"), F.concat(F.lit("src/"), "raw"), F.col("raw"))
    return _first(imports.select("source", "raw", F.posexplode(places).alias("rank", "candidate")), files)


def module_imports(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Swift modules: every file of the module but the importer (``modules``: module, path)."""
    return imports.join(modules.select(F.col("module").alias("raw"), F.col("path").alias("target")), "raw").where("target != source").select("source", "raw", "target")


# fixed values: extensions of one family of scripts, in the order they are tried, and folders that a tree of tests mirrors
SCRIPTS, MIRRORED = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".vue"], ["src", "app", "lib", ""]


def production_candidates(path: Column) -> Column:
    """Where a test's subject may lie, in order: beside it, outside the folder of tests it is in, in the tree that its tree mirrors."""
    base, folder = F.element_at(F.split(path, "/"), -1), directory(path)
    ext = F.regexp_extract(base, r"^.+(\.[^.]+)$", 1)
    stem = F.when(ext != "", F.substr(base, F.lit(1), F.length(base) - F.length(ext))).otherwise(base)
    segments = F.filter(F.split(folder, "/"), lambda x: x != "")
    n = F.size(segments)
    to = lambda xs: F.array_join(xs, "/")
    at = lambda d, name: F.concat_ws("/", F.when(d != "", d), name)
    parent, tail = to(F.slice(segments, 1, F.greatest(n - 1, F.lit(0)))), to(F.slice(segments, 2, F.greatest(n - 1, F.lit(0))))
    first, last = F.coalesce(F.get(segments, F.lit(0)), F.lit("")), F.coalesce(F.get(segments, n - 1), F.lit(""))
    none = F.array().cast("array<string>")
    cut_ = lambda pattern: F.regexp_replace(stem, pattern, "")
    only = lambda test, xs: F.when(test, xs).otherwise(none)
    mirrors = [F.concat_ws("/", F.when(F.lit(root != ""), F.lit(root)), F.when(tail != "", tail)) for root in MIRRORED]

    script = cut_(r"\.(test|spec)$")
    family = lambda d: F.array(at(d, F.concat(script, ext)), *(at(d, F.concat(script, F.lit(x))) for x in SCRIPTS))
    scripts = F.concat(family(folder), only(last.isin("__tests__", "test", "spec", "tests"), family(parent)), only(first.isin("tests", "test", "__tests__"), F.concat(*map(family, mirrors))))
    plain = F.when(stem.startswith("test_"), F.substr(stem, F.lit(6))).otherwise(cut_("_test$"))
    py = F.concat(plain, F.lit(".py"))
    python = F.concat(F.array(at(folder, py)), only(last.isin("tests", "test"), F.array(at(parent, py))), only(first.isin("tests", "test"), F.array(*(at(d, py) for d in mirrors))))

    def layout(name: str, suffixes: str, anywhere: bool = False) -> Column:
        """The main tree of a build's layout, the folder itself, then the main tree of a layout without a folder for the language."""
        own = F.concat(cut_(f"({suffixes})$"), ext)
        there = rf"^(|.*?/)src/test/{name}(/|$)" if anywhere else rf"^()src/test/{name}(/|$)"
        return F.concat(only(folder.rlike(there), F.array(at(F.regexp_replace(folder, there, f"$1src/main/{name}$2"), own))), F.array(at(folder, own), at(F.regexp_replace(folder, r"(^|/)src/test(/|$)", "$1src/main$2"), own)))

    cs = F.concat(cut_("(Tests|Test)$"), F.lit(".cs"))
    place = F.array_max(F.transform(segments, lambda x, k: F.when(F.lower(x).isin("tests", "test"), k + 1).otherwise(0)))  # the last folder of tests, from 1
    above, below = F.slice(segments, 1, F.greatest(place - 1, F.lit(0))), F.slice(segments, place + 1, n)
    sibling = F.regexp_replace(first, r"\.Tests?$", "")
    sharp = F.concat(
        F.array(at(folder, cs)),
        only(F.coalesce(place, F.lit(0)) > 0, F.array(at(to(above), cs), at(to(F.concat(above, F.array(F.lit("src")), below)), cs))),
        only((sibling != first) & (sibling != ""), F.array(at(F.concat_ws("/", sibling, F.when(tail != "", tail)), cs))),
    )
    found = (
        F.when(ext.isin(SCRIPTS) & stem.rlike(r"\.(test|spec)$"), scripts)
        .when((ext == ".go") & stem.endswith("_test"), F.array(at(folder, F.concat(cut_("_test$"), ext))))
        .when((ext == ".py") & (stem.startswith("test_") | stem.endswith("_test")), python)
        .when((ext == ".java") & stem.rlike("(Tests|Test|IT)$"), layout("java", "Tests|Test|IT"))
        .when((ext == ".kt") & stem.rlike("(Tests|Test|Spec)$"), layout("kotlin", "Tests|Test|Spec"))
        .when((ext == ".scala") & stem.rlike("(Spec|Suite|Tests|Test)$"), layout("scala", "Spec|Suite|Tests|Test", True))
        .when((ext == ".cs") & stem.rlike("(Tests|Test)$"), sharp)
        .when(ext.isin(".c", ".cpp", ".cc") & (stem.startswith("test_") | stem.endswith("_test")), F.array(at(folder, F.concat(plain, ext))))
        .otherwise(none)
    )
    return F.array_distinct(found)


def supplied_tests(tests: DataFrame, files: DataFrame, paired: DataFrame) -> DataFrame:
    """tested_by edges (weight 0.5) from the first candidate that is a file and no test, for tests that have none yet (``paired.target``)."""
    left = tests.select("path").join(paired.select(F.regexp_replace("target", "^file:", "").alias("path")), "path", "left_anti")
    spread = left.select(F.col("path").alias("source"), F.lit("").alias("raw"), F.posexplode(production_candidates(F.col("path"))).alias("rank", "candidate"))
    met = _first(spread, files.where(~is_test_path(F.col("path"))))
    file = lambda c: F.concat(F.lit("file:"), c)
    return met.select(file(F.col("target")).alias("source"), file(F.col("source")).alias("target"), F.lit("tested_by").alias("type"), F.lit("forward").alias("direction"), F.lit(0.5).alias("weight"))


def tag_tested(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The tag ``tested``, once, on every node that a tested_by edge leaves."""
    own = edges.where("type = 'tested_by'").select(F.col("source").alias("id"), F.lit(True).alias("__t")).distinct()
    return nodes.join(own, "id", "left").withColumn("tags", F.when(F.col("__t"), F.array_union("tags", F.array(F.lit("tested")))).otherwise(F.col("tags"))).select(nodes.columns)


def scala_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``source, raw, target``: plain names, lists in braces, and wildcards (all files of the package), by path suffixes; else the package object's file."""
    head, inner = F.regexp_replace("raw", r"\.\{.*$", ""), F.regexp_extract("raw", r"\{([^}]*)\}", 1)
    picked = F.transform(F.filter(F.split(inner, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(F.regexp_replace(x, r"=>.*$|\bas\b.*$", "")))
    names = F.when(inner != "", F.transform(picked, lambda x: F.concat(head, F.lit("."), x))).otherwise(F.array("raw"))
    each = imports.select("source", "raw", F.explode(names).alias("name"))
    wild = each.where("name rlike '[.](_|[*])$'").select("source", "raw", F.translate(F.regexp_replace("name", r"\.(_|\*)$", ""), ".", "/").alias("suffix"))
    plain = each.where("name not rlike '[.](_|[*])$'").select("source", "raw", F.translate("name", ".", "/").alias("suffix"))
    scala = files.where("path like '%.scala'").select(F.col("path").alias("target"))
    ends = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda n: F.array_join(F.slice(F.split(c, "/"), n, F.size(F.split(c, "/"))), "/"))
    by_name = scala.select("target", F.explode(ends(F.regexp_replace("target", r"\.scala$", ""))).alias("suffix"))
    by_folder = scala.select("target", F.explode(ends(directory(F.col("target")))).alias("suffix"))
    met = plain.join(by_name, "suffix").select("source", "raw", "target")
    package = plain.select("source", "raw", F.concat(F.regexp_replace("suffix", "/[^/]*$", ""), F.lit("/package")).alias("suffix")).join(met.select("source", "raw").distinct(), ["source", "raw"], "left_anti")
    return met.unionByName(wild.join(by_folder, "suffix").select("source", "raw", "target")).unionByName(package.join(by_name, "suffix").select("source", "raw", "target")).where("target != source").distinct()


def swift_modules(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """``module, path``: targets of package manifests (``path, content``), with their own path or ``Sources/name`` and ``Tests/name``, beside the manifest."""
    block = F.explode(F.regexp_extract_all("content", F.lit(r"(?s)(\.(?:target|executableTarget|testTarget)\s*\((?:[^()]|\([^()]*\))*\))"), 1)).alias("t")
    found = manifests.select(directory(F.col("path")).alias("root"), block).select("root", F.regexp_extract("t", r'name:\s*"([^"]+)"', 1).alias("module"), F.regexp_extract("t", r'path:\s*"([^"]+)"', 1).alias("own"), F.col("t").startswith(".testTarget").alias("test"))
    place = F.when(F.col("own") != "", F.col("own")).otherwise(F.concat(F.when(F.col("test"), "Tests/").otherwise("Sources/"), "module"))
    at = found.select("module", F.concat_ws("/", F.when(F.col("root") != "", F.col("root")), place).alias("dir"))
    own = files.where("path like '%.swift'").select("path", F.explode(ancestors(directory(F.col("path")))).alias("dir"))
    return own.join(at, "dir").select("module", "path").distinct()
