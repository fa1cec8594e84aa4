"""Ignore patterns in the manner of gitignore: a few as column expressions, any number of them as a table.

A table of rules is keyed by the folder that a rule holds in.  Paths fall into entries (each folder once, and the files), entries meet
rules of the folders around them: rules that are a name by equality of the entry's last part, rules like ``*.ext`` by
equality of its endings, and only the others by their pattern.  Of all rules that match an entry the last one counts, by layer,
depth of its folder and line; a path is ignored if this holds for itself or any folder around it, as nothing inside
an ignored folder can be taken back.  Rules take no notice of case unless they are told to.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocabulary import IGNORED


def pattern_regex(pattern: str) -> tuple[str, bool] | None:
    """A pattern as a regular expression over whole relative paths, and whether it negates; None for blanks and comments."""
    line = pattern.rstrip()
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line
    folder = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    line = line.removeprefix("/")
    out, i = "", 0
    while i < len(line):
        if line.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("**", i):
            out, i = out + ".*", i + 2
        elif line[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        elif line[i] == "[" and (end := line.find("]", i + 1)) > 0:
            out, i = out + "[" + line[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, i = out + re.escape(line[i]), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if folder else "(?:/.*)?$"), negated


def ignored(path: Column, *layers: list[str]) -> Column:
    """Whether the last matching pattern of all layers (the defaults first) ignores a path."""
    out = F.lit(False)
    for pattern in [*IGNORED, *(x for layer in layers for x in layer)]:
        if (found := pattern_regex(pattern)) is not None:
            out = F.when(path.rlike(found[0]), F.lit(not found[1])).otherwise(out)
    return out


#: Layers of rules, the later ones over the earlier: defaults, the data folder's file, ignore files of the tree, the caller's.
DEFAULTS, DATA, TREE, CALLER = range(4)


def default_rules(spark: SparkSession) -> DataFrame:
    """``dir, layer, line, pattern`` of the defaults."""
    return spark.createDataFrame([("", DEFAULTS, k, p) for k, p in enumerate(IGNORED)], "dir string, layer int, line int, pattern string")


def caller_rules(spark: SparkSession, patterns: list[str]) -> DataFrame:
    return spark.createDataFrame([("", CALLER, k, p) for k, p in enumerate(patterns)], "dir string, layer int, line int, pattern string")


def tree_rules(files: DataFrame, name: str = ".graphignore", data_dir: str = ".graph") -> DataFrame:
    """``dir, layer, line, pattern`` of a tree's ignore files (``path, content``): at the root, in the data folder (about the root) and in any folder (about that folder); other columns stay."""
    others = [c for c in files.columns if c not in ("path", "content")]
    here = files.where((F.col("path") == name) | F.col("path").endswith("/" + name))
    folder = F.regexp_replace("path", "(?:^|/)[^/]+$", "")
    lines = here.select(*others, F.when(folder == data_dir, F.lit("")).otherwise(folder).alias("dir"), F.when(folder == data_dir, DATA).otherwise(TREE).alias("layer"), F.posexplode(F.split("content", "\r?\n")).alias("line", "pattern"))
    return lines.select(*others, "dir", F.col("layer").cast("int").alias("layer"), "line", "pattern")


def compiled(rules: DataFrame, fold: bool = True) -> DataFrame:
    """Adds ``negated, folder, how, key`` to rules: ``how`` is name, ending or pattern, ``key`` what an entry (without case, if fold) must have; blanks and comments go."""
    p = F.regexp_replace("pattern", r"(?<!\\)[ \t]+$", "")
    some = rules.withColumn("p", p).where("p != '' and p not like '#%'")
    some = some.withColumn("negated", F.col("p").startswith("!")).withColumn("p", F.regexp_replace("p", "^!", ""))
    some = some.withColumn("p", F.regexp_replace("p", r"^\\(?=[#!])", ""))
    some = some.withColumn("folder", F.col("p").endswith("/")).withColumn("p", F.regexp_replace("p", "/+$", "")).where("p != ''")
    anchored = F.col("p").contains("/")
    bare = F.regexp_replace("p", "^/", "")
    # what is not a sign of the pattern stands for itself; two stars are kept apart from one
    body = F.regexp_replace(bare, r"([.+^$(){}|])", r"\\$1")
    body = F.regexp_replace(body, r"\[(?![^\]/]+\])", r"\\[")
    for sign, by in ((r"(?:^|(?<=/))\*\*/", "\u0001"), (r"/\*\*$", "/\u0002"), (r"\*\*+", "\u0003"), (r"\*", "[^/]*"), (r"\?", "[^/]"), (r"\[!", "[^"), ("\u0001", "(?:.*/)?"), ("\u0002", ".+"), ("\u0003", "[^/]*")):
        body = F.regexp_replace(body, sign, by)
    how = F.when(~anchored & F.col("p").rlike(r"^[\w.@+ -]+$"), "name").when(~anchored & F.col("p").rlike(r"^\*\.[\w.@+-]+$"), "ending").otherwise("pattern")
    key = F.when(how == "name", F.col("p")).when(how == "ending", F.substring("p", 2, 1 << 20)).otherwise(F.concat(F.when(anchored, "^").otherwise("^(?:.*/)?"), body, F.lit("$")))
    key = F.when(how == "pattern", F.concat(F.lit("(?iu)" if fold else ""), key)).otherwise(F.lower(key) if fold else key)
    return some.withColumn("how", how).withColumn("key", key).drop("p", "pattern")


def entries(paths: DataFrame) -> DataFrame:
    """``entry, is_dir`` (with the columns of paths besides ``path``): the files and every folder around them, once each."""
    others = [c for c in paths.columns if c != "path"]
    parts = F.split("path", "/")
    level = F.explode(F.sequence(F.lit(1), F.size(parts)))
    spread = paths.select(*others, "path", parts.alias("parts"), level.alias("k"))
    return spread.select(*others, F.array_join(F.slice("parts", 1, F.col("k")), "/").alias("entry"), (F.col("k") < F.size("parts")).alias("is_dir")).distinct()


def ignored_paths(paths: DataFrame, rules: DataFrame, fold: bool = True) -> DataFrame:
    """Adds ``ignored`` to paths (``path``, and any columns that rules share, such as a tree's name)."""
    tree = [c for c in paths.columns if c != "path" and c in rules.columns]
    ready = compiled(rules, fold)
    found = entries(paths.select(*tree, "path"))
    parts = F.split("entry", "/")
    around = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    base = F.lower(F.element_at(parts, -1)) if fold else F.element_at(parts, -1)
    dots = F.filter(F.sequence(F.lit(1), F.greatest(F.length(base), F.lit(1))), lambda k: F.substr(base, k, F.lit(1)) == ".")
    key = [*tree, "dir"]
    spread = found.select(*tree, "entry", "is_dir", base.alias("base"), dots.alias("dots"), F.explode(around).alias("dir"))
    of = lambda how: ready.where(F.col("how") == how).drop("how")
    by_name = spread.withColumn("key", F.col("base")).join(of("name"), [*key, "key"])
    by_ending = spread.withColumn("key", F.explode(F.transform("dots", lambda k: F.substr(F.col("base"), k)))).join(of("ending"), [*key, "key"])
    by_pattern = spread.join(of("pattern"), key).where(F.expr("rlike(if(dir = '', entry, substr(entry, length(dir) + 2)), key)"))
    columns = [*tree, "entry", "is_dir", "folder", "negated", "layer", "dir", "line"]
    met = reduce(DataFrame.unionByName, (df.select(*columns) for df in (by_name, by_ending, by_pattern))).where("is_dir or not folder")
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    last = met.groupBy(*tree, "entry", "is_dir").agg(F.max_by("negated", F.struct("layer", depth.alias("depth"), "line")).alias("negated"))
    out = last.where("not negated").select(*tree, F.col("entry").alias("hit"), "is_dir")
    mine = F.split("path", "/")
    spread = paths.select(*tree, "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(mine)), lambda k: F.struct(F.array_join(F.slice(mine, 1, k), "/").alias("hit"), (k < F.size(mine)).alias("is_dir")))).alias("x")).select(*tree, "path", "x.*")
    gone = spread.join(out, [*tree, "hit", "is_dir"], "left_semi").select(*tree, "path").distinct().withColumn("ignored", F.lit(True))
    return paths.join(gone, [*tree, "path"], "left").fillna(False, ["ignored"])
