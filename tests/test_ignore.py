"""Tables of ignore rules against a plain matcher."""

import random

from loomgraph.sources import ignore


def parts_match(pattern, parts):
    """Whether a list of pattern parts matches a list of path parts."""
    if not pattern:
        return not parts
    if pattern[0] == "**":
        if len(pattern) == 1:
            return bool(parts)
        return any(parts_match(pattern[1:], parts[k:]) for k in range(len(parts) + 1))
    return bool(parts) and name_match(pattern[0], parts[0]) and parts_match(pattern[1:], parts[1:])


def name_match(p, name):
    if not p:
        return not name
    if p[0] == "*":
        return any(name_match(p.lstrip("*"), name[k:]) for k in range(len(name) + 1))
    if p[0] == "[" and "]" in p[1:]:
        end = p.index("]", 1)
        inside, out = p[1:end], p[1] == "!"
        return bool(name) and (name[0] in inside.lstrip("!")) != out and name_match(p[end + 1 :], name[1:])
    return bool(name) and (p[0] in ("?", name[0])) and name_match(p[1:], name[1:])


def plain(path, rules, fold):
    """Rules (dir, layer, line, pattern) on a path and the folders around it."""
    parts = path.split("/")
    for k in range(1, len(parts) + 1):
        best, state = None, False
        for where, layer, line, pattern in rules:
            p = pattern.rstrip(" \t")
            if not p or p.startswith("#"):
                continue
            negated, p = p.startswith("!"), p.removeprefix("!")
            p = p[1:] if p[:2] in ("\\#", "\\!") else p
            folder, p = p.endswith("/"), p.rstrip("/")
            dirs = where.split("/") if where else []
            if parts[: len(dirs)] != dirs or len(dirs) >= k or (folder and k == len(parts)):
                continue
            low = str.lower if fold else str
            want = [low(x) for x in (p.removeprefix("/").split("/") if "/" in p else ["**", p])]
            own = [low(x) for x in parts[len(dirs) : k]]
            if (parts_match(want, own) or (want[0] == "**" and parts_match(want[1:], own))) and (best is None or (layer, len(dirs), line) > best):
                best, state = (layer, len(dirs), line), not negated
        if state:
            return True
    return False


def test_rules_of_layers(spark):
    rng = random.Random(6)
    names = ["src", "lib", "a.js", "b.min.js", "c.ts", "doc", "x y.md", "#n", "!k", "gen[1].go", "a+b.c", "x", "Lib", "B.MIN.JS"]
    paths = sorted({"/".join(rng.choice(names) for _ in range(rng.randrange(1, 6))) for _ in range(400)})
    files = [p for p in paths if not any(q.startswith(p + "/") for q in paths)]
    patterns = ["*.js", "!a.js", "src/", "/lib", "lib/doc", "**/doc/", "doc/**", "a/**/x", "src/**/*.ts", "?.ts", "[ab].js", "[!a]*.js", "!src/", "*.min.js", "\\#n", "\\!k", "#n", "", "x", "!x", "gen[1].go", "a+b.c", "x y.md", "*y.md  ", "/", "src/*/lib", "!lib/doc/x", "[", "src/x/", "Lib/doc", "X", "*.JS", "SRC/*.ts", "**", "!**/x"]
    for fold in (True, True, False):
        rules = [(rng.choice(["", "", "src", "lib/doc"]), rng.randrange(4), k, rng.choice(patterns[:-2])) for k in range(12)]
        df = ignore.ignored_paths(spark.createDataFrame([(p,) for p in files], "path string"), spark.createDataFrame(rules, "dir string, layer int, line int, pattern string"), fold)
        assert {r.path: r.ignored for r in df.collect()} == {p: plain(p, rules, fold) for p in files}, rules


def test_ignore_files_of_trees(spark):
    files = [("t", ".graphignore", "gen/\n*.log\r\n!keep.log\n"), ("t", ".graph/.graphignore", "keep.log\nonly\n"), ("t", "sub/.graphignore", "/top\n!a.log"), ("u", "gen/a", "")]
    files += [("t", p, "") for p in ("gen/a", "a.log", "keep.log", "sub/a.log", "sub/top/x", "sub/in/top", "only", "ok", "gen/keep.log")]
    df = spark.createDataFrame(files, "root string, path string, content string")
    got = ignore.ignored_paths(df.select("root", "path"), ignore.tree_rules(df))
    assert {(r.root, r.path) for r in got.where("ignored").collect()} == {("t", "gen/a"), ("t", "a.log"), ("t", "sub/top/x"), ("t", "only"), ("t", "gen/keep.log")}


def test_a_thousand_rules(spark):
    rules = [("", 2, k, f"d{k}/" if k % 3 == 0 else f"*.e{k}" if k % 3 == 1 else f"/p{k}/*/x?") for k in range(1000)]
    paths = [(f"d{k}/f",) for k in range(0, 1500, 3)] + [(f"q/a.e{k}",) for k in range(1, 1500, 3)] + [(f"p{k}/m/x1",) for k in range(2, 1500, 3)]
    got = ignore.ignored_paths(spark.createDataFrame(paths, "path string"), spark.createDataFrame(rules, "dir string, layer int, line int, pattern string"))
    assert got.where("ignored").count() == 1000 and got.count() == 1500
    assert not ignore.ignored_paths(spark.createDataFrame([("a",)], "path string"), ignore.default_rules(spark).unionByName(ignore.caller_rules(spark, ["b"]))).first().ignored
