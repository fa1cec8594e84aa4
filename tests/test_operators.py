"""Operators against plain Python on small inputs."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.operators import analytics, change, community, graph, imports, parse, repair, search, traverse, wiki

EDGE = "source string, target string, type string, direction string, weight double, ord long"


def edge_rows(pairs, kind="contains"):
    return [(a, b, kind, "forward", 1.0, i) for i, (a, b) in enumerate(pairs)]


def test_growth_is_one_pass_in_order(spark):
    rng = random.Random(5)
    for _ in range(3):
        pairs = [(f"n{rng.randrange(7)}", f"n{rng.randrange(7)}") for _ in range(12)]
        seen = {"n0"}
        for a, b in pairs:
            if a in seen:
                seen.add(b)
        got = change.contains_growth(spark.createDataFrame(edge_rows(pairs), EDGE), spark.createDataFrame([("n0",)], "id string"))
        assert {r.id for r in got.collect()} == seen


def first_in_first_out(pairs, a, b):
    near = {}
    for x, y in pairs:
        near.setdefault(x, []).append(y)
        near.setdefault(y, []).append(x)
    queue, up = [a], {a: None}
    for x in queue:
        for y in near.get(x, []):
            if y not in up:
                up[y] = x
                queue.append(y)
    if a == b or b not in up:
        return []
    path = [b]
    while path[-1] != a:
        path.append(up[path[-1]])
    return path[::-1]


def test_shortest_path_takes_the_first_found(spark):
    rng = random.Random(2)
    for _ in range(3):
        pairs = [(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(14)]
        got = traverse.shortest_path(spark.createDataFrame(edge_rows(pairs), EDGE), "n0", "n8")
        assert [r.id for r in got.orderBy("pos").collect()] == first_in_first_out(pairs, "n0", "n8")


def kahn(ids, pairs):
    n = {i: 0 for i in ids}
    for _, b in pairs:
        n[b] += 1
    queue = [i for i in ids if not n[i]]
    for x in queue:
        for a, b in pairs:
            if a == x:
                n[b] -= 1
                if not n[b]:
                    queue.append(b)
    return queue + [i for i in ids if i not in queue]


def test_topological_order(spark):
    rng = random.Random(4)
    for _ in range(2):
        ids = [f"n{i}" for i in range(7)]
        pairs = [(f"n{rng.randrange(7)}", f"n{rng.randrange(7)}") for _ in range(7)]
        nodes = spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "id string, ord long")
        got = traverse.topological_levels(nodes, spark.createDataFrame(edge_rows(pairs), EDGE))
        assert [r.id for r in got.orderBy("pos").collect()] == kahn(ids, pairs)


def test_communities_of_three_cliques(spark):
    pairs = [(f"{g}{i}", f"{g}{j}") for g in "abc" for i in range(4) for j in range(i)] + [("a0", "b0")]
    ids = [f"{g}{i}" for g in "abc" for i in range(4)] + ["alone"]
    got = community.communities(spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(edge_rows(pairs), EDGE)).collect()
    assert len(got) == 13 and len({r.container for r in got}) == 4
    assert len({r.container for r in got if r.id[0] == "a" and r.id != "alone"}) == 1


def test_relative_imports(spark):
    files = spark.createDataFrame([(p,) for p in ("src/a.ts", "src/util/index.ts", "src/b.js", "lib/c.tsx")], "path string")
    raw = spark.createDataFrame([("src/a.ts", r) for r in ("./util", "./b", "../lib/c", "./missing", "../../out", "react", "../lib/c.js")], "source string, raw string")
    got = {r.raw: r.target for r in imports.relative_imports(raw, files).collect()}
    assert got == {"./util": "src/util/index.ts", "./b": "src/b.js", "../lib/c": "lib/c.tsx", "../lib/c.js": "lib/c.tsx"}


def test_python_imports_prefer_deep_roots(spark):
    files = spark.createDataFrame([(p,) for p in ("pkg/a.py", "pkg/sub/a.py", "pkg/sub/m.py", "b/__init__.py")], "path string")
    raw = spark.createDataFrame([("pkg/sub/m.py", r) for r in ("a", ".a", "..a", "b", "none")], "source string, raw string")
    got = {r.raw: r.target for r in imports.python_imports(raw, files).collect()}
    assert got == {"a": "pkg/sub/a.py", ".a": "pkg/sub/a.py", "..a": "pkg/a.py", "b": "b/__init__.py"}


def test_suffix_and_go_imports(spark):
    files = spark.createDataFrame([(p,) for p in ("m/java/com/x/A.java", "n/com/x/A.java", "app/util/u.go", "app/util/v.go", "app/go.mod")], "path string")
    raw = spark.createDataFrame([("m/B.java", "com.x.A")], "source string, raw string")
    assert {r.target for r in imports.suffix_imports(raw, files, ".java").collect()} == {"m/java/com/x/A.java", "n/com/x/A.java"}
    modules = spark.createDataFrame([("app/go.mod", "ex.org/app")], "config string, module string")
    go = spark.createDataFrame([("app/main.go", "ex.org/app/util"), ("app/main.go", "fmt")], "source string, raw string")
    assert {r.target for r in imports.go_imports(go, files, modules).collect()} == {"app/util/u.go", "app/util/v.go"}


def test_canonical_tests(spark):
    rows = [("file:a_test.go", "file:a.go", 0.5, 1), ("file:a.go", "file:a_test.go", 0.9, 2), ("file:b.py", "file:c.py", 0.5, 3), ("file:x.spec.ts", "file:x.ts", 0.4, 4)]
    df = spark.createDataFrame([(s, t, "tested_by", "forward", w, o) for s, t, w, o in rows], EDGE)
    got = sorted((r.source, r.target, r.weight, r.ord) for r in imports.canonical_tests(df).collect())
    assert got == [("file:a.go", "file:a_test.go", 0.9, 1), ("file:x.ts", "file:x.spec.ts", 0.4, 4)]


def test_parsers(spark):
    one = lambda text: spark.createDataFrame([("f", text)], "path string, content string")
    md = one("# A\ntext\n```\n# no\n```\n## B ##\n[x](y.md) ![i](z.png) [w](http://q)\n")
    assert [(r.name, r.level, r.start, r.end) for r in parse.markdown_sections(md).orderBy("start").collect()] == [("A", 1, 1, 5), ("B", 2, 6, 8)]
    assert {(r.target, r.kind) for r in parse.markdown_references(md).collect()} == {("y.md", "link"), ("z.png", "image")}
    assert [(r.name, r.level) for r in parse.toml_sections(one("[a]\nx=1\n[[a.b]]\n")).orderBy("start").collect()] == [("a", 1), ("a.b", 2)]
    assert {r.name for r in parse.env_variables(one("A=1\n# B=2\nexport C=3\n")).collect()} == {"A", "C"}
    docker = parse.dockerfile_stages(one("FROM node:18 AS build\nEXPOSE 80 443\nFROM x/nginx:1\n")).orderBy("stage").collect()
    assert [(r.name, r.ports) for r in docker] == [("build", [80, 443]), ("nginx", [])]
    assert {r.name for r in parse.make_targets(one("all: x\n\tgo\n.PHONY: all\nV := 1\nW ?= 2\n")).collect()} == {"all"}
    assert {(r.name, r.kind) for r in parse.sql_tables(one("CREATE TABLE IF NOT EXISTS t (a int);\ncreate view v as select 1; CREATE UNIQUE INDEX i ON t(a)")).collect()} == {("t", "table"), ("v", "view"), ("i", "index")}
    assert [(r.day, r.operation, r.title) for r in parse.log_entries(one("## [2024-01-02] ADD | A page\n")).collect()] == [("2024-01-02", "ADD", "A page")]
    assert one("---\na: 1\nb: x: y\n---\nz").select(parse.frontmatter(F.col("content")).alias("m")).first().m == {"a": "1", "b": "x: y"}
    assert str(one('so:\n```json\n{"a": [1]}\n```').select(parse.json_block(F.col("content")).cast("string").alias("j")).first().j) == '{"a":[1]}'
    go = parse.declarations(one("package p\nfunc Run() {}\nfunc (s *S) hide() {}\ntype S struct {\n"), "go").collect()
    assert {(r.kind, r.name, r.exported) for r in go} == {("function", "Run", True), ("function", "hide", False), ("class", "S", True)}


def test_wiki(spark):
    pages = spark.createDataFrame([("w/A.md", "# Ay\n[[b]] [[c|see]]"), ("w/b.md", "[[A]]"), ("x/c.md", ""), ("y/c.md", "")], "path string, content string")
    index = spark.createDataFrame([("index.md", "## First Topic\n- [[w/A]]\n- [[b]]\n")], "path string, content string")
    nodes, edges = wiki.wiki_graph(pages, index)
    assert {(r.source, r.target) for r in edges.where("type = 'related'").collect()} == {("article:w/A", "article:w/b"), ("article:w/b", "article:w/A")}
    assert {r.source for r in edges.where("target = 'topic:first-topic'").collect()} == {"article:w/A", "article:w/b"}
    assert nodes.count() == 5


def test_fuzzy_search(spark):
    rows = [("1", "class", "AuthController", "handles login", 0), ("2", "function", "dbPool", "database pool", 1), ("3", "file", "auth", "auth helpers", 2)]
    nodes = spark.createDataFrame(rows, "id string, type string, name string, summary string, ord int")
    assert [r.id for r in search.fuzzy(nodes, "auth").collect()][0] == "3"
    assert "1" in [r.id for r in search.fuzzy(nodes, "auth contrl").collect()]
    assert search.fuzzy(nodes, "  ").count() == 0
    assert [r.id for r in search.fuzzy(nodes, "auth", ["class"]).collect()] == ["1"]
    assert all(0 <= r.score <= 1 for r in search.fuzzy(nodes, "auth").collect())


def test_update_classes(spark):
    def kind(rows):
        return change.update_class(spark.createDataFrame(rows, "path string, change string")).first()["update"]

    still = [(f"a/{i}", "unchanged") for i in range(40)]
    assert kind(still) == "SKIP"
    assert kind(still + [("a/x", "structural")]) == "PARTIAL"
    assert kind(still + [("b/x", "new")]) == "ARCHITECTURE"
    assert kind(still[:1] + [("a/x", "structural"), ("a/y", "structural")]) == "FULL"


def test_directory_groups_and_batches(spark):
    nodes = spark.createDataFrame([("1", "p/q/a/x"), ("2", "p/q/b/y"), ("3", "p/q/z"), ("4", None)], "id string, file_path string")
    assert {r.id: r.container for r in graph.directory_groups(nodes).collect()} == {"1": "a", "2": "b", "3": "~"}
    paths = spark.createDataFrame([(f"d{i:03}",) for i in range(30)], "path string")
    assert sorted(r.batch for r in analytics.count_batches(paths).collect()) == [0] * 12 + [1] * 12 + [2] * 6


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from("ab"), st.one_of(st.none(), st.sampled_from([0.1, 0.5, 0.9]))), min_size=1, max_size=8))
def test_heaviest_edge_wins(spark, rows):
    df = spark.createDataFrame([(s, t, "calls", "forward", w, i) for i, (s, t, w) in enumerate(rows)], EDGE)
    want = {}
    for i, (s, t, w) in enumerate(rows):
        if (s, t) not in want or (w or 0) > want[s, t][0]:
            want[s, t] = (w or 0, i)
    assert {(r.source, r.target): r.ord for r in repair.dedup_edges(df).collect()} == {k: i for k, (_, i) in want.items()}


def test_long_chains_are_walked_whole(spark):
    from loomgraph.operators import change, traverse

    n = 200
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "contains", i) for i in range(n)], "source string, target string, type string, ord long")
    start = spark.createDataFrame([("n0",)], "id string")
    assert traverse.bfs_depth(e, start).count() == n + 1
    assert traverse.shortest_path(e, "n0", f"n{n}").count() == n + 1
    few = e.where("ord < 40")
    assert change.contains_growth(few.withColumn("ord", n - few.ord), start).count() == 2
    assert change.contains_growth(few, start).count() == 41


def test_chains_of_ten_thousand(spark):
    from loomgraph.operators import traverse

    n = 10_000
    e = spark.range(n).selectExpr("concat('n', id) as source", "concat('n', id + 1) as target", "id as ord")
    e = e.unionByName(spark.createDataFrame([(f"n{n}", "r0", n), ("r0", "r1", n + 1), ("r1", "r2", n + 2), ("r2", "r0", n + 3), ("x0", "x1", n + 4), ("x1", "x0", n + 5)], e.schema))
    got = {r.id: r.depth for r in traverse.bfs_depth(e, spark.createDataFrame([("n0",), ("n9000",)], "id string")).collect()}
    assert got == {**{f"n{i}": i if i < 9000 else i - 9000 for i in range(n + 1)}, "r0": 1001, "r1": 1002, "r2": 1003}


def test_depths_are_those_of_a_queue(spark):
    from loomgraph.operators import traverse

    rng = random.Random(9)
    for density in (1.1, 1.6):
        n = 40
        pairs = {(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(int(density * n))} | {(f"c{i}", f"c{i + 1}") for i in range(20)} | {("c20", "n1"), ("n0", "c0")}
        depth, queue = {"n0": 0, "n5": 0}, ["n0", "n5"]
        for x in queue:
            for a, b in pairs:
                if a == x and b not in depth:
                    depth[b] = depth[x] + 1
                    queue.append(b)
        e = spark.createDataFrame(list(pairs), "source string, target string")
        assert {r.id: r.depth for r in traverse.bfs_depth(e, spark.createDataFrame([("n0",), ("n5",)], "id string")).collect()} == depth


def test_longest_depths_are_levels(spark):
    rng = random.Random(3)
    for _ in range(2):
        ids = [f"n{i}" for i in range(24)] + [f"c{i}" for i in range(12)] + ["r0", "r1", "r2", "s"]
        pairs = [(f"n{a}", f"n{b}") for a, b in ((rng.randrange(24), rng.randrange(24)) for _ in range(20)) if a < b or rng.random() < 0.1]
        pairs += [(f"c{i}", f"c{i + 1}") for i in range(11)] + [("n0", "c0"), ("c11", "n23"), ("r0", "r1"), ("r1", "r2"), ("r2", "r0"), ("s", "s"), ("n0", "n23"), ("n0", "gone")]
        left, level, want = {i: sum(b == i for _, b in set(pairs)) for i in ids}, dict.fromkeys(ids, 0), {}
        queue = [i for i in ids if not left[i]]
        for x in queue:
            want[x] = level[x]
            for a, b in set(pairs):
                if a == x and b in left:
                    left[b] -= 1
                    level[b] = max(level[b], level[x] + 1)
                    if not left[b]:
                        queue.append(b)
        got = traverse.longest_depths(spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(edge_rows(pairs), EDGE))
        assert {r.id: r.level for r in got.collect()} == {i: want.get(i, -1) for i in ids}


def plain_louvain(ids, pairs):
    """One node after the other, as the method was first told; the modularity that it reaches."""
    weight = {}
    for a, b in {tuple(sorted(p)) for p in pairs if p[0] != p[1]}:
        weight.setdefault(a, {})[b] = weight.setdefault(b, {})[a] = 1.0
    total, where = sum(sum(x.values()) for x in weight.values()) / 2, {i: i for i in ids}
    first = {a: dict(x) for a, x in weight.items()}
    while True:
        k = {a: sum(x.values()) for a, x in weight.items()}
        label, sums, moved, again = {a: a for a in weight}, dict(k), False, True
        while again:
            again = False
            for a in weight:
                near = {}
                for b, w in weight[a].items():
                    if b != a:
                        near[label[b]] = near.get(label[b], 0) + w
                sums[label[a]] -= k[a]
                value = lambda c: near.get(c, 0) - k[a] * sums.get(c, 0) / (2 * total)  # noqa: B023, E731
                best = max(near, key=value, default=label[a])
                if value(best) > value(label[a]) + 1e-12:
                    label[a], again, moved = best, True, True
                sums[label[a]] += k[a]
        if not moved:
            break
        where = {i: label.get(c, c) for i, c in where.items()}
        packed = {}
        for a, x in weight.items():
            for b, w in x.items():
                row = packed.setdefault(label[a], {})
                row[label[b]] = row.get(label[b], 0) + w
        weight = packed
    inside = sum(w for a, x in first.items() for b, w in x.items() if where[a] == where[b])
    sums = {}
    for a, x in first.items():
        sums[where[a]] = sums.get(where[a], 0) + sum(x.values())
    return inside / (2 * total) - sum(s * s for s in sums.values()) / (2 * total) ** 2


def graph_of(kind):
    rng = random.Random(kind)
    if kind == "blocks":
        ids = [f"b{i}" for i in range(120)]
        pairs = [(f"b{i}", f"b{j}") for i in range(120) for j in range(i) if rng.random() < (0.4 if i % 6 == j % 6 else 0.02)]
    elif kind == "ring":
        ids = [f"k{g}.{i}" for g in range(12) for i in range(5)]
        pairs = [(f"k{g}.{i}", f"k{g}.{j}") for g in range(12) for i in range(5) for j in range(i)] + [(f"k{g}.0", f"k{(g + 1) % 12}.1") for g in range(12)]
    else:  # sizes and degrees far apart, with hubs
        ids = [f"s{i}" for i in range(150)]
        block = [min(rng.randrange(8), rng.randrange(8)) for _ in ids]
        pairs = [(f"s{i}", f"s{j}") for i in range(150) for j in range(i) if rng.random() < (0.3 if block[i] == block[j] else 0.03) * (3 if j < 5 else 1)]
    return ids, pairs


@pytest.mark.parametrize("kind", ["blocks", "ring", "sizes"])
def test_communities_are_as_good_as_one_node_at_a_time(spark, kind):
    ids, pairs = graph_of(kind)
    e = spark.createDataFrame(edge_rows(pairs), EDGE)
    got = community.communities(spark.createDataFrame([(i,) for i in [*ids, "alone"]], "id string"), e)
    assert sorted(r.id for r in got.collect()) == sorted([*ids, "alone"])
    reached = community.modularity(e, got).first()[0]
    assert reached >= 0.99 * plain_louvain(ids, pairs)


def test_a_wrongly_grouped_node_moves_alone(spark):
    """What a lower level put together wrongly is parted again, from the communities found so far."""
    pairs = [(f"{g}{i}", f"{g}{j}") for g in "ab" for i in range(4) for j in range(i)] + [("a0", "b0")]
    both = spark.createDataFrame([(*x, 1.0) for a, b in pairs for x in ((a, b), (b, a))], "s string, t string, w double")
    labels = both.groupBy(F.col("s").alias("id")).agg(F.sum("w").alias("k")).withColumn("container", F.when(F.col("id") == "b0", "a").otherwise(F.substring("id", 1, 1)))
    assert {(r.id, r.container) for r in community._moved(both, labels, float(len(pairs))).collect()} == {(f"{g}{i}", g) for g in "ab" for i in range(4)}


def test_a_round_deals_ties_once(spark, monkeypatch):
    """Ties meet the labels by one join, and a heavy node's ties by parts; both ways a node wants the same."""
    pairs = [("hub", f"x{i}") for i in range(9)] + [("x0", "x1"), ("x1", "x2")]
    k = {n: float(sum(n in x for x in pairs)) for x in pairs for n in x}
    ties = spark.createDataFrame([(a, b, 1.0, k[a]) for x in pairs for a, b in (x, x[::-1])], "s string, t string, w double, k double")
    labels = spark.createDataFrame([(n, x, n) for n, x in k.items()], "id string, k double, container string")
    plan = community._wanted(ties, None, labels, float(len(pairs)), 0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 3  # the labels with their communities' weights, once for either side of ties
    got = []
    for hub in (1 << 16, 1):
        monkeypatch.setattr(community, "HUB", hub)
        got.append(sorted((r.id, r.own, r.goal, round(r.gain, 6)) for r in community._wanted(ties, None, labels, float(len(pairs)), 0).collect()))
    assert got[0] == got[1] and ("x1", "x1", "x0", round(1 - 3 * 2 / 22, 6)) in got[0]


def test_growing_sides_of_chains_are_not_broadcast(spark, monkeypatch):
    from loomgraph.plans import loops

    plans, write = [], loops.write
    monkeypatch.setattr(traverse, "SENT", 0)
    monkeypatch.setattr(loops, "write", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    got = traverse.longest_depths(spark.createDataFrame([(f"n{i}",) for i in range(6)], "id string"), spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(5)], "source string, target string"))
    assert sorted((r.id, r.level) for r in got.collect()) == [(f"n{i}", i) for i in range(6)]
    assert any("SortMergeJoin" in x for x in plans) and not any("BroadcastHashJoin" in x for x in plans)


def test_numbers_by_ranges(spark):
    from pyspark.sql import functions as F

    from loomgraph.plans.loops import numbered

    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "x int").repartition(5)
    for few in (1 << 16, 10):
        got = numbered(df, [F.col("x")], "at", 3, few).collect()
        assert all(r.at == r.x + 3 for r in got) and len(got) == 101


def test_compiled_names_do_not_fall_through(spark):
    from loomgraph.operators import imports

    files = spark.createDataFrame([("src/a.js/index.ts",), ("src/b.mts",)], "path string")
    want = spark.createDataFrame([("src/x.ts", "./a.js"), ("src/x.ts", "./b.mjs")], "source string, raw string")
    assert [(r.raw, r.target) for r in imports.relative_imports(want, files).collect()] == [("./b.mjs", "src/b.mts")]


def test_index_finds_what_the_scan_finds(spark, tmp_path):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcé#_") for _ in range(rng.randrange(1, 8)))
    text = lambda: rng.choice([" ", "-", "  ", "."]).join(word() for _ in range(rng.randrange(4)))
    rows = [(f"n{i}", rng.choice(["file", "class"]), None if i % 17 == 0 else text(), [text() for _ in range(i % 3)] if i % 5 else None, text().upper(), i) for i in range(150)]
    nodes = spark.createDataFrame(rows, "id string, type string, name string, tags array<string>, summary string, ord long").cache()
    built = search.index(nodes).write(str(tmp_path / "index"))
    for query, types in (("a", []), ("abca cabé", ["file"]), ("bb_#a", []), ("cc.b aa", []), ("  ", []), ("abcabca", ["class"])):
        want = [tuple(r) for r in search.fuzzy(nodes, query, types, 40).collect()]
        assert [tuple(r) for r in search.indexed(built, query, types, 40).collect()] == want, query
    plan = search.near_words(built.words, "abcab")._jdf.queryExecution().optimizedPlan().toString()
    assert "pair#" in plan and " IN (" in plan and "chunk" not in plan
