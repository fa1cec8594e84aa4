"""Builders, block parsers, views and design trees on small inputs."""

import json

from loomgraph.operators import blocks, build, design, views
from loomgraph.plans import render

EDGE = "source string, target string, type string, direction string, weight double, ord long"


def graph(spark):
    nodes = spark.createDataFrame(
        [("file:a.py", "file", "a.py", "a.py", 0), ("class:a.py:K", "class", "K", "a.py", 1), ("function:a.py:f", "function", "f", "a.py", 2), ("file:b.py", "file", "b.py", "src/b.py", 3), ("concept:c", "concept", "c", None, 4)],
        "id string, type string, name string, file_path string, ord long",
    )
    rows = [("file:a.py", "class:a.py:K", "contains", 1.0), ("file:a.py", "function:a.py:f", "contains", 1.0), ("file:b.py", "file:a.py", "imports", 0.7), ("file:b.py", "file:ghost", "calls", 1.5)]
    edges = spark.createDataFrame([(s, t, k, "forward", w, i) for i, (s, t, k, w) in enumerate(rows)], EDGE)
    members = spark.createDataFrame([("layer:x", 0, "file:a.py"), ("layer:y", 1, "file:a.py"), ("layer:x", 0, "file:none")], "layer_id string, layer_ord int, node_id string")
    return nodes, edges, members


def test_explain(spark):
    got = {(r.id, r.role) for r in views.explain(*graph(spark), "a.py").collect()}
    assert got == {("file:a.py", "element"), ("class:a.py:K", "child"), ("function:a.py:f", "child"), ("file:b.py", "connected"), ("layer:x", "layer")}
    assert views.find_element(graph(spark)[0], "a.py:f").first().id == "function:a.py:f"


def test_review(spark):
    nodes, edges, members = graph(spark)
    got = {r.check: r.n for r in views.review(nodes, edges, members, spark.createDataFrame([(1, "file:zz")], "step int, id string")).collect()}
    assert got == {"dangling target": 1, "node in several layers": 1, "file in no layer": 1, "unknown layer member": 1, "unknown tour member": 1, "orphan": 1, "weight out of range": 1}


def test_layers_tree_tour(spark):
    nodes, edges, members = graph(spark)
    inner, between = views.layer_detail(nodes, edges, members, "layer:x")
    assert inner.count() == 3 and between.count() == 2
    kept = {r.layer_id: r.nodes for r in views.sound_layers(members, spark.createDataFrame([("layer:x",), ("layer:z",)], "layer_id string"), nodes).collect()}
    assert kept == {"layer:x": ["file:a.py"], "layer:z": []}
    assert {(r.path, r.folder, r.id) for r in views.file_tree(nodes).collect()} == {("a.py", False, "file:a.py"), ("src", True, None), ("src/b.py", False, "file:b.py")}
    order = spark.createDataFrame([(x, i) for i, x in enumerate(["concept:c", "file:b.py", "file:a.py"])], "id string, pos long")
    tour = views.heuristic_tour(order, nodes, members)
    assert [(r.step, r.title, r.id) for r in tour.orderBy("step", "pos").collect()] == [(1, "layer:x", "file:a.py"), (2, "Supporting", "file:b.py"), (3, "Concepts", "concept:c")]
    assert "- layer:x" in render.onboarding("p", members.select("layer_id").distinct().selectExpr("layer_id", "1 members", "'simple' complexity"), spark.createDataFrame([("a", 1)], "id string, degree int"), tour)


def test_freshness(spark):
    commits = spark.createDataFrame([("c", "b"), ("b", "a"), ("d", "a")], "child string, parent string")
    none = spark.createDataFrame([], "path string")
    assert [views.freshness(commits, x, y, none).get("relation", views.freshness(commits, x, y, none)["state"]) for x, y in (("a", "a"), ("a", "c"), ("c", "a"), ("c", "d"), ("z", "a"))] == ["fresh", "behind", "ahead", "diverged", "unknown"]


def test_blocks(spark):
    files = spark.createDataFrame(
        [
            ("m.py", "python", "import os\nfrom .x import y\nclass K:\n    def m(self):\n        os.path.join(1)\ndef f():\n    g()\n"),
            ("bad.py", "python", "def ("),
            ("s.graphql", "graphql", "type Q {\n  a(x: Int): Int\n}\nscalar D\n"),
            ("p.proto", "protobuf", "message M {\n  string a = 1;\n}\nservice S {\n  rpc Go (M) returns (M);\n}\n"),
            ("t.tf", "terraform", 'resource "aws" "x" {\n  a = {}\n}\nvariable "v" {}\n'),
            ("r.sh", "shell", "go() {\n  x\n}\nsource ./lib.sh\n"),
            ("c.yaml", "yaml", "a: 1\nb:\n  c: 2\n"),
            ("j.json", "json", '{"a": 1, // c\n "b": {"$ref": "x.json"},}'),
            ("n.zig", "zig", "x"),
        ],
        "path string, language string, content string",
    )
    got = {(r.path, r.kind, r.name, r.parent) for r in blocks.parse_files(files).collect()}
    assert {("m.py", "class", "K", None), ("m.py", "method", "m", "K"), ("m.py", "function", "f", None), ("m.py", "call", "g", "f"), ("m.py", "call", "os.path.join", "m"), ("m.py", "import", ".x", None)} <= got
    assert {("s.graphql", "type", "Q", None), ("s.graphql", "field", "a", "Q"), ("s.graphql", "scalar", "D", None), ("p.proto", "field", "a", "M"), ("p.proto", "endpoint", "Go", "S")} <= got
    assert {("t.tf", "resource", "aws.x", None), ("t.tf", "variable", "v", None), ("r.sh", "function", "go", None), ("r.sh", "source", "./lib.sh", None), ("c.yaml", "section", "b", None), ("j.json", "section", "b", None), ("j.json", "reference", "x.json", None)} <= got
    # a file that does not parse is told, one without a parser is not met
    assert [x[:3] for x in got if x[0] in ("bad.py", "n.zig")] == [("bad.py", "failed", "SyntaxError")]


def test_build(spark):
    files = build.file_nodes(spark.createDataFrame([("a.py", "code", 10, 0), ("b.yml", "config", 300, 1)], "path string, category string, lines int, ord int"))
    assert {(r.id, r.complexity) for r in files.collect()} == {("file:a.py", "simple"), ("config:b.yml", "complex")}
    nodes, edges = build.children(spark.createDataFrame([("a.py", "function", "f", 3), ("a.py", "function", "f", 9), ("a.py", "rpc", "x", 4)], "path string, kind string, name string, line int"), files)
    assert {(r.id, r.ord) for r in nodes.collect()} == {("function:a.py:f", 3), ("concept:a.py:x", 4)} and edges.count() == 2


def test_design(spark):
    tree = {"document": {"id": "0", "type": "DOCUMENT", "name": "d", "children": [{"id": "1", "type": "CANVAS", "name": "P", "children": [{"id": "s", "type": "SECTION", "name": "x", "children": [{"id": "2", "type": "FRAME", "name": "F", "styles": {"fill": "st"}, "children": [{"id": "t", "type": "TEXT", "styles": {"text": "st"}}, {"id": "4", "type": "INSTANCE", "name": "I", "componentId": "5"}]}]}, {"id": "6", "type": "COMPONENT_SET", "name": "S", "children": [{"id": "5", "type": "COMPONENT", "name": "C"}]}]}]}}
    nodes, edges = design.design_graph(design.flatten(spark.createDataFrame([("d", json.dumps(tree))], "doc string, json string")))
    assert {r.id for r in nodes.collect()} == {"page:1", "screen:2", "instance:4", "component:5", "componentSet:6", "token:st"}
    got = {(r.source, r.target, r.type) for r in edges.collect()}
    assert got == {("page:1", "screen:2", "contains"), ("screen:2", "instance:4", "contains"), ("page:1", "componentSet:6", "contains"), ("component:5", "componentSet:6", "variant_of"), ("instance:4", "component:5", "instance_of"), ("screen:2", "token:st", "uses_token")}


def test_containers_of_a_layer(spark):
    def run(paths, pairs=()):
        n = spark.createDataFrame([(f"n{k}", p, k) for k, p in enumerate(paths)], "id string, file_path string, ord long")
        e = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in pairs], "source string, target string")
        got = {r.id: (r.container, r.strategy) for r in views.derived_containers(n, e).collect()}
        return [got[f"n{k}"][0] for k in range(len(paths))], {s for _, s in got.values()}

    assert run(["src/auth/a.ts", "src/auth/b.ts", "src/cart/c.ts", "src/cart/x/d.ts", "src/e/f.ts", None, ""]) == (["auth", "auth", "cart", "cart", None, "~", "~"], {"folder"})
    # a file at the top of what is shared: all names share less, and one folder holds too much
    assert run(["src/auth/a.ts", "src/cart/c.ts", "src/e.ts"])[1] == {"community"}
    # what names share ends at a slash, so that of equal folders the last part is told
    assert run(["src/auth/a.ts", "src/author/b.ts"]) == (["auth", "author"], {"folder"})
    assert run(["a/x.ts", "b/y.ts", "b/z.ts"]) == ([None, "b", "b"], {"folder"})
    ring = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)]
    assert run([f"src/app/{k}.ts" for k in range(7)], ring) == (["cluster-0"] * 3 + ["cluster-1"] * 3 + [None], {"community"})
    assert run(["a/1", "a/2", "a/3", "a/4", "b/5"], [(0, 1), (2, 3), (3, 4)])[1] == {"community"}
    assert run([]) == ([], set())


def test_digests_depend_on_rows_alone(spark, monkeypatch):
    from loomgraph.operators import merge

    monkeypatch.setattr(merge, "FAN", 4)
    df = spark.range(3000).selectExpr("id % 2000 as a", "if(id % 7 = 0, null, concat('x', id % 2000)) as b")
    digest = lambda d: merge.canonical_digest(d).first().digest
    whole = digest(df)
    assert digest(df.repartition(5).select("b", "a").orderBy("b")) == whole
    assert len({whole, digest(df.limit(2999)), digest(df.unionByName(df.limit(1))), digest(df.where("false")), digest(df.withColumnRenamed("b", "c"))}) == 5
