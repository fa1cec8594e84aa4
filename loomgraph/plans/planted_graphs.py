"""Builders, repairs, merges, changes and views on planted graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics, batches, build, change, community, merge, repair, search, structure, traverse, views, wiki
from . import render
from .planted import SQL, example, planted, tree

NODES = "id string, type string, name string, file_path string, complexity string, ord long"
EDGES = "source string, target string, type string, weight double, ord long"


def edges(spark, d, rows):
    return planted(spark, d, EDGES, rows).select("source", "target", "type", F.lit("forward").alias("direction"), "weight", "ord")


# builders


@example("id type name file_path complexity", [("file:src/a{id}.py", "file", "a{id}.py", "src/a{id}.py", "simple"), ("document:d{id}.md", "document", "d{id}.md", "d{id}.md", "moderate"), ("resource:x{id}/Dockerfile", "resource", "Dockerfile", "x{id}/Dockerfile", "complex")])
def build_files(spark, d):
    return build.file_nodes(planted(spark, d, "path string, category string, lines long, ord long", [("src/a{id}.py", "code", 10, 0), ("d{id}.md", "docs", 200, 1), ("x{id}/Dockerfile", "infra", 201, 2)]))


DECLARED = [("a{id}.py", "function", "run", 3), ("a{id}.py", "class", "Box", 9), ("a{id}.py", "function", "run", 20), ("m{id}.sql", "table", "users", 1), ("m{id}.sql", "message", "Item", 2), ("m{id}.sql", "resource", "db", 4)]


def declared(spark, d):
    parents = planted(spark, d, "id string, file_path string", [("file:a{id}.py", "a{id}.py"), ("table:m{id}.sql", "m{id}.sql")])
    return build.children(planted(spark, d, "path string, kind string, name string, line int", DECLARED), parents)


@example("id type line", [("function:a{id}.py:run", "function", 3), ("class:a{id}.py:Box", "class", 9), ("table:m{id}.sql:users", "table", 1), ("schema:m{id}.sql:Item", "schema", 2), ("resource:m{id}.sql:db", "resource", 4)])
def build_children(spark, d):
    return declared(spark, d)[0].withColumnRenamed("ord", "line")


@example("source target type weight", [("file:a{id}.py", "function:a{id}.py:run", "contains", 1.0), ("file:a{id}.py", "class:a{id}.py:Box", "contains", 1.0), ("table:m{id}.sql", "table:m{id}.sql:users", "contains", 1.0), ("table:m{id}.sql", "schema:m{id}.sql:Item", "contains", 1.0), ("table:m{id}.sql", "resource:m{id}.sql:db", "contains", 1.0)])
def build_contains(spark, d):
    return declared(spark, d)[1]


@example("source target type weight", [("file:a{id}", "file:b{id}", "imports", 0.7), ("function:f{id}", "function:g{id}", "calls", 0.8)])
def build_links(spark, d):
    i = build.linked("imports", planted(spark, d, "source string, target string", [("file:a{id}", "file:b{id}"), ("file:a{id}", "file:b{id}")]))
    return i.unionByName(build.linked("calls", planted(spark, d, "source string, target string", [("function:f{id}", "function:g{id}")])))


@example("name kept", [("f{id}", False), ("g{id}", True), ("h{id}", True), ("C{id}", False), ("D{id}", True), ("E{id}", True)])
def significant_parts(spark, d):
    df = planted(spark, d, "name string, kind string, lines long, methods long, exported boolean", [("f{id}", "function", 9, 0, False), ("g{id}", "function", 10, 0, False), ("h{id}", "function", 1, 0, True), ("C{id}", "class", 19, 1, False), ("D{id}", "class", 3, 2, False), ("E{id}", "class", 20, 0, False)])
    return df.select("name", build.significant(F.col("kind"), F.col("lines"), F.col("methods"), F.col("exported")).alias("kept"))


@example("lines complexity", [(49, "simple"), (50, "moderate"), (200, "moderate"), (201, "complex")])
def line_complexity(spark, d):
    return planted(spark, d, "lines long", [(49,), (50,), (200,), (201,)]).select("lines", build.complexity_of_lines(F.col("lines")).alias("complexity"))


@example("id new", [("proj:file:a{id}", "file:a{id}"), ("file:file:a{id}", "file:a{id}"), ("file:class:a{id}:B", "class:a{id}:B"), ("run{id}", "function:s.py:run{id}"), ("Pay Now {id}", "step:buy{id}:s.py:pay-now-{id}"), ("step:buy:pay{id}", "step:buy:s.py:pay{id}"), ("x{id}", "concept:x{id}"), ("file:ok{id}", "file:ok{id}")])
def peeled_ids(spark, d):
    rows = [("proj:file:a{id}", "file", "n", None, None), ("file:file:a{id}", "file", "n", None, None), ("file:class:a{id}:B", "class", "B", None, None), ("run{id}", "function", "run{id}", "s.py", None), ("Pay Now {id}", "step", "n", "s.py", "buy{id}"), ("step:buy:pay{id}", "step", "n", "s.py", None), ("x{id}", "concept", "n", None, None), ("file:ok{id}", "file", "n", None, None)]
    df = planted(spark, d, "id string, type string, name string, file_path string, flow string", rows)
    return df.select("id", repair.peeled_id(F.col("id"), F.col("type"), F.col("name"), F.col("file_path"), F.col("flow")).alias("new"))


@example("source target", [("n{id}:2", "n{id}:b"), ("n{id}:b", "x{id}")])
def remap_ends(spark, d):
    moved = planted(spark, d, "old string, new string, ord long", [("n{id}:a", "n{id}:1", 0), ("n{id}:a", "n{id}:2", 1)])
    return repair.remap_ends(edges(spark, d, [("n{id}:a", "n{id}:b", "calls", 1.0, 0), ("n{id}:b", "x{id}", "calls", 1.0, 1)]), moved)


@example("source target weight", [("file:a{id}", "file:c{id}", 0.7)])
def recovered_imports(spark, d):
    files = planted(spark, d, "id string", [("file:a{id}",), ("file:b{id}",), ("file:c{id}",)])
    want = planted(spark, d, "source string, target string", [("file:a{id}", "file:b{id}"), ("file:a{id}", "file:c{id}"), ("file:a{id}", "file:a{id}"), ("file:a{id}", "file:gone")])
    return repair.recovered_imports(edges(spark, d, [("file:a{id}", "file:b{id}", "imports", 0.7, 0)]), want, files)


@example("id flow", [("step:s{id}", "sign-up-{id}"), ("step:t{id}", "buy")])
def step_slugs(spark, d):
    nodes = planted(spark, d, NODES, [("flow:f{id}", "flow", "Sign Up! {id}", None, None, 0), ("flow:g{id}", "flow", "Buy", None, None, 1)])
    return build.step_slugs(edges(spark, d, [("flow:g{id}", "step:s{id}", "flow_step", 0.1, 0), ("flow:f{id}", "step:s{id}", "flow_step", 0.1, 1), ("flow:g{id}", "step:t{id}", "flow_step", 0.2, 2)]), nodes)


# validation


@example("id problem", [("a{id}", None), ("", "missing id"), ("b{id}", "missing name"), ("c{id}", "unknown type"), ("d{id}", "unknown complexity"), ("a{id}", None)])
def checked_rows(spark, d):
    return views.checked_rows(planted(spark, d, NODES, [("a{id}", "file", "n", None, "simple", 0), ("", "file", "n", None, "simple", 1), ("b{id}", "file", " ", None, "simple", 2), ("c{id}", "blob", "n", None, "simple", 3), ("d{id}", "file", "n", None, "huge", 4), ("a{id}", "file", "n", None, "simple", 5)]))


@example("problem", [("bad project",)])
def fatal_checks(spark, d):
    nodes = planted(spark, d, NODES, [("a{id}", "file", "n", None, "simple", 0)])
    return views.fatal(planted(spark, d, "name string", [(" ",)]), nodes, nodes)


SQL["fatal_checks"] = "SELECT 'bad project' AS problem"


@example("layer_id nodes", [("l{id}:x", ["n{id}:z", "n{id}:a"]), ("l{id}:y", [])])
def sound_layers(spark, d):
    members = planted(spark, d, "layer_id string, member_ord long, node_id string", [("l{id}:x", 1, "n{id}:a"), ("l{id}:x", 0, "n{id}:z"), ("l{id}:x", 2, "gone"), ("l{id}:y", 0, "gone")])
    nodes = planted(spark, d, NODES, [("n{id}:a", "file", "n", None, None, 0), ("n{id}:z", "file", "n", None, None, 1)])
    return views.sound_layers(members, planted(spark, d, "layer_id string", [("l{id}:x",), ("l{id}:y",)]), nodes)


@example("layer_id name node_id member_ord", [("layer:api-layer", "API Layer", "file:src/a{id}.ts", 0), ("own{id}", "Data", "file:b{id}.sql", 1)])
def answered_layers(spark, d):
    answer = planted(spark, d, "json string", [('{"layers": [{"name": "API Layer", "files": ["./src/a{id}.ts", "gone{id}.ts"]}, {"id": "own{id}", "name": "Data", "nodeIds": ["file:none{id}", "file:b{id}.sql"]}]}',)])
    return views.answered_layers(answer, planted(spark, d, NODES, [("file:src/a{id}.ts", "file", "n", None, None, 0), ("file:b{id}.sql", "file", "n", None, None, 1)]))


@example("id parent width height", [("a{id}", None, 200.0, 60.0), ("b{id}", "a{id}", 10.0, 60.0), ("c{id}", None, 200.0, 60.0), ("d{id}", None, 200.0, 60.0)])
def repaired_layout(spark, d):
    rows = [("a{id}", None, 0, None, None), ("b{id}", "a{id}", 1, 10.0, None), ("b{id}", "a{id}", 2, 99.0, None), ("c{id}", "d{id}", 3, None, None), ("d{id}", "c{id}", 4, None, None), ("e{id}", "gone{id}", 5, None, None)]
    return views.repaired_layout(planted(spark, d, "id string, parent string, ord long, width double, height double", rows))


# merges

MERGED_NODES = [("file:file:a{id}.py", "file", "a", "a{id}.py", "low", 0), ("file:test_a{id}.py", "file", "t", "test_a{id}.py", "simple", 1), ("func:f{id}", "function", "f", "a{id}.py", "9", 2), ("file:a{id}.py", "file", "later", "a{id}.py", "complex", 3)]
MERGED_EDGES = [("file:file:a{id}.py", "func:f{id}", "contains", 1.0, 0), ("file:test_a{id}.py", "file:file:a{id}.py", "tested_by", 0.5, 1), ("file:a{id}.py", "function:f{id}", "contains", 0.4, 2), ("file:a{id}.py", "file:gone{id}", "imports", 0.7, 3)]


def merged(spark, d):
    return merge.merge_batches(planted(spark, d, NODES, MERGED_NODES), edges(spark, d, MERGED_EDGES))


@example("id type name complexity ord", [("file:a{id}.py", "file", "later", "complex", 0), ("file:test_a{id}.py", "file", "t", "simple", 1), ("function:f{id}", "function", "f", "complex", 2)])
def merged_nodes(spark, d):
    return merged(spark, d)["nodes"]


@example("source target type weight", [("file:a{id}.py", "function:f{id}", "contains", 1.0), ("file:a{id}.py", "file:test_a{id}.py", "tested_by", 0.5)])
def merged_edges(spark, d):
    return merged(spark, d)["edges"]


@example("what n", [("ids normalised", 2), ("complexities normalised", 2), ("duplicate nodes", 1), ("edges without target", 1)])
def merge_report(spark, d):
    return merged(spark, d)["report"]


SQL["merge_report"] = "SELECT what, n * (SELECT count(*) FROM documents WHERE doc_id IS NOT NULL) AS n FROM (VALUES ('ids normalised', 2), ('complexities normalised', 2), ('duplicate nodes', 1), ('edges without target', 1)) v(what, n)"


@example("id name", [("file:b{id}", "new"), ("file:c{id}", "kept")])
def pruned_merge(spark, d):
    nodes = planted(spark, d, NODES, [("file:b{id}", "file", "old", "b{id}", "simple", 0), ("function:b{id}:f", "function", "gone", "b{id}", "simple", 1), ("file:c{id}", "file", "kept", "c{id}", "simple", 2)])
    new = planted(spark, d, NODES, [("file:b{id}", "file", "new", "b{id}", "simple", 0)])
    none = edges(spark, d, [("file:c{id}", "file:b{id}", "calls", 0.5, 0)])
    return merge.pruned_merge(nodes, none, planted(spark, d, "file_path string", [("b{id}",)]), new, none)["nodes"]


@example("source target kept", [("d{id}", "f{id}", "now"), ("d{id}", "g{id}", "waits")])
def pending_edges(spark, d):
    nodes = planted(spark, d, NODES, [("d{id}", "domain", "n", None, None, 0), ("f{id}", "flow", "n", None, None, 1)])
    waiting = edges(spark, d, [("d{id}", "f{id}", "contains_flow", 1.0, 0)])
    now, later = merge.split_pending(edges(spark, d, [("d{id}", "g{id}", "contains_flow", 1.0, 1), ("d{id}", "x{id}", "calls", 1.0, 2)]), nodes, waiting)
    return now.select("source", "target", F.lit("now").alias("kept")).unionByName(later.select("source", "target", F.lit("waits").alias("kept")))


@example("step title description nodes", [(1, "Start", "longer text", ["a", "b", "c"]), (2, "End", "x", ["d"])])
def merged_tours(spark, d):
    df = planted(spark, d, "ord long, title string, description string, nodes array<string>", [(0, "Start", "text", ["a", "b"]), (1, "End", "x", ["d"]), (2, "Start", "longer text", ["b", "c"])])
    return merge.merge_tours(df)


SQL["merged_tours"] = "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'Start', 'longer text', ['a', 'b', 'c']), (2, 'End', 'x', ['d'])) v(step, title, description, nodes)"


@example("name languages description analyzed_at commit", [("P", ["go", "ts"], "one | two", "2024", "c2")])
def merged_projects(spark, d):
    df = spark.createDataFrame([(0, "P", ["go"], "one", "2023", "c1"), (1, "Q", ["ts", "go"], "two", "2024", "c2"), (2, "R", [], "one", "2022", "c3")], "ord long, name string, languages array<string>, description string, analyzed_at string, commit string")
    return merge.merge_projects(df)


SQL["merged_projects"] = "SELECT 'P' AS name, ['go', 'ts'] AS languages, 'one | two' AS description, '2024' AS analyzed_at, 'c2' AS commit"


@example("layer_id node_id", [("l{id}:api", "n{id}:a"), ("l{id}:api", "n{id}:new"), ("layer:other", "n{id}:far")])
def placed_files(spark, d):
    members = planted(spark, d, "layer_id string, node_id string, path string", [("l{id}:api", "n{id}:a", "p{id}/api/a.py"), ("l{id}:db", "n{id}:b", "p{id}/db/b.py")])
    files = planted(spark, d, "node_id string, path string", [("n{id}:new", "p{id}/api/n.py"), ("n{id}:far", "p{id}/x/f.py"), ("n{id}:a", "p{id}/api/a.py")])
    return merge.place_files(members, files, planted(spark, d, "path string", [("p{id}/db/b.py",)]))


@example("path h", [("a{id}", "new"), ("c{id}", "c")])
def patched_fingerprints(spark, d):
    store = planted(spark, d, "path string, h string", [("a{id}", "a"), ("b{id}", "b"), ("c{id}", "c")])
    return merge.patch_fingerprints(store, planted(spark, d, "path string, h string", [("a{id}", "new")]), planted(spark, d, "path string", [("b{id}",)]), 3)


@example("path", [("a{id}.py",), ("b{id}.py",)])
def changed_files(spark, d):
    return merge.changed_files(planted(spark, d, "line string", [("a{id}.py",), (" b{id}.py ",), ("",), ("a{id}.py",)]))


@example("id summary tags", [("p{id}", "second", ["t"]), ("q{id}", "own", ["x"])])
def patched_nodes(spark, d):
    nodes = planted(spark, d, "id string, summary string, tags array<string>", [("p{id}", "old", ["a"]), ("q{id}", "own", ["x"])])
    return merge.patch_nodes(nodes, planted(spark, d, "id string, ord long, summary string, tags array<string>", [("p{id}", 0, "first", ["s"]), ("p{id}", 1, "second", ["t"]), ("gone", 2, "z", [])]))


@example("layer_id node_id", [("layer:page:{id}", "page:{id}"), ("layer:page:{id}", "screen:{id}"), ("layer:page:{id}", "instance:{id}"), ("layer:design-system", "token:{id}")])
def page_layers(spark, d):
    nodes = planted(spark, d, NODES, [("page:{id}", "page", "n", None, None, 0), ("screen:{id}", "screen", "n", None, None, 1), ("instance:{id}", "instance", "n", None, None, 2), ("token:{id}", "token", "n", None, None, 3)])
    return merge.page_layers(nodes, edges(spark, d, [("page:{id}", "screen:{id}", "contains", 1.0, 0), ("screen:{id}", "instance:{id}", "contains", 1.0, 1)]))


WIKI_NODES = [("article:a{id}", "article", "A", None, None, 0), ("article:b{id}", "article", "B", None, None, 1), ("topic:t{id}", "topic", "T", None, None, 2), ("entity:e{id}", "entity", "E", None, None, 3), ("claim:c{id}", "claim", "C", None, None, 4)]
WIKI_EDGES = [("article:a{id}", "topic:t{id}", "categorized_under", 0.6, 0), ("article:a{id}", "entity:e{id}", "related", 0.7, 1), ("article:b{id}", "entity:e{id}", "related", 0.7, 2)]


def wiki_layers(spark, d):
    return merge.category_layers(planted(spark, d, NODES, WIKI_NODES), edges(spark, d, WIKI_EDGES))


@example("layer_id node_id", [("topic:t{id}", "article:a{id}"), ("topic:t{id}", "topic:t{id}"), ("topic:t{id}", "entity:e{id}"), ("layer:other", "article:b{id}"), ("layer:other", "claim:c{id}")])
def category_layers(spark, d):
    return wiki_layers(spark, d)


@example("layer_id place node_id", [("topic:t{id}", 1, "article:a{id}")])
def category_tour(spark, d):
    return merge.category_tour(wiki_layers(spark, d).where("layer_id != 'layer:other'"), planted(spark, d, NODES, WIKI_NODES))


@example("id name kept", [("e{id}:1", "Ann Lee {id}", True), ("e{id}:3", "Bob {id}", True)])
def merged_entities(spark, d):
    e = planted(spark, d, "id string, name string, ord long", [("e{id}:1", "Ann Lee {id}", 0), ("e{id}:2", " ann-lee {id}", 1), ("e{id}:3", "Bob {id}", 2)])
    return wiki.merge_entities(e)[0].select("id", "name", F.lit(True).alias("kept"))


WIKI_PAGES = {"w{id}/home{id}.md": "# Home {id}\n[[Other{id}]] [[none]]", "w{id}/other{id}.md": "text [[home{id}|back]]"}


@example("id type name", [("article:w{id}/home{id}", "article", "Home {id}"), ("article:w{id}/other{id}", "article", "other{id}"), ("topic:all-{id}", "topic", "All {id}")])
def wiki_nodes(spark, d):
    return wiki.wiki_graph(tree(spark, d, WIKI_PAGES), tree(spark, d, {"index{id}.md": "## All {id}\n[[home{id}]]"}))[0]


@example("source target type weight", [("article:w{id}/home{id}", "article:w{id}/other{id}", "related", 0.7), ("article:w{id}/other{id}", "article:w{id}/home{id}", "related", 0.7), ("article:w{id}/home{id}", "topic:all-{id}", "categorized_under", 0.6)])
def wiki_edges(spark, d):
    return wiki.wiki_graph(tree(spark, d, WIKI_PAGES), tree(spark, d, {"index{id}.md": "## All {id}\n[[home{id}]]"}))[1]


# changes

OLD = {"a{id}.py": "import os\ndef run(x):\n    return x\ndef gone():\n    pass\nclass Box:\n    def open(self): pass\n", "b{id}.py": "def f():\n    return 1\n", "c{id}.py": "x = 1\n", "e{id}.py": "def g(): pass\n"}
NEW = {"a{id}.py": "import sys\ndef run(x, y) -> int:\n    return x\ndef fresh():\n    pass\nclass Box:\n    def close(self): pass\n", "b{id}.py": "def f():\n    return 2\n", "c{id}.py": "x = 1\n", "e{id}.py": "def g(:\n"}


@example("path level details", [("a{id}.py", "STRUCTURAL", ["new function: fresh", "removed function: gone", "params changed: run", "return type changed: run", "methods changed: Box", "imports changed", "exports changed"]), ("b{id}.py", "COSMETIC", ["internal logic changed"]), ("c{id}.py", "NONE", []), ("e{id}.py", "STRUCTURAL", ["no structural analysis"])])
def compared_fingerprints(spark, d):
    def prints(files):
        df = tree(spark, d, files).withColumn("language", F.lit("python"))
        return change.structural_fingerprints(df, structure.structure(df))

    return change.compare_fingerprints(prints(OLD), prints(NEW))


# batches


@example("path family mergeable", [("s{id}/Dockerfile", "A", False), ("s{id}/docker-compose.yml", "A", False), (".github/workflows/w{id}.yml", "B", False), (".circleci/c{id}.yml", "C", False), ("db{id}/migrations/1.sql", "D", False), ("s{id}/readme.md", "E", True), ("docker-compose.{id}.yml", "E", True)])
def noncode_groups(spark, d):
    names = ("s{id}/Dockerfile", "s{id}/docker-compose.yml", ".github/workflows/w{id}.yml", ".circleci/c{id}.yml", "db{id}/migrations/1.sql", "s{id}/readme.md", "docker-compose.{id}.yml")
    return batches.noncode_groups(planted(spark, d, "path string", [(n,) for n in names]))


@example("path batch", [("a", 1)])
def changed_batches(spark, d):
    own = planted(spark, d, "path string, batch long, n string", [("a{id}/x.py", 0, "{id}"), ("a{id}/y.py", 0, "{id}"), ("b{id}.py", 1, "{id}")]).select("path", (F.col("batch") + 2 * F.col("n").cast("long")).alias("batch"))
    return batches.changed_batches(own, planted(spark, d, "path string", [("./a{id}//x.py",)]))


SQL["changed_batches"] = "SELECT p || doc_id || s AS path, 2 * doc_id AS batch FROM documents, (VALUES ('a', '/x.py'), ('a', '/y.py')) v(p, s) WHERE doc_id IS NOT NULL"


@example("grp batch", [("a", 1)])
def ordered_batches(spark, d):
    members = planted(spark, d, "grp string, path string", [("g{id}", "z{id}/1"), ("g{id}", "z{id}/2"), ("h{id}", "a{id}/1")])
    return batches.ordered(members)


SQL["ordered_batches"] = "SELECT grp, row_number() OVER (ORDER BY n DESC, first) AS batch FROM (SELECT 'g' || doc_id AS grp, 2 AS n, 'z' || doc_id || '/1' AS first FROM documents WHERE doc_id IS NOT NULL UNION ALL SELECT 'h' || doc_id, 1, 'a' || doc_id || '/1' FROM documents WHERE doc_id IS NOT NULL)"


@example("path batch", [("a", 1)])
def merged_small_batches(spark, d):
    members = planted(spark, d, "path string, grp string, place string, mergeable boolean", [("k{id}/1", "k{id}", "{id}", True), ("k{id}/2", "k{id}", "{id}", True), ("k{id}/3", "k{id}", "{id}", True), ("m{id}", "m{id}", "{id}", True), ("f{id}", "f{id}", "{id}", False)])
    place = F.col("place").cast("long") * 2 + F.when(F.col("grp").startswith("f"), 1).otherwise(0)
    return batches.merged_small(members.withColumn("place", place))


SQL["merged_small_batches"] = """WITH ids AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, count(*) OVER () AS n FROM documents WHERE doc_id IS NOT NULL)
SELECT 'k' || doc_id || '/' || k AS path, 2 * r - 1 AS batch FROM ids, (VALUES (1), (2), (3)) v(k) UNION ALL SELECT 'f' || doc_id, 2 * r FROM ids
UNION ALL SELECT path, CAST((row_number() OVER (ORDER BY path) - 1) // 25 + 2 * n + 1 AS BIGINT) FROM (SELECT 'm' || doc_id AS path, n FROM ids)"""


# views

VIEW_NODES = [("a{id}", "article", "n", "p{id}/a", "simple", 0), ("b{id}", "article", "n", "p{id}/b", "simple", 1), ("t{id}", "topic", "n", None, "simple", 2), ("f{id}", "flow", "n", None, "simple", 3), ("s{id}", "step", "n", None, "simple", 4), ("u{id}", "step", "n", None, "simple", 5)]
VIEW_EDGES = [("a{id}", "b{id}", "related", 0.7, 0), ("b{id}", "a{id}", "related", 0.7, 1), ("a{id}", "t{id}", "categorized_under", 0.6, 2), ("a{id}", "f{id}", "contains_flow", 1.0, 3), ("f{id}", "u{id}", "flow_step", 0.2, 4), ("f{id}", "s{id}", "flow_step", 0.1, 5)]


@example("id", [("a{id}",), ("b{id}",)])
def focus_nodes(spark, d):
    seen = planted(spark, d, "id string", [("a{id}",), ("b{id}",), ("s{id}",)])
    first = spark.read.parquet(f"{d}/documents.parquet").agg(F.min("doc_id")).first()[0]
    return views.focus(planted(spark, d, NODES, VIEW_NODES), edges(spark, d, VIEW_EDGES), seen, f"a{first}")[0]


SQL["focus_nodes"] = "SELECT v.c || (SELECT min(doc_id) FROM documents) AS id FROM (VALUES ('a'), ('b')) v(c)"


@example("role id place", [("x", "x", 1)])
def node_details(spark, d):
    first = spark.read.parquet(f"{d}/documents.parquet").agg(F.min("doc_id")).first()[0]
    nodes, e = planted(spark, d, NODES, VIEW_NODES), edges(spark, d, VIEW_EDGES)
    return views.node_details(nodes, e, f"a{first}").unionByName(views.node_details(nodes, e, f"f{first}"))


SQL["node_details"] = "SELECT role, c || (SELECT min(doc_id) FROM documents) AS id, CAST(place AS BIGINT) AS place FROM (VALUES ('wikilink', 'b', 1), ('backlink', 'b', 1), ('category', 't', 1), ('flow', 'f', 1), ('step', 's', 1), ('step', 'u', 2), ('other', 'a', 1)) v(role, c, place)"


@example("flow step position", [("x", "x", 1)])
def domain_detail(spark, d):
    first = spark.read.parquet(f"{d}/documents.parquet").agg(F.min("doc_id")).first()[0]
    return views.domain_detail(edges(spark, d, VIEW_EDGES), f"a{first}")


SQL["domain_detail"] = "SELECT 'f' || m AS flow, c || m AS step, CAST(position AS BIGINT) AS position FROM (SELECT min(doc_id) AS m FROM documents), (VALUES ('s', 1), ('u', 2)) v(c, position)"


@example("id flows steps", [("d{id}", 2, 3), ("e{id}", 0, 0)])
def domain_overview(spark, d):
    nodes = planted(spark, d, NODES, [("d{id}", "domain", "n", None, None, 0), ("e{id}", "domain", "n", None, None, 1)])
    return views.domain_overview(nodes, edges(spark, d, [("d{id}", "f{id}", "contains_flow", 1.0, 0), ("d{id}", "g{id}", "contains_flow", 1.0, 1), ("f{id}", "s{id}", "flow_step", 0.1, 2), ("f{id}", "t{id}", "flow_step", 0.2, 3), ("g{id}", "s{id}", "flow_step", 0.1, 4)]))


@example("layer_id n", [("l{id}:x", 2)])
def matches_per_layer(spark, d):
    members = planted(spark, d, "layer_id string, layer_ord long, node_id string", [("l{id}:x", 0, "a{id}"), ("l{id}:y", 1, "a{id}"), ("l{id}:x", 0, "b{id}"), ("l{id}:y", 1, "c{id}")])
    return views.matches_per_layer(planted(spark, d, "id string", [("a{id}",), ("b{id}",), ("a{id}",), ("none",)]), members)


@example("id", [("b{id}",), ("t{id}",)])
def knowledge_visible(spark, d):
    nodes = planted(spark, d, NODES, [("b{id}", "article", "n", None, None, 0), ("c{id}", "claim", "n", None, None, 1), ("t{id}", "topic", "n", None, None, 2)])
    return views.knowledge_visible(nodes, {"claim": False, "topic": True})


@example("part json", [("node", '{"id":"a{id}","name":"x"}'), ("edge", '{"source":"a{id}","target":"a{id}"}'), ("layer", '{"layer_id":"l{id}","nodes":["a{id}"]}'), ("step", '{"nodes":["a{id}"],"step":1}')])
def filtered_export(spark, d):
    nodes = planted(spark, d, "id string, name string", [("a{id}", "x"), ("b{id}", "y")])
    e = planted(spark, d, "source string, target string", [("a{id}", "a{id}"), ("a{id}", "b{id}")])
    return views.exported(nodes, e, planted(spark, d, "layer_id string, node_id string", [("l{id}", "a{id}"), ("l{id}", "b{id}")]), planted(spark, d, "step long, id string, n string", [(1, "a{id}", "{id}")]).select("step", "id").limit(0).unionByName(planted(spark, d, "step long, id string", [(1, "a{id}")])).groupBy("id").agg(F.min("step").alias("step")), planted(spark, d, "id string", [("a{id}",)]))


SQL["filtered_export"] = """SELECT 'node' AS part, '{"id":"a' || doc_id || '","name":"x"}' AS json FROM documents WHERE doc_id IS NOT NULL
UNION ALL SELECT 'edge', '{"source":"a' || doc_id || '","target":"a' || doc_id || '"}' FROM documents WHERE doc_id IS NOT NULL
UNION ALL SELECT 'layer', '{"layer_id":"l' || doc_id || '","nodes":["a' || doc_id || '"]}' FROM documents WHERE doc_id IS NOT NULL
UNION ALL SELECT 'step', '{"nodes":[' || string_agg('"a' || doc_id || '"', ',' ORDER BY 'a' || doc_id) || '],"step":1}' FROM documents WHERE doc_id IS NOT NULL"""


@example("path label", [("a{id}/routes/x.py", "api"), ("a{id}/utils/deep{id}/x.py", "utility"), ("a{id}/x.test.ts", "test"), ("a{id}/types/x.d.ts", "types"), ("a{id}/Makefile", "infrastructure"), ("a{id}/src/main/java/x{id}/A.java", "service"), ("a{id}/plain.py", None)])
def path_labels(spark, d):
    names = ("a{id}/routes/x.py", "a{id}/utils/deep{id}/x.py", "a{id}/x.test.ts", "a{id}/types/x.d.ts", "a{id}/Makefile", "a{id}/src/main/java/x{id}/A.java", "a{id}/plain.py")
    return planted(spark, d, "path string", [(n,) for n in names]).select("path", analytics.path_label(F.col("path")).alias("label"))


@example("root has_dockerfile has_compose has_k8s has_terraform has_ci infra_files", [("r{id}", True, True, False, True, True, 4), ("q{id}", False, False, False, False, False, 0)])
def deployment(spark, d):
    rows = [("r{id}", p) for p in ("Dockerfile.dev", "docker-compose.yml", "m.tf", ".github/workflows/ci.yml", "a.py")] + [("q{id}", "a.py")]
    return analytics.deployment(planted(spark, d, "root string, path string", rows), ["root"])


@example("root groups with_docs coverage", [("r{id}", 3, 2, 0.6667)])
def doc_coverage(spark, d):
    rows = [("r{id}", p) for p in ("api/README.md", "api/a.py", "core/b.py", "ui/c.ts", "docs/core.md", "top.py")]
    return analytics.documented_groups(planted(spark, d, "root string, path string", rows), ["root"])


@example("family id", [("documents", "a{id}"), ("infrastructure", "b{id}"), ("data", "c{id}"), ("configuration", "e{id}")])
def inventory_families(spark, d):
    return analytics.inventory_families(planted(spark, d, "id string, type string", [("a{id}", "document"), ("b{id}", "pipeline"), ("c{id}", "table"), ("e{id}", "config"), ("f{id}", "file")]))


@example("root path grp", [("r{id}", "src/app/api/a.py", "api"), ("r{id}", "src/app/ui/b/c.py", "ui"), ("r{id}", "src/app/d.py", "(root)"), ("f{id}", "a.py", "py"), ("f{id}", "b.sql", "sql")])
def folder_groups(spark, d):
    rows = [("r{id}", "src/app/api/a.py"), ("r{id}", "src/app/ui/b/c.py"), ("r{id}", "src/app/d.py"), ("f{id}", "a.py"), ("f{id}", "b.sql")]
    return analytics.grouped_folders(planted(spark, d, "root string, path string", rows), ["root"])


# reports


@example("stage n messages truncated", [("s{id}", 6, ["m0", "m1", "m2", "m3", "m4"], True), ("t{id}", 1, ["m"], False)])
def bounded_warnings(spark, d):
    return merge.bounded_warnings(planted(spark, d, "stage string, ord long, message string", [("s{id}", k, f"m{k}") for k in range(6)] + [("t{id}", 0, "m")]))


@example("files function_count class_count", [(1, 2, 3)])
def structure_sums(spark, d):
    return merge.structure_sums(planted(spark, d, "path string, function_count long, class_count long", [("a{id}", 2, 1), ("b{id}", 0, 4)]))


SQL["structure_sums"] = "SELECT 2 * n AS files, 2 * n AS function_count, 5 * n AS class_count FROM (SELECT count(*) AS n FROM documents WHERE doc_id IS NOT NULL)"


@example("same", [(True,)])
def canonical_digest(spark, d):
    rows = planted(spark, d, "b string, a string", [("x{id}", "y"), ("z", "{id}")])
    one, two = merge.canonical_digest(rows), merge.canonical_digest(rows.repartition(3).select("a", "b"))
    return one.crossJoin(two.withColumnRenamed("digest", "other")).select((F.col("digest") == F.col("other")).alias("same"))  # one row each


SQL["canonical_digest"] = "SELECT true AS same"


# loops


@example("pos id", [(0, "x")])
def chain_path(spark, d):
    """First found by edge order, either way along edges."""
    e = edges(spark, d, [("c{id}", "d{id}", "calls", 1.0, 0), ("d{id}", "e{id}", "calls", 1.0, 1), ("c{id}", "e{id}", "related", 1.0, 2), ("e{id}", "f{id}", "calls", 1.0, 3)])
    first = spark.read.parquet(f"{d}/documents.parquet").agg(F.min("doc_id")).first()[0]
    return traverse.shortest_path(e, f"f{first}", f"c{first}")


SQL["chain_path"] = "SELECT CAST(pos AS BIGINT) AS pos, c || (SELECT min(doc_id) FROM documents) AS id FROM (VALUES (0, 'f'), (1, 'e'), (2, 'c')) v(pos, c)"


@example("cluster id", [("a{id}|b{id}", "a{id}"), ("a{id}|b{id}", "b{id}"), ("a{id}|b{id}", "c{id}")])
def coupling(spark, d):
    e = edges(spark, d, [("a{id}", "b{id}", "imports", 1.0, 0), ("b{id}", "a{id}", "calls", 1.0, 1), ("c{id}", "a{id}", "calls", 1.0, 2), ("b{id}", "c{id}", "calls", 1.0, 3), ("x{id}", "a{id}", "calls", 1.0, 4)])
    return traverse.coupling_clusters(analytics.mutual_pairs(e), e)


@example("id level pos", [("a{id}", 0, 0), ("b{id}", 1, 0), ("c{id}", 2, 0), ("x{id}", -1, 0), ("y{id}", -1, 0)])
def kahn_order(spark, d):
    """Levels, and the whole order: of each level by the last edge that freed a node; cycles come last, in node order."""
    nodes = planted(spark, d, NODES, [(f"{c}{{id}}", "file", "n", None, None, k) for k, c in enumerate("abcxy")])
    return traverse.topological_levels(nodes, edges(spark, d, [("a{id}", "b{id}", "calls", 1.0, 0), ("b{id}", "c{id}", "calls", 1.0, 1), ("a{id}", "c{id}", "calls", 1.0, 2), ("x{id}", "y{id}", "calls", 1.0, 3), ("y{id}", "x{id}", "calls", 1.0, 4)]))


@example("id score", [("a{id}", 0.0), ("b{id}", 0.1)])
def planted_search(spark, d):
    nodes = planted(spark, d, NODES, [("a{id}", "file", "zebra", None, None, 0), ("b{id}", "file", "the Zebra house", None, None, 1), ("c{id}", "file", "quite other", None, None, 2), ("d{id}", "class", "zebra", None, None, 3)])
    return search.fuzzy(nodes.select("id", "type", "name", "ord"), " Zebra ", ["file"], 2**31 - 1)


@example("title id", [("layer:{id}", "a{id}"), ("layer:{id}", "b{id}"), ("Concepts", "c{id}"), ("Supporting", "s{id}")])
def planted_tour(spark, d):
    kinds = [("a{id}", "file"), ("b{id}", "file"), ("c{id}", "concept"), ("s{id}", "file")]
    nodes = planted(spark, d, NODES, [(i, t, "n", None, None, k) for k, (i, t) in enumerate(kinds)])
    order = nodes.select("id", F.col("ord").alias("pos"))
    members = planted(spark, d, "layer_id string, layer_ord long, node_id string", [("layer:{id}", 0, "a{id}"), ("layer:{id}", 0, "b{id}"), ("layer:{id}", 0, "c{id}")])
    return views.heuristic_tour(order, nodes, members).select("title", "id")


SQL["kahn_order"] = """WITH ids AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS n FROM documents WHERE doc_id IS NOT NULL)
SELECT c || doc_id AS id, CAST(level AS BIGINT) AS level, CAST(CASE WHEN level >= 0 THEN level * n + r ELSE 3 * n + 2 * r + k END AS BIGINT) AS pos FROM ids, (VALUES ('a', 0, 0), ('b', 1, 0), ('c', 2, 0), ('x', -1, 0), ('y', -1, 1)) v(c, level, k)"""


@example("id at", [("a{id}", -1), ("b{id}", 0), ("c{id}", 1)])
def contains_reach(spark, d):
    e = edges(spark, d, [("a{id}", "b{id}", "contains", 1.0, 0), ("b{id}", "c{id}", "contains", 1.0, 1), ("d{id}", "e{id}", "contains", 1.0, 2)])
    got = change.contains_growth(e, planted(spark, d, "id string", [("a{id}",)]))
    return got.select("id", F.when(F.col("at") < 0, F.col("at")).otherwise(F.col("at") % 1000).alias("at"))


@example("n text", [(1, "x")])
def onboarding_text(spark, d):
    layers = planted(spark, d, "layer_id string, members long, complexity string", [("layer:{id}", 2, "simple")])
    empty = layers.limit(0).select(F.col("layer_id").alias("id"), F.col("members").alias("degree"))
    steps = layers.limit(0).select(F.col("members").alias("step"), F.col("layer_id").alias("title"), F.col("layer_id").alias("id"), F.col("members").alias("pos"))
    text = render.onboarding("P", layers, empty, steps)
    n = sum(x.startswith("- layer:") for x in text.split("\n"))
    return spark.createDataFrame([(n, "more rows" if "more" in text else "whole")], "n long, text string")


SQL["onboarding_text"] = "SELECT least(count(*), 200) AS n, CASE WHEN count(*) > 200 THEN 'more rows' ELSE 'whole' END AS text FROM documents WHERE doc_id IS NOT NULL"
