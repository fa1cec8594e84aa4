"""Parsers, import resolvers and scans on planted trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks, design, domain, imports, parse, structure
from ..sources import files as sources
from .examples import FOUND, SOURCES
from .planted import QUERIES, SQL, example, expected, planted, tree

# parsers of lines and blocks

MARKDOWN = "# Guide {id}\ntext [home](docs/home{id}.md) and ![pic](img/p.png)\n```sh\n# no heading\n```\n## Part *one*\n[out](https://example.com/x)\n### Deep ##\nend"


@example("path start name level end", [("doc{id}.md", 1, "Guide {id}", 1, 5), ("doc{id}.md", 6, "Part *one*", 2, 7), ("doc{id}.md", 8, "Deep", 3, 9)])
def markdown_sections(spark, d):
    return parse.markdown_sections(tree(spark, d, {"doc{id}.md": MARKDOWN}))


@example("path target kind", [("doc{id}.md", "docs/home{id}.md", "link"), ("doc{id}.md", "img/p.png", "image")])
def markdown_references(spark, d):
    return parse.markdown_references(tree(spark, d, {"doc{id}.md": MARKDOWN}))


@example("path start name level end", [("c{id}.toml", 2, "tool", 1, 4), ("c{id}.toml", 5, "tool.x{id}", 2, 6), ("c{id}.toml", 7, "bin", 1, 8)])
def toml_sections(spark, d):
    return parse.toml_sections(tree(spark, d, {"c{id}.toml": 'title = "x"\n[tool]\na = 1\n# [no]\n[tool.x{id}] # note\nb = [1]\n[[bin]]\nname = "y"'}))


@example("path line name", [(".env.{id}", 2, "HOST{id}"), (".env.{id}", 4, "PORT")])
def env_variables(spark, d):
    return parse.env_variables(tree(spark, d, {".env.{id}": "# A=1\nHOST{id}=localhost\n\nexport PORT = 80\nnone"}))


DOCKER = "FROM node:20 AS build{id}\nWORKDIR /app\nRUN npm ci\nFROM registry.example.com/base/nginx:1.2\nCOPY --from=build{id} /app /srv\nEXPOSE 80 443/tcp\nEXPOSE 8080\nCMD [\"run\"]"


@example("path stage name ports", [("Dockerfile.{id}", 1, "build{id}", []), ("Dockerfile.{id}", 2, "nginx", ["80", "443", "8080"])])
def dockerfile_stages(spark, d):
    return parse.dockerfile_stages(tree(spark, d, {"Dockerfile.{id}": DOCKER})).withColumn("ports", F.col("ports").cast("array<string>"))


@example("path line name", [("Dockerfile.{id}", 2, "WORKDIR /app"), ("Dockerfile.{id}", 3, "RUN npm ci"), ("Dockerfile.{id}", 5, "COPY --from=build{id} /app /srv"), ("Dockerfile.{id}", 8, 'CMD ["run"]')])
def dockerfile_steps(spark, d):
    return parse.dockerfile_steps(tree(spark, d, {"Dockerfile.{id}": DOCKER}))


@example("path line name", [("Makefile", 2, "all{id}"), ("Makefile", 5, "build/x")])
def make_targets(spark, d):
    return parse.make_targets(tree(spark, d, {"Makefile": "CC := gcc\nall{id}: build/x\n\techo hi\n.PHONY: all\nbuild/x : src\n\tcc"}))


DDL = "CREATE TABLE users{id} (\n  id INT PRIMARY KEY,\n  name VARCHAR(20) DEFAULT 'x',\n  amount DECIMAL(10, 2),\n  FOREIGN KEY (id) REFERENCES t(id)\n);\ncreate or replace view v{id} as select 1;\nCREATE UNIQUE INDEX idx{id} ON users(id);"


@example("path name kind", [("m{id}.sql", "users{id}", "table"), ("m{id}.sql", "v{id}", "view"), ("m{id}.sql", "idx{id}", "index")])
def sql_tables(spark, d):
    return parse.sql_tables(tree(spark, d, {"m{id}.sql": DDL}))


@example("path table name", [("m{id}.sql", "users{id}", "id"), ("m{id}.sql", "users{id}", "name"), ("m{id}.sql", "users{id}", "amount")])
def sql_columns(spark, d):
    return parse.sql_columns(tree(spark, d, {"m{id}.sql": DDL}))


def parsed(spark, d, language, path, text):
    df = tree(spark, d, {path: text}).withColumn("language", F.lit(language))
    return blocks.parse_files(df).select("path", "kind", "name", "start", "end", "parent")


_BLOCK = "path kind name start end parent"


@example(_BLOCK, [("k{id}.yaml", "section", "name", 1, 1, None), ("k{id}.yaml", "section", "job{id}", 2, 4, None), ("k{id}.yaml", "section", "list", 5, 6, None)])
def yaml_keys(spark, d):
    return parsed(spark, d, "yaml", "k{id}.yaml", "name: x\njob{id}:\n  steps: 1\n# c\nlist:\n- a: 1")


@example(_BLOCK, [("k{id}.json", "section", "name{id}", 2, 2, None), ("k{id}.json", "section", "items", 3, 3, None), ("k{id}.json", "reference", "other{id}.json", 3, 3, None)])
def json_keys(spark, d):
    return parsed(spark, d, "jsonc", "k{id}.json", '{ // note\n  "name{id}": "http://x",\n  "items": [{"$ref": "other{id}.json"}, {"$ref": "#/own"}],\n}')


@example(_BLOCK, [("s.graphql", "type", "User{id}", 1, 4, None), ("s.graphql", "field", "id", 2, 2, "User{id}"), ("s.graphql", "field", "posts", 3, 3, "User{id}"), ("s.graphql", "type", "Query", 5, 7, None), ("s.graphql", "endpoint", "user{id}", 6, 6, "Query"), ("s.graphql", "enum", "Kind", 8, 8, None), ("s.graphql", "scalar", "Date", 9, 9, None)])
def graphql_blocks(spark, d):
    return parsed(spark, d, "graphql", "s.graphql", "type User{id} {\n  id: ID!\n  posts(n: Int): [Post]\n}\ntype Query {\n  user{id}(id: ID): User\n}\nenum Kind { A B }\nscalar Date")


@example(_BLOCK, [("a.proto", "message", "Item{id}", 2, 5, None), ("a.proto", "field", "name", 3, 3, "Item{id}"), ("a.proto", "field", "tags", 4, 4, "Item{id}"), ("a.proto", "enum", "Kind", 6, 9, None), ("a.proto", "value", "NONE", 7, 7, "Kind"), ("a.proto", "value", "SOME", 8, 8, "Kind"), ("a.proto", "service", "Shop{id}", 10, 12, None), ("a.proto", "endpoint", "Buy", 11, 11, "Shop{id}")])
def protobuf_blocks(spark, d):
    return parsed(spark, d, "protobuf", "a.proto", 'syntax = "proto3";\nmessage Item{id} {\n  string name = 1;\n  repeated string tags = 2;\n}\nenum Kind {\n  NONE = 0;\n  SOME = 1;\n}\nservice Shop{id} {\n  rpc Buy(Item) returns (Item);\n}')


@example(_BLOCK, [("m.tf", "resource", "aws_s3_bucket.b{id}", 1, 3, None), ("m.tf", "module", "net", 4, 4, None), ("m.tf", "variable", "size{id}", 5, 7, None), ("m.tf", "output", "url", 8, 8, None)])
def terraform_blocks(spark, d):
    return parsed(spark, d, "terraform", "m.tf", 'resource "aws_s3_bucket" "b{id}" {\n  tags = { a = 1 }\n}\nmodule "net" { source = "./net" }\nvariable "size{id}" {\n  default = 1\n}\noutput "url" { value = 1 }')


@example(_BLOCK, [("r.sh", "function", "build{id}", 2, 4, None), ("r.sh", "function", "clean", 5, 7, None), ("r.sh", "source", "./lib{id}.sh", 1, 1, None)])
def shell_functions(spark, d):
    return parsed(spark, d, "shell", "r.sh", "source ./lib{id}.sh\nbuild{id}() {\n  if true; then { echo; }; fi\n}\nfunction clean {\n  rm -r x\n}")


# structure by language


def _structure(language: str):
    def run(spark, d):
        df = tree(spark, d, {f"src/f{{id}}.{language}": SOURCES[language]}).withColumn("language", F.lit(language))
        return structure.structure(df).where("kind != 'parsed'")

    run.__name__ = f"structure_{language}"
    return run


for _language, _rows in FOUND.items():
    example("path kind name start end parent exported params returns", [(f"src/f{{id}}.{_language}", *r) for r in _rows])(_structure(_language))


def sources_tree(spark, d):
    df = tree(spark, d, {f"src/f{{id}}.{x}": t for x, t in SOURCES.items()} | {"src/bad{id}.python": "def (:\n", "src/x{id}.zig": "fn main() {}"})
    return df.withColumn("language", F.regexp_extract("path", r"\.(\w+)$", 1)).withColumn("category", F.lit("code"))


@example("path name line", [(f"src/f{{id}}.{x}", n, i) for x, rows in FOUND.items() for n, i in {r[1]: r[2] for r in reversed(rows) if r[5] and r[0] in ("function", "class", "export")}.items()])
def exports_by_language(spark, d):
    return structure.exports(structure.structure(sources_tree(spark, d)))


@example("path structure calls", [(f"src/f{{id}}.{x}", "succeeded", "succeeded") for x in SOURCES] + [("src/bad{id}.python", "failed", "failed"), ("src/x{id}.zig", "skipped", "skipped"), ("notes{id}.md", "skipped", "skipped")])
def parse_outcomes(spark, d):
    files = sources_tree(spark, d)
    docs = tree(spark, d, {"notes{id}.md": "x"}).select("path", F.lit("docs").alias("category"))
    return structure.outcomes(structure.structure(files, rows=False), files.select("path", "category").unionByName(docs))


@example("path total_lines non_empty_lines function_count class_count export_count call_count import_count", [("src/f{id}.python", 14, 9, 1, 1, 2, 4, 1), ("src/f{id}.go", 23, 18, 2, 2, 2, 3, 2)])
def file_metrics(spark, d):
    df = tree(spark, d, {f"src/f{{id}}.{x}": SOURCES[x] for x in ("python", "go")}).withColumn("language", F.regexp_extract("path", r"\.(\w+)$", 1))
    met = planted(spark, d, "source string, target string", [("src/f{id}.go", "a"), ("src/f{id}.go", "b"), ("src/f{id}.go", "b")])
    return structure.metrics(df, structure.structure(df), met)


# wiki texts, answers of models

WIKI = "---\ntitle: x\n---\n# Page {id}\n\nFirst words of\nthe page.\n\n## See\n[[Other {id}|there]] and [[Other {id}]] and [[Home]]\n```python\nx = 1\n```\n"


@example("path title paragraph headings languages links", [("w/p{id}.md", "Page {id}", "First words of\nthe page.", ["See"], ["python"], ["Other {id}", "Home"])])
def wiki_text(spark, d):
    return parse.wiki_text(tree(spark, d, {"w/p{id}.md": WIKI}))


@example("path category target", [("index{id}.md", "Tools {id}", "Hammer {id}"), ("index{id}.md", "Tools {id}", "Saw"), ("index{id}.md", "People", "Ann")])
def index_categories(spark, d):
    return parse.index_categories(tree(spark, d, {"index{id}.md": "# Index\n[[None]]\n## Tools {id}\n- [[Hammer {id}]] and [[Saw|the saw]]\n## People\n- [[Ann]]"}))


@example("path day operation title", [("log.md", "2024-01-02", "add", "Page {id}"), ("log.md", "2024-02-03", "rename", "a | b")])
def log_entries(spark, d):
    return parse.log_entries(tree(spark, d, {"log.md": "# Log\n## [2024-01-02] add | Page {id}\ntext\n## [2024-02-03] rename | a | b\n## no date"}))


@example("path keys", [("p{id}.md", ["kind=note", "title=Page {id}"])])
def frontmatter_keys(spark, d):
    df = tree(spark, d, {"p{id}.md": "---\ntitle: Page {id}\nkind: note\n---\nbody: none"})
    return df.select("path", F.array_sort(F.transform(F.map_entries(parse.frontmatter(F.col("content"))), lambda e: F.concat_ws("=", e["key"], e["value"]))).alias("keys"))


@example("path summary tags complexity", [("a{id}", "Does {id}", ["x", "y"], "complex"), ("b{id}", "", [], "moderate"), ("c{id}", "bare", [], "moderate")])
def model_answers(spark, d):
    df = tree(spark, d, {"a{id}": 'Here:\n```json\n{"summary": "Does {id}", "tags": ["x", "y"], "complexity": "complex"}\n```\nbye', "b{id}": "no json", "c{id}": 'it is {"summary": "bare", "tags": "none", "complexity": "huge"} so'})
    return df.select("path", parse.file_answer(F.col("content")).alias("a")).select("path", "a.*")


# the domain scan

API = "import { a } from './a{id}';\napp.get('/users/{id}', list);\nexport async function handleJob(x) {\n  queue.on('done', x);\n}\n"


@example("path line type match snippet", [("api/r{id}.ts", 2, "http", "app.get('/users/{id}'", "app.get('/users/{id}', list);\nexport async function handleJob(x) {\n  queue.on('done', x);\n}\n"), ("api/r{id}.ts", 4, "event", ".on('done'", "  queue.on('done', x);\n}\n"), ("api/r{id}.ts", 3, "manual", "export async function handleJob", "export async function handleJob(x) {\n  queue.on('done', x);\n}\n")])
def entry_points(spark, d):
    return domain.entry_points(tree(spark, d, {"api/r{id}.ts": API, "api/r{id}.test.ts": API}), 2**31 - 1)


@example("path exports imports lines preview", [("api/r{id}.ts", ["handleJob"], ["./a{id}"], 5, API.rstrip("\n") + "\n"), ("lib/t{id}.py", ["run"], ["os.path"], 2, "from os.path import join\ndef run(): pass")])
def file_signatures(spark, d):
    df = planted(spark, d, "path string, content string, ord long", [("lib/t{id}.py", "from os.path import join\ndef run(): pass", 0), ("api/r{id}.ts", API, 1)])
    return domain.signatures(df, 2**31 - 1)


@example("path keys text", [("p{id}/package.json", ["name", "scripts"], None), ("p{id}/go.mod", None, "module x{id}")])
def project_metadata(spark, d):
    return domain.metadata(tree(spark, d, {"p{id}/package.json": '{"name": "n", "scripts": {}}', "p{id}/go.mod": "module x{id}", "p{id}/other.txt": "x"}))


@example("path", [("p{id}/src/a.py",), ("p{id}/b.go",)])
def domain_files(spark, d):
    # every document has its own root, so the bounds for a folder hold; that for all files is not met
    return domain.scanned(tree(spark, d, {"p{id}/src/a.py": "", "p{id}/b.go": "", "p{id}/c.txt": "", "p{id}/1/2/3/4/5/6/7/d.py": ""}).where(F.lit(True)))


SQL["domain_files"] = "SELECT path FROM (" + SQL["domain_files"] + f") ORDER BY path LIMIT {domain.FILES}"


NESTED = {
    "d{id}/Depot.java": ("java", "public class Depot{id} {\n  // void ghost() { }\n  public Depot{id}(String a) { open(\"}\"); }\n  int put(int n) { return add(n); }\n  int put(String[] a, Map<String, Integer> m) { return m.get(a); }\n  static class Shelf { void run() { new Depot{id}('{'); } }\n}\n"),
    "d{id}/grid.cpp": ("cpp", "namespace n {\nclass Grid{id} {\n  int w_;\npublic:\n  int size();\n};\n}\nint n::Grid{id}::size() { return std::max(w_, {id}); }\n"),
    "d{id}/s.ts": ("typescript", "export class S{id} {\n  get(k: string): T { return this.m.get(`}${k}`); }\n}\nexport const f{id} = (x: number): string => { return g(x) }\n"),
    "d{id}/e.rs": ("rust", "pub struct E{id}<'a> { n: &'a str }\nimpl<'a> E{id}<'a> {\n    pub fn new(n: &'a str) -> Self { Self::with('{') }\n}\n"),
}


def _nested(spark, d):
    from ..operators import syntax

    files = planted(spark, d, "path string, language string, content string", [(f, lang, text) for f, (lang, text) in NESTED.items()])
    toks = syntax.tokens(files)
    return syntax, toks, syntax.declarations(toks)


@example("path kind name owner line last exported params", [
    ("d{id}/Depot.java", "class", "Depot{id}", None, 1, 7, True, None), ("d{id}/Depot.java", "function", "Depot{id}", "Depot{id}", 3, 3, True, ["a"]), ("d{id}/Depot.java", "function", "put", "Depot{id}", 4, 4, False, ["n"]),
    ("d{id}/Depot.java", "function", "put", "Depot{id}", 5, 5, False, ["a", "m"]), ("d{id}/Depot.java", "class", "Shelf", "Depot{id}", 6, 6, False, None), ("d{id}/Depot.java", "function", "run", "Shelf", 6, 6, False, []),
    ("d{id}/grid.cpp", "class", "Grid{id}", None, 2, 6, True, None), ("d{id}/grid.cpp", "field", "w_", "Grid{id}", 3, 3, True, None), ("d{id}/grid.cpp", "signature", "size", "Grid{id}", 4, 5, True, []), ("d{id}/grid.cpp", "function", "size", "Grid{id}", 8, 8, True, []),
    ("d{id}/s.ts", "class", "S{id}", None, 1, 3, True, None), ("d{id}/s.ts", "function", "get", "S{id}", 2, 2, False, ["k"]), ("d{id}/s.ts", "function", "f{id}", None, 4, 4, True, ["x"]),
    ("d{id}/e.rs", "class", "E{id}", None, 1, 1, True, None), ("d{id}/e.rs", "function", "new", "E{id}", 3, 3, True, ["n"]),
])
def owned_declarations(spark, d):
    """Overloads, nested types, definitions outside their class, braces in strings and comments."""
    return _nested(spark, d)[2].select("path", "kind", "name", "owner", "line", "last", "exported", "params")


@example("path caller callee line", [
    ("d{id}/Depot.java", "Depot{id}", "open", 3), ("d{id}/Depot.java", "put", "add", 4), ("d{id}/Depot.java", "put", "m.get", 5), ("d{id}/Depot.java", "run", "new Depot{id}", 6),
    ("d{id}/grid.cpp", "size", "std::max", 8), ("d{id}/s.ts", "get", "this.m.get", 2), ("d{id}/s.ts", "f{id}", "g", 4), ("d{id}/e.rs", "new", "Self::with", 3),
])
def attributed_calls(spark, d):
    syntax, toks, declared = _nested(spark, d)
    return syntax.calls(toks, declared).select("path", "caller", "callee", "line")


def rooted(spark, d, files: dict[str, str]):
    """``root, path, content`` of a tree for every document."""
    return planted(spark, d, "root string, path string, content string", [("t{id}", f, c) for f, c in files.items()])


@example("root file name description scripts dependencies dev_dependencies text", [
    ("t{id}", "package.json", "n{id}", None, ["b", "a"], ["z", "y"], [], None), ("t{id}", "go.mod", None, None, None, None, None, "m" * 1000),
    ("t{id}", "composer.json", None, None, None, None, None, "{bad"), ("t{id}", "README", None, None, None, None, None, "r" * 2000), ("t{id}", "setup.cfg", None, None, None, None, None, "[x]"),
])
def project_facts(spark, d):
    return domain.project_facts(rooted(spark, d, {"package.json": '{"name": "n{id}", "scripts": {"b": "1", "a": "2"}, "dependencies": {"z": "1", "y": "2"}}', "go.mod": "m" * 1500, "composer.json": "{bad", "README": "r" * 2500, "setup.cfg": "[x]", "Makefile": "all:", "sub/go.mod": "no", "other.txt": "x", "setup.py": "x"}))


@example("root file text", [("t{id}", "package.json", "[" * 500)])
def broken_package(spark, d):
    """A package file that is no JSON object keeps its first 500 characters."""
    return domain.project_facts(rooted(spark, d, {"package.json": "[" * 600})).select("root", "file", "text")


@example("root path place", [("t{id}", "B/x.py", 1), ("t{id}", "src/deep/z.go", 2), ("t{id}", "src/A.ts", 3), ("t{id}", "src/b.ts", 4), ("t{id}", "c.py", 5)])
def walked_trees(spark, d):
    """Folders before files, names in any case, folders that are skipped, three files a folder."""
    files = ["c.py", "src/b.ts", "src/A.ts", "src/deep/z.go", "B/x.py", "node_modules/x.js", "src/dist/y.js", "own/q.py", "1/2/3/4/5/6/7/d.py", "src/n.txt", ".py"]
    return domain.scanned_trees(rooted(spark, d, dict.fromkeys(files, "")), ["own"], 5, 3).select("root", "path", F.col("ord").alias("place"))


@example("root cuts paths preview snippet signatures", [("t{id}", 0, 1, 300, 150, 1), ("u{id}", 1, 200, 300, 150, 1), ("v{id}", 3, 200, 200, 100, 1), ("w{id}", 4, 1, 200, 100, 20)])
def fitted_contexts(spark, d):
    """Each root needs more cuts than the one before; what is left of its parts."""
    rows = [("t{id}", 1, 1, 1), ("u{id}", 300, 1, 1), ("v{id}", 300, 1, 1), ("w{id}", 1, 25, 1)]
    base = planted(spark, d, "root string, files int, sigs int, entries int", rows)
    spread = lambda n: base.select("root", F.explode(F.sequence(F.lit(1), F.col(n))).alias("ord"))
    wide = F.when(F.col("root").startswith("v"), 12).otherwise(10)
    tree = spread("files").withColumn("path", F.repeat(F.lit("p"), F.when(F.col("root").startswith("t"), 10).otherwise(wide)))
    got = domain.fitted_context(tree, spread("entries").withColumn("snippet", F.repeat(F.lit("s"), 150)), spread("sigs").withColumn("preview", F.repeat(F.lit("v"), 300)), 4950)
    longest = lambda df, c, n: df.groupBy("root").agg(F.count(F.lit(1)).alias(n), F.max(F.length(c)).alias(c))
    met = got["cuts"].join(longest(got["tree"], "path", "paths").drop("path"), "root").join(longest(got["signatures"], "preview", "signatures"), "root").join(longest(got["entries"], "snippet", "n").drop("n"), "root")
    return met.select("root", "cuts", "paths", "preview", "snippet", "signatures")


@example("path cuts", [("a{id}", 0), ("b{id}", 1), ("c{id}", 4)])
def output_cuts(spark, d):
    df = planted(spark, d, "path string, sizes array<long>", [("a{id}", [1, 2, 3, 4]), ("b{id}", [600_000, 10, 500_000, 9]), ("c{id}", [0, 0, 0, 0, 600_000])])
    return df.select("path", domain.fitted(F.col("sizes")).alias("cuts"))


# import resolution

_RESOLVED = "source raw target"
_FILES = {f: "" for f in ("p{id}/src/a.ts", "p{id}/src/b.tsx", "p{id}/src/lib/index.ts", "p{id}/src/a.js/index.ts", "p{id}/src/m.mts", "p{id}/src/m.ts")}


def asked(spark, d, rows):
    return planted(spark, d, "source string, raw string", rows)


@example(_RESOLVED, [("p{id}/src/a.ts", "./b", "p{id}/src/b.tsx"), ("p{id}/src/a.ts", "./lib", "p{id}/src/lib/index.ts"), ("p{id}/src/b.tsx", "./a.js", "p{id}/src/a.ts"), ("p{id}/src/a.ts", "./m.mjs", "p{id}/src/m.mts"), ("p{id}/src/lib/index.ts", "../a.ts", "p{id}/src/a.ts")])
def relative_imports(spark, d):
    want = asked(spark, d, [("p{id}/src/a.ts", r) for r in ("./b", "./lib", "./m.mjs", "./none", "./lib.js", "react")] + [("p{id}/src/b.tsx", "./a.js"), ("p{id}/src/lib/index.ts", "../a.ts"), ("p{id}/src/lib/index.ts", "../../../../x")])
    return imports.relative_imports(want, tree(spark, d, _FILES))


@example(_RESOLVED, [("p{id}/src/a.ts", "@/lib", "p{id}/src/lib/index.ts"), ("p{id}/src/a.ts", "@/b.jsx", "p{id}/src/b.tsx"), ("p{id}/src/a.ts", "exact", "p{id}/src/a.ts")])
def alias_imports(spark, d):
    want = asked(spark, d, [("p{id}/src/a.ts", r) for r in ("@/lib", "@/b.jsx", "exact", "exactly", "@/none")])
    rules = planted(spark, d, "config string, ord long, pattern string, substitute string, base_url string", [("p{id}/tsconfig.json", 0, "@/*", "none/*", "."), ("p{id}/tsconfig.json", 1, "@/*", "src/*", "."), ("p{id}/tsconfig.json", 2, "exact", "src/a", "."), ("tsconfig.json", 3, "@/*", "../*", ".")])
    return imports.alias_imports(want, tree(spark, d, _FILES), rules)


@example("source raw", [("c{id}.js", "./x{id}"), ("c{id}.js", "fs")])
def required_literals(spark, d):
    return imports.required_literals(tree(spark, d, {"c{id}.js": "const a = require('./x{id}');\n// require('no')\n/* require('nor') */\nrequire( \"fs\" ); require(name);"}))


@example(_RESOLVED, [("p{id}/app/m.py", "core.util", "p{id}/core/util.py"), ("p{id}/app/m.py", "app.sub", "p{id}/app/sub/__init__.py"), ("p{id}/app/m.py", ".sub", "p{id}/app/sub/__init__.py"), ("p{id}/app/m.py", "..core.util", "p{id}/core/util.py"), ("p{id}/app/m.py", ".n", "p{id}/app/n.py")])
def python_imports(spark, d):
    files = tree(spark, d, {f: "" for f in ("p{id}/app/m.py", "p{id}/app/n.py", "p{id}/core/util.py", "p{id}/app/sub/__init__.py")})
    want = planted(spark, d, "source string, raw string, names array<string>", [("p{id}/app/m.py", "core.util", []), ("p{id}/app/m.py", "app.sub", ["thing"]), ("p{id}/app/m.py", ".sub", []), ("p{id}/app/m.py", "..core.util", []), ("p{id}/app/m.py", ".", ["n"]), ("p{id}/app/m.py", "os", [])])
    return imports.python_imports(want, files)


@example(_RESOLVED, [("p{id}/cmd/main.go", "example.com/m{id}/store", "p{id}/store/a.go"), ("p{id}/cmd/main.go", "example.com/m{id}/store", "p{id}/store/b.go"), ("p{id}/cmd/main.go", "example.com/m{id}", "p{id}/root.go")])
def go_imports(spark, d):
    files = tree(spark, d, {f: "" for f in ("p{id}/cmd/main.go", "p{id}/store/a.go", "p{id}/store/b.go", "p{id}/root.go", "p{id}/store/sub/c.go")})
    modules = planted(spark, d, "config string, module string", [("p{id}/go.mod", "example.com/m{id}")])
    return imports.go_imports(asked(spark, d, [("p{id}/cmd/main.go", r) for r in ("example.com/m{id}/store", "example.com/m{id}", "example.com/m{id}x/store", "fmt")]), files, modules)


def _suffixes(spark, d, ext):
    files = tree(spark, d, {f: "" for f in ("p{id}/src/main/app{id}/Store" + ext, "q{id}/app{id}/Store" + ext, "p{id}/App" + ext)})
    return imports.suffix_imports(asked(spark, d, [("p{id}/App" + ext, "app{id}.Store"), ("p{id}/App" + ext, "app{id}.None")]), files, ext)


def _suffix_rows(ext):
    return [("p{id}/App" + ext, "app{id}.Store", t + ext) for t in ("p{id}/src/main/app{id}/Store", "q{id}/app{id}/Store")]


@example(_RESOLVED, _suffix_rows(".java"))
def java_imports(spark, d):
    return _suffixes(spark, d, ".java")


@example(_RESOLVED, _suffix_rows(".kt"))
def kotlin_imports(spark, d):
    return _suffixes(spark, d, ".kt")


@example(_RESOLVED, _suffix_rows(".cs"))
def csharp_imports(spark, d):
    return _suffixes(spark, d, ".cs")


@example(_RESOLVED, [("p{id}/Main.scala", "app{id}.store.{Shelf, Box => B}", "p{id}/app{id}/store/Shelf.scala"), ("p{id}/Main.scala", "app{id}.store.{Shelf, Box => B}", "p{id}/app{id}/store/Box.scala"), ("p{id}/Main.scala", "app{id}.store._", "p{id}/app{id}/store/Shelf.scala"), ("p{id}/Main.scala", "app{id}.store._", "p{id}/app{id}/store/Box.scala"), ("p{id}/Main.scala", "app{id}.tools.help", "p{id}/app{id}/tools/package.scala")])
def scala_imports(spark, d):
    files = tree(spark, d, {f: "" for f in ("p{id}/Main.scala", "p{id}/app{id}/store/Shelf.scala", "p{id}/app{id}/store/Box.scala", "p{id}/app{id}/tools/package.scala")})
    return imports.scala_imports(asked(spark, d, [("p{id}/Main.scala", r) for r in ("app{id}.store.{Shelf, Box => B}", "app{id}.store._", "app{id}.tools.help")]), files)


SWIFT = 'let package = Package(targets: [\n .target(name: "Core{id}", dependencies: []),\n .executableTarget(name: "Tool", path: "tool"),\n .testTarget(name: "CoreTests"),\n])'


@example(_RESOLVED, [("p{id}/tool/main.swift", "Core{id}", "p{id}/Sources/Core{id}/a.swift"), ("p{id}/tool/main.swift", "Core{id}", "p{id}/Sources/Core{id}/sub/b.swift"), ("p{id}/Sources/Core{id}/a.swift", "Core{id}", "p{id}/Sources/Core{id}/sub/b.swift")])
def swift_imports(spark, d):
    files = tree(spark, d, {f: "" for f in ("p{id}/tool/main.swift", "p{id}/Sources/Core{id}/a.swift", "p{id}/Sources/Core{id}/sub/b.swift", "p{id}/Tests/CoreTests/t.swift")})
    modules = imports.swift_modules(files, tree(spark, d, {"p{id}/Package.swift": SWIFT})).where("module like 'Core%' and module != 'CoreTests'")
    return imports.module_imports(asked(spark, d, [("p{id}/tool/main.swift", "Core{id}"), ("p{id}/tool/main.swift", "Foundation"), ("p{id}/Sources/Core{id}/a.swift", "Core{id}")]), modules)


@example(_RESOLVED, [("p{id}/app/x.rb", "../lib/a", "p{id}/lib/a.rb"), ("p{id}/app/x.rb", "b{id}", "lib/b{id}.rb"), ("p{id}/app/x.rb", "c{id}", "app/c{id}.rb")])
def ruby_imports(spark, d):
    want = planted(spark, d, "source string, raw string, relative boolean", [("p{id}/app/x.rb", "../lib/a", True), ("p{id}/app/x.rb", "b{id}", False), ("p{id}/app/x.rb", "c{id}", False), ("p{id}/app/x.rb", "json", False)])
    return imports.ruby_imports(want, tree(spark, d, {f: "" for f in ("p{id}/lib/a.rb", "lib/b{id}.rb", "app/c{id}.rb", "c{id}.rb")}))


@example(_RESOLVED, [("p{id}/x.php", "App\\Models\\User", "p{id}/models/User.php"), ("p{id}/x.php", "App\\Cart", "p{id}/src2/Cart.php"), ("p{id}/x.php", "Other\\Thing", "p{id}/rest/Other/Thing.php")])
def php_imports(spark, d):
    files = tree(spark, d, {f: "" for f in ("p{id}/models/User.php", "p{id}/src/Models/User.php", "p{id}/src2/Cart.php", "p{id}/src3/Cart.php", "p{id}/rest/Other/Thing.php", "p{id}/srclication/X.php")})
    rules = planted(spark, d, "config string, ord long, prefix string, folder string", [("p{id}/composer.json", 0, "App", "src"), ("p{id}/composer.json", 1, "App\\", "src2"), ("p{id}/composer.json", 2, "App\\", "src3"), ("p{id}/composer.json", 3, "App\\Models\\", "models"), ("p{id}/composer.json", 4, "", "rest")])
    return imports.psr4_imports(asked(spark, d, [("p{id}/x.php", r) for r in ("App\\Models\\User", "App\\Cart", "Other\\Thing", "Application\\X")]), files, rules)


@example(_RESOLVED, [("p{id}/src/main.rs", "crate::store::Shelf", "p{id}/src/store.rs"), ("p{id}/src/main.rs", "mod util", "p{id}/src/util/mod.rs"), ("p{id}/src/util/mod.rs", "super::store", "p{id}/src/store.rs"), ("p{id}/src/util/mod.rs", "self::deep::{A, B}", "p{id}/src/util/deep.rs"), ("p{id}/src/store.rs", "mod inner", "p{id}/src/store/inner.rs")])
def rust_imports(spark, d):
    files = tree(spark, d, {f: "" for f in ("p{id}/src/main.rs", "p{id}/src/store.rs", "p{id}/src/util/mod.rs", "p{id}/src/util/deep.rs", "p{id}/src/store/inner.rs")})
    return imports.rust_imports(asked(spark, d, [("p{id}/src/main.rs", "crate::store::Shelf"), ("p{id}/src/main.rs", "mod util"), ("p{id}/src/main.rs", "std::fs"), ("p{id}/src/util/mod.rs", "super::store"), ("p{id}/src/util/mod.rs", "self::deep::{A, B}"), ("p{id}/src/store.rs", "mod inner")]), files)


@example(_RESOLVED, [("src{id}/a.c", "b.h", "src{id}/b.h"), ("src{id}/a.c", "c{id}.h", "include/c{id}.h"), ("src{id}/a.c", "src{id}/b.h", "src{id}/b.h")])
def include_imports(spark, d):
    return imports.include_imports(asked(spark, d, [("src{id}/a.c", r) for r in ("b.h", "c{id}.h", "src{id}/b.h", "stdio.h")]), tree(spark, d, {f: "" for f in ("src{id}/b.h", "include/c{id}.h", "c{id}.h")}))


@example("path targets", [("a{id}", ["b{id}", "c{id}"]), ("b{id}", []), ("c{id}", ["a{id}"])])
def import_map(spark, d):
    resolved = planted(spark, d, "source string, raw string, target string", [("a{id}", "x", "c{id}"), ("a{id}", "y", "b{id}"), ("a{id}", "z", "b{id}"), ("c{id}", "x", "a{id}")])
    return imports.import_map(tree(spark, d, {"a{id}": "", "b{id}": "", "c{id}": ""}), resolved)


# tests and what they test


@example("path test", [("src/a{id}.test.ts", True), ("src/a{id}.ts", False), ("t/test_x{id}.py", True), ("t/x{id}_test.go", True), ("A{id}Test.java", True), ("A{id}Spec.kt", True), ("B{id}Tests.cs", True), ("c{id}_test.cpp", True), ("testing{id}.py", False)])
def test_paths(spark, d):
    return planted(spark, d, "path string", [(r,) for r in ("src/a{id}.test.ts", "src/a{id}.ts", "t/test_x{id}.py", "t/x{id}_test.go", "A{id}Test.java", "A{id}Spec.kt", "B{id}Tests.cs", "c{id}_test.cpp", "testing{id}.py")]).select("path", imports.is_test_path(F.col("path")).alias("test"))


@example("source target weight", [("file:a{id}.py", "file:test_a{id}.py", 0.9), ("file:b{id}.py", "file:test_b{id}.py", 0.4)])
def canonical_tests(spark, d):
    rows = [("file:a{id}.py", "file:test_a{id}.py", 0.5, 0), ("file:test_a{id}.py", "file:a{id}.py", 0.9, 1), ("file:test_b{id}.py", "file:b{id}.py", 0.4, 2), ("file:a{id}.py", "file:b{id}.py", 0.9, 3)]
    e = planted(spark, d, "source string, target string, weight double, ord long", rows).select("source", "target", F.lit("tested_by").alias("type"), F.lit("forward").alias("direction"), "weight", "ord")
    return imports.canonical_tests(e)


@example("source target weight", [("file:s{id}/a.ts", "file:s{id}/a.test.ts", 0.5), ("file:s{id}/m.py", "file:s{id}/tests/test_m.py", 0.5), ("file:s{id}/x.go", "file:s{id}/x_test.go", 0.5), ("file:s{id}/src/main/K.java", "file:s{id}/src/test/KTest.java", 0.5)])
def supplied_tests(spark, d):
    names = ("s{id}/a.ts", "s{id}/a.test.ts", "s{id}/m.py", "s{id}/tests/test_m.py", "s{id}/x.go", "s{id}/x_test.go", "s{id}/src/main/K.java", "s{id}/src/test/KTest.java", "s{id}/b.ts", "s{id}/b.test.ts")
    files = tree(spark, d, {f: "" for f in names})
    tests = files.where(imports.is_test_path(F.col("path"))).select("path")
    return imports.supplied_tests(tests, files, planted(spark, d, "target string", [("file:s{id}/b.test.ts",)]))


@example("id tags", [("file:a{id}", ["x", "tested"]), ("file:b{id}", ["tested"]), ("file:c{id}", ["y"])])
def tag_tested(spark, d):
    nodes = planted(spark, d, "id string, tags array<string>", [("file:a{id}", ["x"]), ("file:b{id}", ["tested"]), ("file:c{id}", ["y"])])
    e = planted(spark, d, "source string, target string, type string", [("file:a{id}", "t", "tested_by"), ("file:b{id}", "t", "tested_by"), ("file:c{id}", "t", "calls")])
    return imports.tag_tested(nodes, e)


# scans


PATHS = {"src/a{id}.tsx": ("typescript", "code"), "Dockerfile.{id}": ("dockerfile", "infra"), ".env.{id}": ("config", "config"), "x{id}/LICENSE": ("unknown", "code"), "k{id}/k8s/d.yaml": ("yaml", "infra"), "x{id}/go.mod": ("mod", "config"), "x{id}/Makefile": ("makefile", "infra"), "q{id}.sql": ("sql", "data"), "r{id}.sh": ("shell", "script"), "d{id}.md": ("markdown", "docs"), "p{id}.html": ("html", "markup"), "n{id}/none": ("unknown", "code")}


@example("path language category", [(k, *v) for k, v in PATHS.items()])
def file_kinds(spark, d):
    return planted(spark, d, "path string", [(k,) for k in PATHS]).select("path", sources.detect_language(F.col("path")).alias("language"), sources.detect_category(F.col("path")).alias("category"))


@example("path lines size", [("a{id}", 30, "small"), ("b{id}", 31, "moderate"), ("c{id}", 151, "large"), ("d{id}", 501, "very-large")])
def size_classes(spark, d):
    df = planted(spark, d, "path string, lines long", [("a{id}", 30), ("b{id}", 31), ("c{id}", 151), ("d{id}", 501)])
    return df.select("path", "lines", sources.size_class(F.col("lines")).alias("size"))


@example("path kept", [("src/a{id}.ts", True), ("node_modules/x{id}/a.js", False), ("a{id}/dist/b.js", False), ("keep{id}.log", True), ("drop{id}.log", False), ("doc{id}/secret/x", False), ("img{id}.png", False)])
def ignore_filter(spark, d):
    names = ("src/a{id}.ts", "node_modules/x{id}/a.js", "a{id}/dist/b.js", "keep{id}.log", "drop{id}.log", "doc{id}/secret/x", "img{id}.png")
    return planted(spark, d, "path string", [(n,) for n in names]).select("path", (~sources.ignored(F.col("path"), ["secret/", "!keep*.log"])).alias("kept"))


@example("path safe", [("/root/p{id}/a.py", "a.py"), ("/etc/x{id}", "x{id}"), ("rel/y{id}", "rel/y{id}")])
def safe_paths(spark, d):
    df = planted(spark, d, "path string, root string", [("/root/p{id}/a.py", "/root/p{id}"), ("/etc/x{id}", "/root/p{id}"), ("rel/y{id}", "/root/p{id}")])
    # the root differs by row here, so its own part is taken off first
    return df.select("path", sources.safe_path(F.when(F.col("path").startswith(F.concat("root", F.lit("/"))), F.replace("path", F.col("root"), F.lit("/base"))).otherwise(F.col("path")), "/base").alias("safe"))


@example("path framework", [("p{id}/requirements.txt", "django"), ("p{id}/requirements.txt", "flask"), ("p{id}/package.json", "react"), ("p{id}/go.mod", "gin")])
def frameworks(spark, d):
    return sources.frameworks(tree(spark, d, {"p{id}/requirements.txt": "Django==4\nflask>=2", "p{id}/package.json": '{"dependencies": {"react": "1"}}', "p{id}/go.mod": "require github.com/gin-gonic/gin v1", "p{id}/x.txt": "django"}))


@example("path language", [("x{id}/Jenkinsfile", "groovy-pipeline"), ("a{id}.TS", "typescript"), ("b{id}.tar.md", "markdown"), ("c{id}", None)])
def language_registry(spark, d):
    names = {"jenkinsfile": "groovy-pipeline"}
    exts = {"ts": "typescript", "md": "markdown"}
    return planted(spark, d, "path string", [(n,) for n in ("x{id}/Jenkinsfile", "a{id}.TS", "b{id}.tar.md", "c{id}")]).select("path", sources.registered_language(F.col("path"), names, exts).alias("language"))


@example("root line", [("p{id}", "# docs/"), ("p{id}", "# **/*.test.*"), ("p{id}", "# tmp/")])
def starter_ignore(spark, d):
    files = tree(spark, d, {"p{id}/docs/a.md": "", "p{id}/a.ts": "", "p{id}/.gitignore": "node_modules/\n# c\ntmp/\n"})
    return sources.starter_ignore(files.select(F.regexp_extract("path", "^([^/]+)/", 1).alias("root"), F.regexp_extract("path", "^[^/]+/(.*)$", 1).alias("path"), "content"))


@example("root digest", [("p{id}", "{digest}")])
def tree_digest(spark, d):
    files = tree(spark, d, {"p{id}/b.txt": "two", "p{id}/a.txt": "one"})
    return sources.tree_digests(files.select(F.regexp_extract("path", "^([^/]+)/", 1).alias("root"), F.regexp_extract("path", "^[^/]+/(.*)$", 1).alias("path"), "content"))


SQL["tree_digest"] = "SELECT 'p' || doc_id AS root, sha256(sha256('a.txt' || chr(10) || sha256('one')) || sha256('b.txt' || chr(10) || sha256('two'))) AS digest FROM documents WHERE doc_id IS NOT NULL"


# design trees

DESIGN = '{"document": {"id": "0", "type": "DOCUMENT", "children": [{"id": "1", "type": "CANVAS", "name": "Home {id}", "children": [{"id": "2", "type": "FRAME", "name": "Login", "styles": {"fill": "S1"}, "children": [{"id": "3", "type": "GROUP", "children": [{"id": "4", "type": "INSTANCE", "name": "Button", "componentId": "6"}]}]}, {"id": "5", "type": "SECTION", "children": [{"id": "7", "type": "COMPONENT_SET", "name": "Buttons", "children": [{"id": "6", "type": "COMPONENT", "name": "Primary"}]}]}]}]}}'


@example("doc id kind node owner variant", [("d{id}", "0", "DOCUMENT", None, None, False), ("d{id}", "1", "CANVAS", "page", None, False), ("d{id}", "2", "FRAME", "screen", "1", False), ("d{id}", "3", "GROUP", None, "2", False), ("d{id}", "4", "INSTANCE", "instance", "2", False), ("d{id}", "5", "SECTION", None, "1", False), ("d{id}", "7", "COMPONENT_SET", "componentSet", "1", False), ("d{id}", "6", "COMPONENT", "component", "7", True)])
def design_tree(spark, d):
    return design.flatten(planted(spark, d, "doc string, json string", [("d{id}", DESIGN)]))


@example("n type", [(1, "{all}")])
def design_edges(spark, d):
    flat = design.flatten(planted(spark, d, "doc string, json string", [("d{id}", DESIGN.replace('"id": "', '"id": "{id}-').replace('"componentId": "', '"componentId": "{id}-'))]))
    e = design.design_graph(flat)[1]
    return e.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


SQL["design_edges"] = "SELECT type, n * (SELECT count(*) FROM documents WHERE doc_id IS NOT NULL) AS n FROM (VALUES ('contains', 3), ('variant_of', 1), ('instance_of', 1), ('uses_token', 1)) v(type, n)"

__all__ = ["QUERIES", "SQL", "expected"]
