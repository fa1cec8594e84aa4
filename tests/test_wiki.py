"""Wikis: links, backlinks, topics, sources, places of entities and claims."""

import random
import time

from loomgraph.operators import wiki

FILES = {
    "wiki/Index.md": "# All\n## Core Ideas\n- [[alpha]] and [[wiki/deep/Beta|the beta]]\n- [[missing]]\n## Tools\n* [[tools/gamma]] [[alpha]]\n",
    "wiki/alpha.md": "---\ntags: x, y\n---\n# Alpha page\nSee [[beta]], [[Beta]], [[-flag]], [[nowhere]] and [[dup]]. [[alpha]] [[index]]\n",
    "wiki/deep/Beta.md": "text without a title [[wiki/tools/gamma]] [[a/dup]]",
    "wiki/tools/gamma.md": "# Gamma\n" + " ".join(f"[[alpha|{i}]]" for i in range(6)),
    "wiki/a/dup.md": "# One\nAbout the Quantum Loom of old.", "wiki/b/dup.md": "# Two", "wiki/deep/index.md": "# Inner index",
    "wiki/log.md": "## [2024-01-01] add | x", "raw/paper.one.pdf": "x", "raw/sub/Notes": "y", "raw/.hidden": "z", "other/file.md": "# no",
}


def scan(spark):
    return wiki.wiki_scan(spark.createDataFrame([(p, c, len(c)) for p, c in FILES.items()], "path string, content string, size long"))


def test_scan(spark):
    got = scan(spark)
    nodes = {r.id: r for r in got["nodes"].collect()}
    assert sorted(nodes) == sorted(["article:alpha", "article:deep/Beta", "article:tools/gamma", "article:a/dup", "article:b/dup", "article:deep/index", "topic:core-ideas", "topic:tools", "source:paper.one", "source:sub/Notes"])
    assert nodes["article:alpha"].name == "Alpha page" and nodes["article:deep/Beta"].name == "Beta"
    assert list(nodes["article:alpha"].tags) == ["tools", "x", "y"] and list(nodes["article:deep/Beta"].tags) == ["core ideas", "deep"]
    assert [nodes[f"article:{x}"].complexity for x in ("alpha", "tools/gamma", "b/dup")] == ["moderate", "moderate", "simple"]
    assert list(nodes["article:alpha"].backlinks) == ["article:tools/gamma"] * 6 and list(nodes["article:deep/Beta"].backlinks) == ["article:alpha"] * 2
    assert list(nodes["source:paper.one"].tags) == ["raw", "pdf"] and list(nodes["source:sub/Notes"].tags) == ["raw", "unknown"]
    edges = {(r.source[8:], r.target.split(":")[1], r.type) for r in got["edges"].collect()}
    assert edges == {("alpha", "deep/Beta", "related"), ("alpha", "a/dup", "related"), ("alpha", "deep/index", "related"), ("deep/Beta", "tools/gamma", "related"), ("deep/Beta", "a/dup", "related"), ("tools/gamma", "alpha", "related"),
                     ("alpha", "core-ideas", "categorized_under"), ("deep/Beta", "core-ideas", "categorized_under"), ("tools/gamma", "tools", "categorized_under"), ("alpha", "tools", "categorized_under")}
    assert sorted((r.path, r.target) for r in got["unresolved"].collect()) == [("alpha.md", "-flag"), ("alpha.md", "nowhere")]


def test_patterns_in_texts(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abé") for _ in range(n))
    patterns = sorted({word(rng.randrange(1, 7)) for _ in range(60)})
    texts = [word(rng.randrange(0, 30)) for _ in range(60)]
    got = wiki.containing(spark.createDataFrame([(p, p) for p in patterns], "pattern_id string, pattern string"), spark.createDataFrame(list(enumerate(texts)), "text_id int, text string"))
    rows = [(r.pattern_id, r.text_id) for r in got.collect()]
    assert sorted(rows) == sorted((p, k) for p in patterns for k, t in enumerate(texts) if p in t)


def test_patterns_in_long_texts(spark):
    """Runs are cut in time that grows with a text's length, not with its square; characters of two halves are whole."""
    patterns = ["needle in hay", "a🧵b", "🧵", "xyxyxyxyxz", "no such needle"]
    texts = ["xy" * 400_000 + "needle in hay", "xy" * 300_000 + "xz", "a🧵b", None, ""]
    began = time.monotonic()
    got = wiki.containing(spark.createDataFrame([(p, p) for p in patterns], "pattern_id string, pattern string"), spark.createDataFrame(list(enumerate(texts)), "text_id int, text string"))
    assert sorted((r.pattern_id, r.text_id) for r in got.collect()) == sorted((p, k) for p in patterns for k, t in enumerate(texts) if t and p in t)
    assert time.monotonic() - began < 60


def test_layers(spark):
    nodes = [("article:alpha", "article", "Alpha page", "x"), ("article:c/concept-loom", "article", "Looms", "about"), ("article:z", "article", "Zed", "holds QUANTUM dust"), ("topic:core", "topic", "Core", None), ("topic:tools", "topic", "Tools", None),
             ("entity:tied", "entity", "T", None), ("claim:concept-loom:x", "claim", "C", None), ("entity:loom", "entity", "L", None), ("entity:my-alpha-2", "entity", "M", None), ("entity:qq1", "entity", "quantum", None), ("entity:qq2", "entity", "ZE", None), ("entity:qq3", "entity", "??", None), ("source:s", "source", "s", None)]
    edges = [("article:alpha", "topic:core", "categorized_under"), ("article:c/concept-loom", "topic:core", "categorized_under"), ("article:c/concept-loom", "topic:tools", "categorized_under"), ("entity:tied", "article:z", "mentions"), ("article:alpha", "entity:tied", "mentions"), ("article:z", "topic:tools", "categorized_under")]
    n = spark.createDataFrame([(*x, k) for k, x in enumerate(nodes)], "id string, type string, name string, content string, ord long")
    e = spark.createDataFrame([(*x, k) for k, x in enumerate(edges)], "source string, target string, type string, ord long")
    assert {r.id: r.article for r in wiki.placed_children(n, e).collect()} == {"entity:tied": "article:z", "claim:concept-loom:x": "article:c/concept-loom", "entity:loom": "article:c/concept-loom", "entity:my-alpha-2": "article:alpha", "entity:qq1": "article:z", "entity:qq2": "article:z"}
    got = {}
    for r in wiki.wiki_layers(n, e).collect():
        got.setdefault(r.layer_id, set()).add(r.node_id)
    assert got == {"layer:core": {"topic:core", "article:alpha", "article:c/concept-loom", "entity:my-alpha-2"}, "layer:tools": {"topic:tools", "article:c/concept-loom", "article:z", "claim:concept-loom:x", "entity:loom", "entity:tied", "entity:qq1", "entity:qq2"}, "layer:other": {"entity:qq3", "source:s"}}


def plain_answers(base, nodes, edges):
    """One answer after the other."""
    found, names, remap, out = dict(base), {}, {}, {}
    for batch in sorted({x[0] for x in nodes} | {x[0] for x in edges}):
        for _, _, i, kind, name in sorted((x for x in nodes if x[0] == batch), key=lambda x: x[1]):
            kind = {"person": "entity", "note": "article", "thesis": "claim"}.get(kind.lower().strip(), kind.lower().strip())
            if kind not in ("entity", "article", "claim"):
                continue
            key = " ".join(name.lower().split())
            if kind == "entity" and key in names:
                remap[i] = names[key]
                continue
            if kind == "entity":
                names[key] = i
            found[i] = (kind, name)
        for _, _, a, b, kind, w in sorted((x for x in edges if x[0] == batch), key=lambda x: x[1]):
            a, b = remap.get(a, a), remap.get(b, b)
            if a in found and b in found:
                out.setdefault((a, b, {"refines": "builds_on", "cites": "cites"}.get(kind, "related")), w if w is not None else 0.5)
    return found, out


def test_answers_are_merged_in_order(spark):
    rng = random.Random(7)
    for _ in range(3):
        base = {f"a{k}": ("article", f"A{k}") for k in range(3)}
        nodes = [(k % 3, k // 3, f"e{rng.randrange(9)}", rng.choice(["entity", "Person ", "note", "thesis", "thing"]), rng.choice(["Ada", " ada", "ADA  L", "ada l", "Bo"])) for k in range(24)]
        ids = [f"e{k}" for k in range(9)] + ["a0", "a1", "none"]
        edges = [(k % 3, k // 3, rng.choice(ids), rng.choice(ids), rng.choice(["refines", "cites", "odd"]), rng.choice([None, 0.25])) for k in range(36)]
        got = wiki.merged_answers(
            spark.createDataFrame([(i, *x) for i, x in base.items()], "id string, type string, name string"), spark.createDataFrame([], "source string, target string, type string, weight double"),
            spark.createDataFrame(nodes, "batch int, ord long, id string, type string, name string"), spark.createDataFrame(edges, "batch int, ord long, source string, target string, type string, weight double"),
        )
        want_nodes, want_edges = plain_answers(base, nodes, edges)
        assert {r.id: (r.type, r.name) for r in got["nodes"].collect()} == want_nodes
        assert {(r.source, r.target, r.type): r.weight for r in got["edges"].collect()} == want_edges
        assert {r.what: r.n for r in got["report"].collect()}["unknown kinds of nodes"] == sum(x[3] == "thing" for x in nodes)
