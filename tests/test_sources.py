import json

import pytest
from pyspark.sql import functions as F

from loomgraph.sources import files, graphs
from loomgraph.sources.ignore import ignored
from loomgraph.streaming import refresh


@pytest.mark.parametrize(
    ("path", "language", "category"),
    [("a/b.ts", "typescript", "code"), ("Dockerfile.dev", "dockerfile", "infra"), (".env.local", "config", "config"), ("x/Makefile", "makefile", "infra"), ("README.md", "markdown", "docs"), ("k8s/a.yaml", "yaml", "infra"), ("LICENSE", "unknown", "code"), ("q.zig", "zig", "code"), ("s.sql", "sql", "data"), ("r.SH", "shell", "script")],
)
def test_kinds(spark, path, language, category):
    r = spark.createDataFrame([(path,)], "path string").select(files.detect_language(F.col("path")).alias("a"), files.detect_category(F.col("path")).alias("b")).first()
    assert (r.a, r.b) == (language, category)


def test_ignore_rules(spark):
    cases = {"node_modules/x.js": True, "src/node_modules/y/x.js": True, "a.png": True, "src/keep.log": False, "b.log": True, "docs/x/deep/t.md": True, "docs/t.md": True, "gen/a.ts": True, "src/gen/a.ts": False, "LICENSE": True}
    df = spark.createDataFrame([(p,) for p in cases], "path string").select("path", ignored(F.col("path"), ["docs/**/t.md", "/gen/", "!src/keep.log"]).alias("i"))
    assert {r.path: r.i for r in df.collect()} == cases


def test_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1\ny = 2\n")
    (tmp_path / "yarn.lock").write_text("")
    tree = files.read_tree(spark, str(tmp_path))
    assert [tuple(r) for r in files.inventory(tree).collect()] == [("src/a.py", "python", "code", 2)]
    assert files.content_digest(tree) == files.content_digest(tree)
    assert files.scan_stats(files.inventory(tree)).count() == 3


def test_graph_files(spark, tmp_path):
    (tmp_path / "batch-2.json").write_text(json.dumps({"nodes": [{"id": "b", "type": "file", "name": "B"}, {"type": "file"}], "edges": [{"source": "a", "target": "b", "type": "imports", "weight": "0.3"}]}))
    (tmp_path / "batch-existing.json").write_text(json.dumps({"nodes": [{"id": "a", "type": "file", "name": "A", "tags": ["t"]}], "edges": []}))
    nodes, edges, issues = graphs.read_graphs(spark, str(tmp_path))
    assert [r.id for r in nodes.orderBy("ord").collect()] == ["a", "b"]
    assert edges.count() == 1 and issues.count() == 1
    assert graphs.batch_gaps(spark, ["batch-1.json", "batch-4.json", "batch-2-part-1.json"]) == [3]
    graphs.write_json(nodes, edges, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/nodes")).count() == 2


def test_synthetic_is_seeded(spark):
    a, b = (graphs.synthetic(spark, 50, seed=3, messy=True) for _ in range(2))
    assert a[0].exceptAll(b[0]).isEmpty() and a[1].exceptAll(b[1]).isEmpty()
    assert a[1].count() == 85


def test_refresh(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(refresh, "COMPACT", 2)
    feed, table = tmp_path / "feed", str(tmp_path / "table")
    feed.mkdir()

    def put(name, rows):
        (feed / name).write_text("\n".join(json.dumps(dict(zip(("path", "content", "op", "ts"), r, strict=True))) for r in rows))
        refresh.refresh(refresh.read_feed(spark, str(feed)), table, str(tmp_path / "check")).awaitTermination()

    put("1.json", [("a", "x", "put", "2024-01-01T00:00:00"), ("b", "y", "put", "2024-01-01T00:00:00"), ("a", "z", "put", "2024-01-02T00:00:00")])
    assert refresh.current(spark, table).count() == 2
    put("2.json", [("a", "z", "put", "2024-01-03T00:00:00"), ("b", "", "delete", "2024-01-03T00:00:00"), ("c", "q", "put", "2024-01-03T00:00:00")])
    assert {r.path: r.since for r in refresh.current(spark, table).collect()} == {"a": 0, "c": 1}
    assert (tmp_path / "table/snapshots/1").exists()
    put("3.json", [("b", "y", "put", "2024-01-04T00:00:00"), ("c", "q", "put", "2024-01-04T00:00:00")])
    assert {r.path: r.since for r in refresh.current(spark, table).collect()} == {"a": 0, "b": 2, "c": 1}
    assert spark.read.parquet(f"{table}/changes/2").count() == 1


def test_event_windows(spark):
    df = spark.createDataFrame([("2024-01-01 00:10:00", "view", 1, 2.0), ("2024-01-01 00:20:00", "view", 1, 3.0), ("2024-01-01 02:00:00", "view", 1, 1.0)], "ts string, event_type string, user_id long, value double")
    assert sorted((r.n, r.total) for r in refresh.event_windows(df).collect()) == [(1, 1.0), (2, 5.0)]
    assert sorted(r.n for r in refresh.user_sessions(df).collect()) == [1, 2]
