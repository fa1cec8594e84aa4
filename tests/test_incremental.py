"""A graph kept batch by batch: cuts of the feed do not matter, and batches may be run again."""

import datetime
import json
import random

import pytest

from loomgraph.operators.merge import WAITING
from loomgraph.streaming import incremental

T0 = datetime.datetime(2024, 1, 1)


def feed(seed):
    rng = random.Random(seed)
    out = []
    for k in range(24):
        path, v = f"p{rng.randrange(6)}", rng.randrange(3)
        nodes = [(f"n{path[1]}.{j}", "file", "x") for j in range(v + 1)] + [("shared", "file", "s")] * (v == 1)
        edges = [(f"n{path[1]}.0", f"n{rng.randrange(7)}.{rng.randrange(3)}", rng.choice([sorted(WAITING)[0], "imports"]), 0.5), (f"n{path[1]}.0", "shared", "imports", 0.25)]
        r = random.Random(f"{path}{v}")  # a version of a path is always the same
        edges = [(f"n{path[1]}.0", f"n{r.randrange(7)}.{r.randrange(3)}", r.choice([sorted(WAITING)[0], "imports"]), 0.5) for _ in range(3)] + edges[1:]
        out.append((path, T0 + datetime.timedelta(seconds=k), "delete" if rng.random() < 0.2 else "put", f"h{v}", f"s{v // 2}-{v}", nodes, edges))
    return [*out, (None, T0, "put", "h", "s", [], [])]


def told(state, upto):
    nodes, edges, waiting = state.graph(upto)
    return {r.id for r in nodes.collect()}, {tuple(r) for r in edges.collect()}, {tuple(r) for r in waiting.collect()}


def plain(rows):
    last = {}
    for r in rows:
        if r[0] is not None:
            last[r[0]] = r
    kept = [r for r in last.values() if r[2] == "put"]
    ids = {n[0] for r in kept for n in r[5]}
    edges = {e for r in kept for e in r[6]}
    live = {e for e in edges if e[0] in ids and e[1] in ids}
    return ids, live, {e for e in edges - live if e[2] in WAITING}


@pytest.mark.parametrize("seed", [1])
def test_batches_do_not_matter(spark, tmp_path, seed):
    rows = feed(seed)
    df = lambda some: spark.createDataFrame(some, incremental.FRAGMENT)
    whole = incremental.GraphState(spark, str(tmp_path / "whole"))
    whole.apply(df(rows), 0)
    assert told(whole, 0) == plain(rows)
    parts = incremental.GraphState(spark, str(tmp_path / "parts"))
    for k in range(3):
        some = rows[k * 8 : k * 8 + 8]
        parts.apply(df(some), k)
        if k == 1:
            before = told(parts, 1)
            parts.apply(df(some), k)  # run again, as after a failure
            assert told(parts, 1) == before == plain(rows[:16])
    assert told(parts, 2) == plain(rows)
    assert {(r.path, r.content_hash) for r in parts.files.state(2).collect()} == {(r.path, r.content_hash) for r in whole.files.state(0).collect()}


def test_snapshots(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "COMPACT", 2)
    rows = feed(3)
    state = incremental.GraphState(spark, str(tmp_path))
    for k in range(5):
        state.apply(spark.createDataFrame(rows[k * 5 : k * 5 + 5], incremental.FRAGMENT), k)
    assert told(state, 4) == plain(rows[:25])


def test_stream_of_source_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    source = "class A { int f(int a) { return 1; } }"
    steps = [[("a.java", source, "put", 1)], [("a.java", source + " // remark", "put", 2), ("b.java", "class B { }", "put", 2)], [("a.java", "class A { int f(long a, int b) { return 1; } }", "put", 3), ("b.java", None, "delete", 3)]]
    for k, step in enumerate(steps):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps({"path": p, "language": "java", "content": c, "op": o, "ts": f"2024-01-01T00:00:0{t}Z"}) for p, c, o, t in step))
    levels = []
    for k, step in enumerate(steps):
        files = spark.createDataFrame([(p, "java", c, o, T0 + datetime.timedelta(seconds=t)) for p, c, o, t in step], "path string, language string, content string, op string, ts timestamp")
        incremental.GraphState(spark, str(tmp_path / "by_hand")).apply(incremental.fragments(files), k)
        levels.append({r.path: r.level for r in incremental.GraphState(spark, str(tmp_path / "by_hand")).files.changes(k).collect()})
    assert levels == [{"a.java": "new"}, {"a.java": "cosmetic", "b.java": "new"}, {"a.java": "structural", "b.java": "deleted"}]
    (tmp_path / "fragments").mkdir()
    stream = spark.readStream.schema(incremental.FRAGMENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "fragments"))
    for k, step in enumerate(steps):
        files = spark.createDataFrame([(p, "java", c, o, T0 + datetime.timedelta(seconds=t)) for p, c, o, t in step], "path string, language string, content string, op string, ts timestamp")
        incremental.fragments(files).coalesce(1).write.mode("append").parquet(str(tmp_path / "fragments"))
        incremental.follow(stream, str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination(120)
    got = incremental.GraphState(spark, str(tmp_path / "state"))
    nodes, edges, waiting = told(got, 2)
    assert nodes == {"file:a.java", "class:a.java:A", "function:a.java:A.f"} and len(edges) == 2 and not waiting
