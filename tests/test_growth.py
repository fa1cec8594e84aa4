"""Plans of steps whose memory, disk or time once grew faster than their input."""

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import analytics, graph, repair, structure, syntax, views
from loomgraph.plans import queries


@pytest.fixture
def large(spark):
    """Edges and nodes that are too large to be sent to every task."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    n = spark.range(3000)
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    yield n.select(name(F.col("id")).alias("source"), name(F.col("id") % 50).alias("target"), F.lit("calls").alias("type"), F.lit(0.5).alias("weight")), n.select(name(F.col("id")).alias("id"), F.lit("file").alias("type"), F.lit("x").alias("name"))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_stream_past_nodes(large):
    edges, nodes = large
    members = nodes.select(F.lit("l").alias("layer_id"), F.lit(0).alias("layer_ord"), F.col("id").alias("node_id"))
    met = [graph.induced(edges, nodes), repair.dangling(edges, nodes), analytics.type_matrix(nodes, edges), views.layer_detail(nodes, edges, members, "l")[1], graph.layer_edges(edges, members)]
    for df in met:
        assert "ShuffledHashJoin" in plan(df) and "SortMergeJoin" not in plan(df)
    assert met[0].count() == 3000 and met[1].where("reason is not null").count() == 0


def test_review_meets_once(large):
    edges, nodes = large
    members = nodes.where("id < 'n2'").select(F.lit("l").alias("layer_id"), F.col("id").alias("node_id"))
    tour = nodes.where("id in ('n1', 'n7')").select(F.lit(1).alias("step"), "id").unionByName(nodes.limit(1).select(F.lit(2).alias("step"), F.lit("zz").alias("id")))
    odd = edges.limit(2).select(F.lit(None).cast("string").alias("source"), F.lit("nowhere").alias("target"), "type", "weight")
    twice = nodes.unionByName(nodes.where("id = 'n5'")).unionByName(nodes.limit(1).select(F.lit(None).cast("string").alias("id"), "type", "name"))
    found = views.review(twice, edges.unionByName(odd), members, tour)
    assert "Join" not in plan(found)
    got = {r.check: r.n for r in found.collect()}
    outside = nodes.where("id >= 'n2'").count() + 2  # n5 again, and the null
    assert got == {"missing field": 1, "dangling source": 2, "dangling target": 2, "duplicate id": 1, "file in no layer": outside, "unknown tour member": 1, "orphan": 1, "self edge": 50, "id without its type": 3001}


def test_fans_tell_pairs_apart_by_parts(spark, large, monkeypatch):
    edges, _ = large
    monkeypatch.setattr("loomgraph.plans.loops.PART", 100)
    df = analytics.fan(edges, True)
    assert "REPARTITION_BY_NUM" in plan(df) and ", 30)" in plan(df)
    assert [(r.id, r.fan) for r in df.limit(2).collect()] == [("n0", 59), ("n1", 59)]


def test_trade_is_told_apart_by_keys(spark, monkeypatch):
    monkeypatch.setattr("loomgraph.plans.loops.PART", 1000)
    text = plan(queries.trade(spark, "/root/testdata/sf0.001"))
    assert "REPARTITION_BY_NUM" in text and "HashAggregate(keys=[o_custkey" in text


def test_neighbours_join_what_is_known_of_nodes_once(large):
    edges, nodes = large
    batches = nodes.select("id", F.substring("id", 2, 1).alias("batch"))
    df = analytics.batch_neighbours(edges, batches, 2)
    assert plan(df).count("ShuffledHashJoin") == 2
    got = sorted((r.id, r.neighbour) for r in df.where("id = 'n55' or id = 'n1'").collect())
    assert got == [("n1", "n2001"), ("n1", "n201")], got


def test_files_are_dealt_once_for_their_tokens(spark, monkeypatch):
    monkeypatch.setattr(syntax, "TEXT", 1000, raising=False)
    text = "class A {\n  int f(int x) { if (x) { g(x); } return h(x); }\n}\n"
    files = spark.range(40).select(F.concat(F.lit("f"), "id").alias("path"), F.lit("java").alias("language"), F.lit(text).alias("content"))
    toks = syntax.tokens(files)
    declared = syntax.declarations(toks)
    assert plan(declared).count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan(declared) and "Join" not in plan(declared)
    assert {(r.kind, r.name, r.owner, r.line, r.last) for r in declared.where("path = 'f7'").collect()} == {("class", "A", None, 1, 3), ("function", "f", "A", 2, 2)}
    assert declared.count() == 80 and syntax.calls(toks, declared).count() == 80


def test_a_worker_holds_few_files(spark, monkeypatch):
    """All rows of a batch of 10,000 files once stood in a worker's memory, and then in one batch."""
    files = spark.range(2000).coalesce(1).select(F.concat(F.lit("f"), "id").alias("path"), F.lit("python").alias("language"), F.lit("def f(): pass\ndef g(): pass\n").alias("content"))
    found = structure.structure(files)
    sizes = [r.n for r in found.mapInArrow(lambda batches: (__import__("pyarrow").RecordBatch.from_pydict({"n": [len(b)]}) for b in batches), "n long").collect()]
    assert sum(sizes) == 6000 and found.where("kind = 'function'").count() == 4000
    assert structure.HELD <= 256


def test_outcomes_keep_no_other_rows(spark):
    files = spark.createDataFrame([("a", "python", "def f(): pass"), ("b", "python", "def ("), ("c", "none", "x")], "path string, language string, content string")
    assert sorted((r.path, r.kind) for r in structure.structure(files, rows=False).collect()) == [("a", "parsed"), ("b", "failed"), ("c", "skipped")]
