"""Operators on the tables' own texts, pages and rows, each with SQL that computes the same from them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import domain, graph, parse, repair, traverse, views, wiki
from ..sources import documents, graphs
from ..sources import files as sources
from . import projection as p
from .loops import checkpoint_dir, dealt
from .queries import query


def _docs(spark, d):
    return p.table(spark, d, "documents").where("doc_id is not null")


def _file(content):
    return F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), content.alias("content")


@query("""WITH f AS (SELECT 'd/' || doc_id AS path, coalesce(lang, 'none') AS lang, len(text) - len(replace(text, chr(10), '')) AS feeds FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(chr(10) || text, '\\n[ \\t]*(#|```|~~~)'))
SELECT path, 1 AS start, 'Text' AS name, 1 AS level, CAST(feeds + 2 AS INTEGER) AS "end" FROM f UNION ALL SELECT path, CAST(feeds + 3 AS INTEGER), lang, 2, CAST(feeds + 4 AS INTEGER) FROM f""", False)
def text_sections(spark, d):
    """Whole texts between two headings: where sections begin and end follows from the texts' lines."""
    docs = _docs(spark, d).where(~F.concat(F.lit("\n"), "text").rlike("\n[ \t]*(#|```|~~~)"))
    files = docs.select(*_file(F.concat(F.lit("# Text\n"), "text", F.lit("\n## "), F.coalesce("lang", F.lit("none")), F.lit(" ##\nend"))))
    return parse.markdown_sections(files).select("path", "start", "name", "level", "end")


@query("SELECT 'd/' || doc_id AS path, x AS target, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS x FROM documents) GROUP BY ALL", False)
def text_wikilinks(spark, d):
    """Capitalised words of whole texts as links of a page."""
    marked = F.regexp_replace("text", "([A-Z][a-z]+)", "[[$1|see $1]]")
    return parse.wikilinks(_docs(spark, d).where("text is not null and text not like '%[[%'").select(*_file(marked))).groupBy("path", "target").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT b.x AS pattern, p.page_id FROM (SELECT DISTINCT substr(text, 1, 9) AS x FROM benchmark WHERE text <> '') b JOIN pages p ON contains(p.html, b.x)", False)
def page_mentions(spark, d):
    """Pages that hold the beginning of a benchmark item, by a join on its rarest part."""
    head = F.substring("text", 1, 9)
    asked = p.table(spark, d, "benchmark").where("text <> ''").select(head.alias("pattern_id"), head.alias("pattern")).distinct()
    return wiki.containing(asked, p.table(spark, d, "pages").select(F.col("page_id").alias("text_id"), F.col("html").alias("text")).where("text is not null")).select(F.col("pattern_id").alias("pattern"), F.col("text_id").alias("page_id"))


@query(" SELECT id, CASE WHEN file_path LIKE 'parts/%' THEN 'parts' ELSE split_part(file_path, '/', 1) END AS container, 'folder' AS strategy FROM nodes WHERE type IN ('service', 'class') OR id LIKE 'file:%'")
def table_containers(spark, d):
    return views.derived_containers(p.nodes(spark, d, "nation", "customer", "supplier", "part"), p.edges(spark, d, "serves"))


@query("""WITH f AS (SELECT doc_id, coalesce(source, 'none') || '/' || coalesce(lang, 'none') AS folder, doc_id || '.py' AS name FROM documents WHERE doc_id IS NOT NULL AND doc_id % 3 <> 1), r AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY name) AS k FROM f)
SELECT folder || '/' || name AS path, row_number() OVER (ORDER BY lower(folder), folder, name) AS place FROM r WHERE k <= 50 ORDER BY place LIMIT 5000""", False)
def walked_documents(spark, d):
    """Documents as a tree's files: the first of each folder, in the order of a walk; what is no source file is passed over."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 1, ".txt").otherwise(".py")))
    return domain.scanned_trees(_docs(spark, d).select(F.lit("t").alias("root"), path.alias("path"))).select("path", F.col("ord").cast("long").alias("place"))


@query("SELECT CASE WHEN doc_id % 5 = 0 THEN 'edges' ELSE 'nodes' END AS part, doc_id, md5(coalesce(text, '')) AS hash, count(*) AS n FROM documents WHERE doc_id IS NOT NULL GROUP BY ALL", False)
def document_round_trip(spark, d):
    """Whole texts as elements of graph documents, written by parts and read again by blocks that cut anywhere."""
    body = F.to_json(F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.array(F.lit("{[\"")).alias("tags")))
    rows = _docs(spark, d).select(F.when(F.col("doc_id") % 5 == 0, "edges").otherwise("nodes").alias("part"), F.col("doc_id").alias("ord"), body.alias("raw"))
    folder = f"{checkpoint_dir(spark)}/documents-{uuid.uuid4().hex}"
    documents.write_document(rows, folder)
    found = documents.read_document(spark, folder, block=1 << 18).select("part", F.from_json("raw", "doc_id long, text string").alias("r"))
    return found.groupBy("part", "r.doc_id", F.md5(F.col("r.text").cast("binary")).alias("hash")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, doc_id - (SELECT min(doc_id) FROM documents) AS depth FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)", False)
def document_chain(spark, d):
    """One chain of all documents, as long as the table."""
    ids = _docs(spark, d).select("doc_id").distinct()
    name = lambda c: F.concat(F.lit("d"), c.cast("string"))
    start = ids.agg(name(F.min("doc_id")).alias("id"))
    found = traverse.bfs_depth(ids.select(name(F.col("doc_id")).alias("source"), name(F.col("doc_id") + 1).alias("target")), start)
    return found.select(F.substring("id", 2, 20).cast("long").alias("doc_id"), F.col("depth").cast("long").alias("depth")).join(dealt(ids), "doc_id", "left_semi")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id // 2 ELSE -1 END AS level FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)", False)
def chain_levels(spark, d):
    """Two long strands of documents: the even ones in a chain, the odd ones in a ring."""
    ids = _docs(spark, d).select("doc_id").distinct()
    name = lambda c: F.concat(F.lit("d"), c.cast("string"))
    least, most = ids.where("doc_id % 2 = 1").agg(F.min("doc_id"), F.max("doc_id")).first()
    following = F.when((F.col("doc_id") == most), least).otherwise(F.col("doc_id") + 2)
    found = traverse.longest_depths(ids.select(name(F.col("doc_id")).alias("id")), ids.select(name(F.col("doc_id")).alias("source"), name(following).alias("target")))
    return found.select(F.substring("id", 2, 20).cast("long").alias("doc_id"), "level")


@query(", ends AS (SELECT source AS id FROM edges WHERE type = 'related' UNION ALL SELECT target FROM edges WHERE type = 'related') SELECT id, count(*) AS degree, round(least(greatest(0.85 + 0.03 * count(*), 0.85), 1.5), 4)::DOUBLE AS scale FROM ends GROUP BY id")
def node_scales(spark, d):
    return graph.node_scale(p.edges(spark, d, "links"))


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'depends_on' WHEN 1 THEN 'imports' WHEN 2 THEN 'depends_on' ELSE 'calls' END AS type, CASE l_linenumber % 3 WHEN 0 THEN 'forward' WHEN 1 THEN 'bidirectional' ELSE 'forward' END AS direction,
CASE WHEN l_quantity < 5 THEN 0.5 ELSE least(l_discount * 15, 1.0) END::DOUBLE AS weight FROM lineitem""", False)
def edge_defaults(spark, d):
    """Edges without types, directions and weights, or with unknown ones."""
    n = F.col("l_linenumber")
    rows = p.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.lit("a").alias("source"), F.lit("b").alias("target"),
        F.when(n % 4 == 1, " Imports").when(n % 4 == 2, "  ").when(n % 4 == 3, "calls").alias("type"), F.when(n % 3 == 1, "Mutual ").when(n % 3 == 2, "sideways").alias("direction"),
        F.when(F.col("l_quantity") < 5, "none").otherwise((F.col("l_discount") * 15).cast("string")).alias("weight"),
    )
    return repair.sound_edges(rows).select("l_orderkey", "l_linenumber", "type", "direction", "weight")


@query("""WITH t AS (SELECT DISTINCT doc_id % 40 + 1 AS step, doc_id FROM documents WHERE doc_id % 40 NOT IN (3, 4) AND doc_id IS NOT NULL), s AS (SELECT step, count(*) FILTER (WHERE doc_id % 8 <> 6) AS known FROM t GROUP BY step),
c AS (SELECT 'missing place' AS "check", max(step) - count(*) AS n FROM s UNION ALL SELECT 'number of steps', CASE WHEN count(*) BETWEEN 5 AND 15 THEN 0 ELSE count(*) END FROM s UNION ALL SELECT 'step without a node', count(*) FROM s WHERE known = 0) SELECT "check", CAST(n AS BIGINT) AS n FROM c WHERE n > 0""", False)
def reviewed_tour(spark, d):
    """A tour of documents with places left out, too many steps and steps whose nodes are unknown."""
    docs = _docs(spark, d).where(~(F.col("doc_id") % 40).isin(3, 4))
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id")
    return views.tour_review(docs.select((F.col("doc_id") % 40 + 1).alias("step"), name).distinct(), docs.where("doc_id % 8 <> 6").select(name).distinct())


@query("""WITH n AS (SELECT DISTINCT doc_id, doc_id % 3 AS batch, lower(coalesce(source, '') || ' ' || coalesce(lang, '') || ' ' || (doc_id % 10)) AS name FROM documents WHERE doc_id IS NOT NULL), c AS (SELECT name, arg_min(doc_id, batch * 1000000000 + doc_id) AS canon FROM n GROUP BY name), m AS (SELECT * FROM n JOIN c USING (name))
SELECT DISTINCT 'entity:' || a.canon AS source, 'entity:' || b.canon AS target, 'related' AS type, 0.5::DOUBLE AS weight FROM m a JOIN m b ON b.doc_id = a.doc_id + 1 WHERE b.batch <= a.batch""", False)
def answered_entities(spark, d):
    """Documents as entities of three batches, named by source and language with other case and blanks, each tied to the next: names meet, edges follow, and those that come before their end are dropped."""
    docs = _docs(spark, d).groupBy("doc_id").agg(F.max("source").alias("source"), F.max("lang").alias("lang"))
    at = ((F.col("doc_id") % 3).cast("int").alias("batch"), F.col("doc_id").alias("ord"))
    name = F.concat_ws("  ", F.upper(F.coalesce("source", F.lit(""))), F.coalesce("lang", F.lit("")), (F.col("doc_id") % 10).cast("string"))
    entity = lambda c: F.concat(F.lit("entity:"), c.cast("string"))
    nodes = docs.select(*at, entity(F.col("doc_id")).alias("id"), F.lit("Person").alias("type"), name.alias("name"))
    edges = docs.select(*at, entity(F.col("doc_id")).alias("source"), entity(F.col("doc_id") + 1).alias("target"), F.lit("relates_to").alias("type"), F.lit(None).cast("double").alias("weight"))
    none = spark.createDataFrame([], "id string, type string, name string"), spark.createDataFrame([], "source string, target string, type string, weight double")
    return wiki.merged_answers(*none, nodes, edges)["edges"]


@query("""WITH f AS (SELECT doc_id, len(coalesce(text, '')) - len(replace(coalesce(text, ''), chr(10), '')) AS lines, CASE doc_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'markdown' WHEN 2 THEN 'typescript' ELSE 'sql' END AS language, CASE doc_id % 4 WHEN 1 THEN 'docs' WHEN 3 THEN 'data' ELSE 'code' END AS category FROM documents WHERE doc_id IS NOT NULL)
SELECT category, NULL AS language, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines FROM f GROUP BY category UNION ALL SELECT NULL, language, count(*), sum(lines) FROM f GROUP BY language UNION ALL SELECT NULL, NULL, count(*), sum(lines) FROM f""", False)
def text_scan_stats(spark, d):
    """Whole texts as files of four kinds: files and lines by category, by language and in all."""
    ending = F.element_at(F.array(*map(F.lit, (".py", ".md", ".ts", ".sql"))), (F.col("doc_id") % 4 + 1).cast("int"))
    tree = _docs(spark, d).select(F.concat(F.lit("t/"), F.col("doc_id").cast("string"), ending).alias("path"), "text").withColumnRenamed("text", "content")
    return sources.scan_stats(sources.inventory(tree))


@query("SELECT count(*) FILTER (WHERE NOT (lang = 'de' OR doc_id % 10 = 3)) AS files, count(*) FILTER (WHERE lang = 'de' OR doc_id % 10 = 3) AS filtered FROM (SELECT doc_id, coalesce(lang, 'none') AS lang FROM documents WHERE doc_id IS NOT NULL)", False)
def ignored_counts(spark, d):
    """Files that stay, and those that only the caller's patterns drop."""
    paths = _docs(spark, d).select(F.concat_ws("/", F.lit("t"), F.coalesce("lang", F.lit("none")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"))
    return sources.ignore_accounting(paths, ["de/", "*3.txt"])


@query("SELECT count(*) AS nodes, CAST(floor(count(*) * 1.7) AS BIGINT) AS edges, true AS known FROM documents", False)
def synthetic_graph(spark, d):
    """A seeded graph of as many nodes as there are documents, whose edges all have their ends among them."""
    nodes, edges = graphs.synthetic(spark, p.table(spark, d, "documents").count())
    ends = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id"))).join(nodes.select("id"), "id", "left_anti").agg((F.count(F.lit(1)) == 0).alias("known"))
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(edges.agg(F.count(F.lit(1)).alias("edges"))).crossJoin(ends)  # one row each


@query("SELECT 'stale' AS state, 'behind' AS relation, count(*) FILTER (WHERE doc_id % 9 = 0) AS files FROM documents WHERE doc_id IS NOT NULL", False)
def chain_freshness(spark, d):
    """Documents as a history of one line: a graph built at the first is behind the last."""
    ids = _docs(spark, d)
    name = lambda c: F.concat(F.lit("c"), c.cast("string"))
    first, last = ids.agg(F.min("doc_id"), F.max("doc_id")).first()
    commits = ids.select(name(F.col("doc_id")).alias("child"), name(F.col("doc_id") - 1).alias("parent"))
    changed = ids.where("doc_id % 9 = 0").select(F.col("doc_id").cast("string").alias("path"))
    told = views.freshness(commits, f"c{first}", f"c{last}", changed)
    return spark.createDataFrame([(told["state"], told["relation"], told["files"])], "state string, relation string, files long")
