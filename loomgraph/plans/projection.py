"""The driver's tables as one property graph: nodes, edges, layers, members."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .loops import checkpoint_dir, numbered

#: Places of a kind's rows in the graph's order: kind number times SPAN, plus the row's own number.
SPAN = 1 << 40


#: Folders of whole graphs that this application has written, by application, tables, their files' state and part.
_WRITTEN: dict[tuple, str] = {}


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, sizes and times of the tables' files."""
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = folder.getFileSystem(sc._jsc.hadoopConfiguration()).listFiles(folder, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def _once(spark: SparkSession, sf_dir: str, part: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The whole graph's nodes or edges are made of the tables once an application, and read from the shared folder after that; again if a table's files have changed.

    So links are cut from pages, contents hashed and events ordered once, and columns and filters reach the scan.
    """
    key = (spark.sparkContext.applicationId, sf_dir, _state(spark, sf_dir), part)
    if key not in _WRITTEN:
        folder = f"{checkpoint_dir(spark)}/graph-{part}-{uuid.uuid4().hex}"
        make().write.parquet(folder)
        _WRITTEN[key] = folder
    return spark.read.parquet(_WRITTEN[key])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grade(x: Column, low: float, high: float, inclusive: bool = False) -> Column:
    small, middle = (x <= low, x <= high) if inclusive else (x < low, x < high)
    return F.when(small, "simple").when(middle, "moderate").otherwise("complex")


def _node(kind: int, df: DataFrame, prefix: str, key: Column, number: Column, kind_name: str, name: Column, path: Column | None, complexity: Column) -> DataFrame:
    return df.select(
        F.concat(F.lit(prefix), key.cast("string")).alias("id"), F.lit(kind_name).alias("type"), name.cast("string").alias("name"),
        (F.lit(None) if path is None else path).cast("string").alias("file_path"), complexity.alias("complexity"), (F.lit(kind * SPAN) + number).cast("long").alias("ord"),
    )


def _hash_number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 9), 16, 10).cast("long")


def hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, pos, href`` of every link of every page."""
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(links).alias("pos", "href"))


def nodes(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """``id, type, name, file_path, complexity, ord`` of the given kinds, or of all."""
    t = lambda name: table(spark, sf_dir, name)
    simple, moderate = F.lit("simple"), F.lit("moderate")

    def place(df: DataFrame, nation: str) -> DataFrame:
        return df.join(F.broadcast(t("nation")), df[nation] == F.col("n_nationkey"))

    def placed(df: DataFrame, key: str, nation: str, what: str) -> Column:
        return F.concat_ws("/", F.concat(F.lit("region_"), "n_regionkey"), F.concat(F.lit("nation_"), nation), F.concat(F.lit(f"{what}_"), key))

    def of_region() -> DataFrame:
        return _node(0, t("region"), "module:region/", F.col("r_regionkey"), F.col("r_regionkey"), "module", F.col("r_name"), None, moderate)

    def of_nation() -> DataFrame:
        path = F.concat(F.lit("region_"), "n_regionkey", F.lit("/nation_"), "n_nationkey", F.lit("/index"))
        return _node(1, t("nation"), "service:nation/", F.col("n_nationkey"), F.col("n_nationkey"), "service", F.col("n_name"), path, simple)

    def of_customer() -> DataFrame:
        df = place(t("customer"), "c_nationkey")
        return _node(2, df, "file:customer/", F.col("c_custkey"), F.col("c_custkey"), "file", F.col("c_name"), placed(df, "c_custkey", "c_nationkey", "customer"), grade(F.col("c_acctbal"), 3000, 7000))

    def of_supplier() -> DataFrame:
        df = place(t("supplier"), "s_nationkey")
        return _node(3, df, "file:supplier/", F.col("s_suppkey"), F.col("s_suppkey"), "file", F.col("s_name"), placed(df, "s_suppkey", "s_nationkey", "supplier"), grade(F.col("s_acctbal"), 3000, 7000))

    def of_part() -> DataFrame:
        path = F.concat(F.lit("parts/"), "p_brand", F.lit("/part_"), "p_partkey")
        return _node(4, t("part"), "class:part/", F.col("p_partkey"), F.col("p_partkey"), "class", F.col("p_name"), path, grade(F.col("p_size"), 15, 35, True))

    def of_orders() -> DataFrame:
        path = F.concat(F.lit("orders/customer_"), "o_custkey")
        return _node(5, t("orders"), "function:order/", F.col("o_orderkey"), F.col("o_orderkey"), "function", F.col("o_orderkey"), path, grade(F.col("o_totalprice"), 100000, 250000))

    def of_documents() -> DataFrame:
        path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
        return _node(6, t("documents"), "article:doc/", F.col("doc_id"), F.col("doc_id"), "article", F.col("doc_id"), path, grade(F.col("n_chars"), 1000, 4000))

    def of_pages() -> DataFrame:
        host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
        return _node(7, t("pages"), "source:page/", F.col("page_id"), F.col("page_id"), "source", F.col("url"), host, simple)

    def of_benchmark() -> DataFrame:
        return _node(8, t("benchmark"), "claim:bench/", F.col("item_id"), F.col("item_id"), "claim", F.col("item_id"), None, simple)

    def of_users() -> DataFrame:
        return _node(9, t("events").select("user_id").distinct(), "entity:user/", F.col("user_id"), F.col("user_id"), "entity", F.col("user_id"), None, simple)

    def of_steps() -> DataFrame:
        df = t("events").select("event_type").distinct()
        return _node(10, df, "step:event/", F.col("event_type"), _hash_number(F.col("event_type")), "step", F.col("event_type"), None, simple)

    def of_topics() -> DataFrame:
        df = hrefs(spark, sf_dir).select("href").distinct()
        return _node(11, df, "topic:path/", F.col("href"), _hash_number(F.col("href")), "topic", F.col("href"), None, simple)

    made = {
        "region": of_region, "nation": of_nation, "customer": of_customer, "supplier": of_supplier, "part": of_part, "orders": of_orders,
        "documents": of_documents, "pages": of_pages, "benchmark": of_benchmark, "users": of_users, "steps": of_steps, "topics": of_topics,
    }
    if not kinds:
        return _once(spark, sf_dir, "nodes", lambda: reduce(DataFrame.unionByName, (f() for f in made.values())))
    return reduce(DataFrame.unionByName, (made[k]() for k in kinds))


def _edge(kind: int, df: DataFrame, source: Column, target: Column, kind_name: str, weight: Column | float, number: Column) -> DataFrame:
    weight = F.lit(weight) if isinstance(weight, float) else weight
    return df.select(source.alias("source"), target.alias("target"), F.lit(kind_name).alias("type"), F.lit("forward").alias("direction"), weight.cast("double").alias("weight"), (F.lit(kind * SPAN) + number).cast("long").alias("ord"))


def _id(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def edges(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """``source, target, type, direction, weight, ord`` of the given kinds, or of all."""
    t = lambda name: table(spark, sf_dir, name)

    def of_events() -> DataFrame:
        # events are numbered by ranges over all users and meet the next number, so a user of very many events is not one task's
        placed = numbered(t("events").select("event_id", "event_type", "user_id", "ts"), [F.col("user_id"), F.col("ts"), F.col("event_id")], "n")
        after = placed.select((F.col("n") - 1).alias("n"), F.col("user_id").alias("same"), F.col("event_type").alias("next"))
        df = placed.join(after, "n").where(F.col("user_id").eqNullSafe(F.col("same"))).where("next is not null")
        return _edge(7, df, _id("step:event/", "event_type"), _id("step:event/", "next"), "triggers", 0.6, F.col("event_id"))

    def of_copies() -> DataFrame:
        df = t("documents").select("doc_id", F.sha2("text", 256).alias("h"))
        first = df.groupBy("h").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        return _edge(8, df.join(first, "h").where("doc_id > first"), _id("article:doc/", "first"), _id("article:doc/", "doc_id"), "similar_to", 1.0, F.col("doc_id"))

    made = {
        "nation": lambda: _edge(0, t("nation"), _id("module:region/", "n_regionkey"), _id("service:nation/", "n_nationkey"), "contains", 1.0, F.col("n_nationkey")),
        "customer": lambda: _edge(1, t("customer"), _id("service:nation/", "c_nationkey"), _id("file:customer/", "c_custkey"), "contains", 1.0, F.col("c_custkey")),
        "supplier": lambda: _edge(2, t("supplier"), _id("service:nation/", "s_nationkey"), _id("file:supplier/", "s_suppkey"), "contains", 1.0, F.col("s_suppkey")),
        "orders": lambda: _edge(3, t("orders"), _id("file:customer/", "o_custkey"), _id("function:order/", "o_orderkey"), "contains", 1.0, F.col("o_orderkey")),
        "lines": lambda: _edge(4, t("lineitem"), _id("function:order/", "l_orderkey"), _id("class:part/", "l_partkey"), "depends_on", F.col("l_discount") * 10, F.col("l_orderkey") * 16 + F.col("l_linenumber")),
        "serves": lambda: _edge(5, t("lineitem"), _id("file:supplier/", "l_suppkey"), _id("class:part/", "l_partkey"), "serves", 0.5, F.col("l_orderkey") * 16 + F.col("l_linenumber")),
        "links": lambda: _edge(6, hrefs(spark, sf_dir), _id("source:page/", "page_id"), _id("topic:path/", "href"), "related", 0.7, F.col("page_id") * 4096 + F.col("pos")),
        "events": of_events,
        "copies": of_copies,
    }
    if not kinds:
        return _once(spark, sf_dir, "edges", lambda: reduce(DataFrame.unionByName, (f() for f in made.values())))
    return reduce(DataFrame.unionByName, (made[k]() for k in kinds))


def layer_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``layer_id, layer_ord, node_id``: a layer for each region, with its customers and suppliers."""
    region = F.broadcast(table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")))
    layer = (F.concat(F.lit("layer:"), F.lower("r_name")).alias("layer_id"), F.col("r_regionkey").alias("layer_ord"))
    c = table(spark, sf_dir, "customer").join(region, F.col("c_nationkey") == F.col("n_nationkey")).select(*layer, _id("file:customer/", "c_custkey").alias("node_id"))
    s = table(spark, sf_dir, "supplier").join(region, F.col("s_nationkey") == F.col("n_nationkey")).select(*layer, _id("file:supplier/", "s_suppkey").alias("node_id"))
    return c.unionByName(s)


#: The same graph for DuckDB.
SQL = f"""
hrefs AS (SELECT page_id, i - 1 AS pos, h[i] AS href FROM (SELECT page_id, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages))),
nodes AS (
  SELECT 'module:region/' || r_regionkey AS id, 'module' AS type, r_name AS name, CAST(NULL AS VARCHAR) AS file_path, 'moderate' AS complexity, CAST(r_regionkey AS BIGINT) AS ord FROM region
  UNION ALL SELECT 'service:nation/' || n_nationkey, 'service', n_name, 'region_' || n_regionkey || '/nation_' || n_nationkey || '/index', 'simple', {SPAN} + n_nationkey FROM nation
  UNION ALL SELECT 'file:customer/' || c_custkey, 'file', c_name, 'region_' || n_regionkey || '/nation_' || c_nationkey || '/customer_' || c_custkey, CASE WHEN c_acctbal < 3000 THEN 'simple' WHEN c_acctbal < 7000 THEN 'moderate' ELSE 'complex' END, 2 * {SPAN} + c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'file:supplier/' || s_suppkey, 'file', s_name, 'region_' || n_regionkey || '/nation_' || s_nationkey || '/supplier_' || s_suppkey, CASE WHEN s_acctbal < 3000 THEN 'simple' WHEN s_acctbal < 7000 THEN 'moderate' ELSE 'complex' END, 3 * {SPAN} + s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'class:part/' || p_partkey, 'class', p_name, 'parts/' || p_brand || '/part_' || p_partkey, CASE WHEN p_size <= 15 THEN 'simple' WHEN p_size <= 35 THEN 'moderate' ELSE 'complex' END, 4 * {SPAN} + p_partkey FROM part
  UNION ALL SELECT 'function:order/' || o_orderkey, 'function', CAST(o_orderkey AS VARCHAR), 'orders/customer_' || o_custkey, CASE WHEN o_totalprice < 100000 THEN 'simple' WHEN o_totalprice < 250000 THEN 'moderate' ELSE 'complex' END, 5 * {SPAN} + o_orderkey FROM orders
  UNION ALL SELECT 'article:doc/' || doc_id, 'article', CAST(doc_id AS VARCHAR), concat_ws('/', source, lang, CAST(doc_id AS VARCHAR)), CASE WHEN n_chars < 1000 THEN 'simple' WHEN n_chars < 4000 THEN 'moderate' ELSE 'complex' END, 6 * {SPAN} + doc_id FROM documents
  UNION ALL SELECT 'source:page/' || page_id, 'source', url, regexp_extract(url, '^[a-z]+://([^/]+)', 1), 'simple', 7 * {SPAN} + page_id FROM pages
  UNION ALL SELECT 'claim:bench/' || item_id, 'claim', CAST(item_id AS VARCHAR), NULL, 'simple', 8 * {SPAN} + item_id FROM benchmark
  UNION ALL SELECT DISTINCT 'entity:user/' || user_id, 'entity', CAST(user_id AS VARCHAR), NULL, 'simple', 9 * {SPAN} + user_id FROM events
  UNION ALL SELECT DISTINCT 'step:event/' || event_type, 'step', event_type, NULL, 'simple', 10 * {SPAN} + CAST('0x' || substr(md5(event_type), 1, 9) AS BIGINT) FROM events
  UNION ALL SELECT DISTINCT 'topic:path/' || href, 'topic', href, NULL, 'simple', 11 * {SPAN} + CAST('0x' || substr(md5(href), 1, 9) AS BIGINT) FROM hrefs),
copies AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents WHERE text IS NOT NULL),
edges AS (
  SELECT 'module:region/' || n_regionkey AS source, 'service:nation/' || n_nationkey AS target, 'contains' AS type, 'forward' AS direction, 1.0::DOUBLE AS weight, CAST(n_nationkey AS BIGINT) AS ord FROM nation
  UNION ALL SELECT 'service:nation/' || c_nationkey, 'file:customer/' || c_custkey, 'contains', 'forward', 1.0, {SPAN} + c_custkey FROM customer
  UNION ALL SELECT 'service:nation/' || s_nationkey, 'file:supplier/' || s_suppkey, 'contains', 'forward', 1.0, 2 * {SPAN} + s_suppkey FROM supplier
  UNION ALL SELECT 'file:customer/' || o_custkey, 'function:order/' || o_orderkey, 'contains', 'forward', 1.0, 3 * {SPAN} + o_orderkey FROM orders
  UNION ALL SELECT 'function:order/' || l_orderkey, 'class:part/' || l_partkey, 'depends_on', 'forward', l_discount * 10, 4 * {SPAN} + l_orderkey * 16 + l_linenumber FROM lineitem
  UNION ALL SELECT 'file:supplier/' || l_suppkey, 'class:part/' || l_partkey, 'serves', 'forward', 0.5, 5 * {SPAN} + l_orderkey * 16 + l_linenumber FROM lineitem
  UNION ALL SELECT 'source:page/' || page_id, 'topic:path/' || href, 'related', 'forward', 0.7, 6 * {SPAN} + page_id * 4096 + pos FROM hrefs
  UNION ALL SELECT 'step:event/' || event_type, 'step:event/' || next, 'triggers', 'forward', 0.6, 7 * {SPAN} + event_id FROM (SELECT event_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events) WHERE next IS NOT NULL
  UNION ALL SELECT 'article:doc/' || first, 'article:doc/' || doc_id, 'similar_to', 'forward', 1.0, 8 * {SPAN} + doc_id FROM copies WHERE doc_id > first),
layer_members AS (
  SELECT 'layer:' || lower(r_name) AS layer_id, r_regionkey AS layer_ord, 'file:customer/' || c_custkey AS node_id FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'layer:' || lower(r_name), r_regionkey, 'file:supplier/' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""
