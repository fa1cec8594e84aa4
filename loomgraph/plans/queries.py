"""The operators applied to the driver's tables, each with its SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from ..operators import analytics, build, change, community, graph, imports, parse, repair, search, syntax, traverse, views
from ..sources import files as sources
from ..sources import ignore
from ..streaming import incremental, refresh
from . import projection as p
from .loops import checkpoint_dir, held, parted

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str = "", graph_sql: bool = True) -> Callable:
    """Registers a query under its function's name; its SQL follows the graph's WITH parts."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH RECURSIVE {p.SQL}{sql}" if graph_sql else sql
        return f

    return put


def listed(names: list[str]) -> str:
    return "(" + ", ".join(f"'{x}'" for x in names) + ")"


def case(column: str, default: str, *tables: dict) -> str:
    """SQL of tables ``value: [keys]``; of several the last that has a key counts."""
    return "CASE " + " ".join(f"WHEN {column} IN {listed(keys)} THEN '{x}'" for table in reversed(tables) for x, keys in table.items()) + f" ELSE {default} END"


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, container``: regions hold customers and suppliers, brands hold parts."""
    m = p.layer_members(spark, sf_dir).select(F.col("node_id").alias("id"), F.col("layer_id").alias("container"))
    parts = p.table(spark, sf_dir, "part").select(F.concat(F.lit("class:part/"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("container"))
    return m.unionByName(parts)


_PLACES = ", places AS (SELECT node_id AS id, layer_id AS container FROM layer_members UNION ALL SELECT 'class:part/' || p_partkey, p_brand FROM part)"


@query(_PLACES + """
SELECT a.container AS source_container, b.container AS target_container, count(*) AS count, string_agg(DISTINCT e.type, ',' ORDER BY e.type) AS types
FROM edges e JOIN places a ON a.id = e.source JOIN places b ON b.id = e.target WHERE a.container <> b.container GROUP BY ALL ORDER BY count DESC, 1, 2 LIMIT 20""")
def container_edges(spark, d):
    return graph.container_edges(p.edges(spark, d, "serves"), places(spark, d)).orderBy(F.desc("count"), "source_container", "target_container").limit(20)


@query("SELECT type, complexity, count(*) AS n FROM nodes GROUP BY ALL")
def nodes_by_type_complexity(spark, d):
    return analytics.histogram(p.nodes(spark, d), "type", "complexity")


@query(", ends AS (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) SELECT n.id, count(*) AS degree FROM ends JOIN nodes n USING (id) GROUP BY n.id, n.ord ORDER BY degree DESC, n.ord LIMIT 5")
def degree_top5(spark, d):
    return graph.most_connected(p.nodes(spark, d), p.edges(spark, d))


@query("SELECT round(2.0 * (SELECT count(*) FROM edges) / (SELECT count(*) FROM nodes), 1) AS avg_connections")
def avg_connections(spark, d):
    n = p.nodes(spark, d).agg(F.count(F.lit(1)).alias("n"))
    e = p.edges(spark, d).agg(F.count(F.lit(1)).alias("e"))
    return n.crossJoin(e).select(F.round(2 * F.col("e") / F.col("n"), 1).alias("avg_connections"))  # one row each


@query("SELECT a.type AS source_type, b.type AS target_type, e.type, count(*) AS n FROM edges e JOIN nodes a ON a.id = e.source JOIN nodes b ON b.id = e.target GROUP BY ALL")
def type_matrix(spark, d):
    return analytics.type_matrix(p.nodes(spark, d), p.edges(spark, d))


@query(f"SELECT {case('type', chr(39) + 'code' + chr(39), v.NODE_CATEGORIES)} AS category, count(*) AS n FROM nodes GROUP BY ALL")
def node_categories(spark, d):
    return p.nodes(spark, d).groupBy(graph.node_category(F.col("type")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


_VISIBLE = "SELECT id FROM nodes WHERE type IN ('file', 'class') AND complexity IN ('simple', 'complex') AND (id IN (SELECT node_id FROM layer_members WHERE layer_id IN ('layer:asia', 'layer:europe')))"


def visible(spark, d):
    return graph.filter_nodes(p.nodes(spark, d, "customer", "supplier", "part"), ["file", "class"], ["simple", "complex"], p.layer_members(spark, d), ["layer:asia", "layer:europe"]).select("id")


@query(_VISIBLE)
def filter_nodes(spark, d):
    return visible(spark, d)


@query(f"""SELECT source, target, type, count(*) AS n FROM edges WHERE source IN (SELECT id FROM nodes WHERE complexity = 'complex') AND target IN (SELECT id FROM nodes WHERE complexity = 'complex')
AND {case('type', 'NULL', v.EDGE_CATEGORIES)} IN ('structural', 'infrastructure') GROUP BY ALL""")
def filter_edges(spark, d):
    seen = p.nodes(spark, d).where("complexity = 'complex'").select("id")
    return graph.filter_edges(p.edges(spark, d), seen, ["structural", "infrastructure"]).groupBy("source", "target", "type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT type, count(*) AS n FROM edges WHERE source NOT IN (SELECT id FROM nodes WHERE type IN ('function', 'class')) AND target NOT IN (SELECT id FROM nodes WHERE type IN ('function', 'class')) GROUP BY ALL")
def persona_edges(spark, d):
    seen = graph.persona(p.nodes(spark, d), False).select("id")
    return graph.induced(p.edges(spark, d), seen).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


_SEEDS = "'service:nation/7', 'service:nation/12', 'file:supplier/3'"


def seeds(spark):
    return spark.createDataFrame([("service:nation/7",), ("service:nation/12",), ("file:supplier/3",)], "id string")


_HOP = f", hop AS (SELECT target AS id FROM edges WHERE source IN ({_SEEDS}) UNION SELECT source FROM edges WHERE target IN ({_SEEDS}) UNION SELECT unnest([{_SEEDS}]))"


@query(_HOP + " SELECT id FROM hop")
def khop1(spark, d):
    return graph.neighbours(p.edges(spark, d), F.broadcast(seeds(spark)))


@query(_HOP + " SELECT source, target, type, ord FROM edges WHERE source IN (SELECT id FROM hop) AND target IN (SELECT id FROM hop)")
def induced_subgraph(spark, d):
    e = p.edges(spark, d)
    return graph.induced(e, graph.neighbours(e, F.broadcast(seeds(spark))), few=True).select("source", "target", "type", "ord")


@query(_HOP + " SELECT DISTINCT layer_id FROM layer_members WHERE node_id IN (SELECT id FROM hop)")
def layers_touched(spark, d):
    return graph.touched_layers(p.layer_members(spark, d), graph.neighbours(p.edges(spark, d), F.broadcast(seeds(spark))))


_DOUBLE = ", double_members AS (SELECT * FROM layer_members UNION ALL SELECT 'layer:rich', 9, 'file:customer/' || c_custkey FROM customer WHERE c_acctbal > 9000)"


def double_members(spark, d):
    rich = p.table(spark, d, "customer").where("c_acctbal > 9000").select(F.lit("layer:rich").alias("layer_id"), F.lit(9).alias("layer_ord"), F.concat(F.lit("file:customer/"), F.col("c_custkey").cast("string")).alias("node_id"))
    return p.layer_members(spark, d).unionByName(rich)


@query(_DOUBLE + " SELECT node_id, arg_min(layer_id, layer_ord) AS layer_id FROM double_members GROUP BY node_id")
def first_layer(spark, d):
    return graph.first_layer(double_members(spark, d))


@query(_DOUBLE + " SELECT node_id, string_agg(DISTINCT layer_id, ',' ORDER BY layer_id) AS layers FROM double_members GROUP BY node_id")
def all_layers(spark, d):
    return graph.all_layers(double_members(spark, d))


@query(_DOUBLE + " SELECT node_id, count(DISTINCT layer_id) AS n FROM double_members GROUP BY node_id HAVING count(DISTINCT layer_id) > 1")
def multi_layer_nodes(spark, d):
    return graph.in_several_layers(double_members(spark, d))


@query("SELECT id, type FROM nodes WHERE id NOT IN (SELECT source FROM edges UNION SELECT target FROM edges)")
def orphans(spark, d):
    return graph.orphans(p.nodes(spark, d), p.edges(spark, d))


@query("""SELECT id, CASE WHEN l_suppkey IS NULL THEN 'no file' ELSE 'no node' END AS problem FROM
(SELECT s.id, l_suppkey, s_suppkey FROM (SELECT DISTINCT l_suppkey, 'file:supplier/' || l_suppkey AS id FROM lineitem WHERE l_suppkey % 7 <> 0) l FULL JOIN (SELECT s_suppkey, 'file:supplier/' || s_suppkey AS id FROM supplier) s ON l_suppkey = s_suppkey) WHERE l_suppkey IS NULL OR s_suppkey IS NULL""")
def inventory_diff(spark, d):
    used = p.table(spark, d, "lineitem").where("l_suppkey % 7 != 0").select(F.concat(F.lit("file:supplier/"), F.col("l_suppkey").cast("string")).alias("id"))
    return analytics.cross_check(used, p.nodes(spark, d, "supplier"))


_DIRTY = """, dirty AS (SELECT 'file:supplier/' || s_suppkey AS id, CASE s_suppkey % 6 WHEN 0 THEN 'Func' WHEN 1 THEN 'INTERFACE' WHEN 2 THEN 'pod' WHEN 3 THEN 'page' WHEN 4 THEN 'table' ELSE 'Database' END AS type,
CASE s_suppkey % 8 WHEN 0 THEN 'Easy' WHEN 1 THEN ' HARD ' WHEN 2 THEN '3' WHEN 3 THEN '5' WHEN 4 THEN '9' WHEN 5 THEN 'odd' WHEN 6 THEN NULL ELSE 'moderate' END AS complexity FROM supplier)"""


def dirty(spark, d):
    k = F.col("s_suppkey")
    pick = lambda n, xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % n + 1).cast("int"))
    return p.table(spark, d, "supplier").select(
        F.concat(F.lit("file:supplier/"), k.cast("string")).alias("id"), pick(6, ["Func", "INTERFACE", "pod", "page", "table", "Database"]).alias("type"), pick(8, ["Easy", " HARD ", "3", "5", "9", "odd", None, "moderate"]).alias("complexity")
    )


@query(_DIRTY + f" SELECT id, {case('lower(type)', 'lower(type)', v.NODE_ALIASES, v.OTHER_NODE_ALIASES)} AS type FROM dirty")
def sanitize_alias(spark, d):
    return dirty(spark, d).select("id", repair.canonical_node_type(F.col("type")).alias("type"))


@query(_DIRTY + """ SELECT id, CASE lower(trim(complexity)) WHEN 'easy' THEN 'simple' WHEN 'hard' THEN 'complex' WHEN '3' THEN 'simple' WHEN '5' THEN 'moderate' WHEN '9' THEN 'complex' ELSE 'moderate' END AS complexity,
CASE WHEN lower(trim(complexity)) = 'moderate' THEN 'valid' WHEN lower(trim(complexity)) IN ('easy', 'hard', '3', '5', '9') THEN 'mapped' ELSE 'unknown' END AS status FROM dirty""")
def complexity_normalize(spark, d):
    return dirty(spark, d).select("id", repair.canonical_complexity(F.col("complexity")).alias("c")).select("id", "c.*")


@query(f"SELECT o_orderkey, {case('e', 'e', v.EDGE_ALIASES, v.OTHER_EDGE_ALIASES)} AS type, CASE g WHEN 'to' THEN 'forward' WHEN 'from' THEN 'backward' WHEN 'mutual' THEN 'bidirectional' ELSE 'forward' END AS direction FROM (SELECT o_orderkey, ['uses', 'invokes', 'similar', 'calls', 'instance_of'][o_orderkey % 5 + 1] AS e, ['to', 'from', 'mutual', 'sideways'][o_orderkey % 4 + 1] AS g FROM orders)", False)
def edge_alias(spark, d):
    k = F.col("o_orderkey")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (k % len(xs) + 1).cast("int"))
    kind, way = pick(["uses", "invokes", "similar", "calls", "instance_of"]), pick(["to", "from", "mutual", "sideways"])
    return p.table(spark, d, "orders").select("o_orderkey", repair.canonical_edge_type(kind).alias("type"), repair.canonical_direction(way).alias("direction"))


_WEIGHTS = """, heavy AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN CAST(l_quantity AS VARCHAR) WHEN 2 THEN '0.4abc' WHEN 3 THEN 'none' WHEN 4 THEN NULL WHEN 5 THEN '-3' ELSE '0.25' END AS w FROM lineitem)"""


@query(_WEIGHTS + " SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 2 THEN 0.4 WHEN 3 THEN 0.5 WHEN 4 THEN 0.5 ELSE least(greatest(CAST(w AS DOUBLE), 0), 1) END::DOUBLE AS weight FROM heavy".replace("CAST(w AS DOUBLE)", "TRY_CAST(w AS DOUBLE)"))
def edge_weight_fix(spark, d):
    n = F.col("l_linenumber")
    w = F.when(n == 1, F.col("l_quantity").cast("string")).when(n == 2, "0.4abc").when(n == 3, "none").when(n == 4, F.lit(None)).when(n == 5, "-3").otherwise("0.25")
    return p.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", repair.canonical_weight(w).alias("weight"))


_IDS = ", raw AS (SELECT c_custkey, c_name, CASE c_custkey % 6 WHEN 0 THEN 'file:file:a/' || c_custkey WHEN 1 THEN 'proj:class:b/' || c_custkey WHEN 2 THEN 'func:c/' || c_custkey WHEN 3 THEN 'd/' || c_custkey WHEN 4 THEN 'run' ELSE 'table:t' || c_custkey END AS id, CASE WHEN c_custkey % 6 = 4 THEN 'function' ELSE 'file' END AS type, CASE WHEN c_custkey % 12 = 4 THEN 'src/x.py' END AS path FROM customer)"


@query(_IDS + """ SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'file:a/' || c_custkey WHEN 1 THEN 'class:b/' || c_custkey WHEN 2 THEN 'function:c/' || c_custkey WHEN 3 THEN 'file:d/' || c_custkey WHEN 4 THEN 'function:' || coalesce(path, '__nofilepath__') || ':' || c_name ELSE id END AS id,
CASE c_custkey % 6 WHEN 0 THEN 'double prefix' WHEN 1 THEN 'project-name prefix' WHEN 2 THEN 'prefix canonicalization' WHEN 5 THEN NULL ELSE 'missing prefix' END AS fix FROM raw""")
def id_normalize(spark, d):
    k = F.col("c_custkey")
    key = k.cast("string")
    raw = F.when(k % 6 == 0, F.concat(F.lit("file:file:a/"), key)).when(k % 6 == 1, F.concat(F.lit("proj:class:b/"), key)).when(k % 6 == 2, F.concat(F.lit("func:c/"), key)).when(k % 6 == 3, F.concat(F.lit("d/"), key)).when(k % 6 == 4, "run").otherwise(F.concat(F.lit("table:t"), key))
    df = p.table(spark, d, "customer").select("c_custkey", "c_name", raw.alias("raw"), F.when(k % 6 == 4, "function").otherwise("file").alias("type"), F.when(k % 12 == 4, "src/x.py").alias("path"))
    df = df.withColumn("id", repair.canonical_id(F.col("raw"), F.col("type"), F.col("c_name"), F.col("path")))
    return df.select("c_custkey", "id", repair.id_fix(F.col("raw"), F.col("id")).alias("fix"))


@query(", few AS (SELECT 'file:order/' || o_custkey AS id, o_orderstatus AS name, o_orderkey AS ord FROM orders) SELECT id, arg_max(name, ord) AS name, min(ord) AS ord FROM few GROUP BY id")
def dedup_nodes_last(spark, d):
    n = p.table(spark, d, "orders").select(F.concat(F.lit("file:order/"), F.col("o_custkey").cast("string")).alias("id"), F.col("o_orderstatus").alias("name"), F.col("o_orderkey").alias("ord"))
    return repair.last_nodes(n)


@query("SELECT source, target, weight, ord FROM edges WHERE type = 'depends_on' QUALIFY row_number() OVER (PARTITION BY source, target, type, direction ORDER BY weight DESC, ord) = 1")
def dedup_edges_maxw(spark, d):
    return repair.dedup_edges(p.edges(spark, d, "lines")).select("source", "target", "weight", "ord")


@query("SELECT source, target, weight, ord FROM edges WHERE type = 'serves' QUALIFY row_number() OVER (PARTITION BY source, target, type ORDER BY ord) = 1")
def dedup_edges_first(spark, d):
    return repair.dedup_edges(p.edges(spark, d, "serves"), ("source", "target", "type"), "first").select("source", "target", "weight", "ord")


_HALF = ", half AS (SELECT id FROM nodes WHERE ord % 3 <> 0)"


@query(_HALF + " SELECT reason, count(*) AS n FROM (SELECT CASE WHEN a.id IS NULL AND b.id IS NULL THEN 'missing-both' WHEN a.id IS NULL THEN 'missing-source' WHEN b.id IS NULL THEN 'missing-target' END AS reason FROM edges LEFT JOIN half a ON a.id = source LEFT JOIN half b ON b.id = target) GROUP BY ALL")
def dangling_edges(spark, d):
    return repair.dangling(p.edges(spark, d), p.nodes(spark, d).where("ord % 3 != 0")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT issue, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN s_suppkey % 6 = 0 THEN 'missing type' END, CASE WHEN s_suppkey % 4 = 1 THEN 'missing complexity' END, 'missing summary', CASE WHEN s_suppkey % 3 = 0 THEN 'missing tags' END], lambda x: x IS NOT NULL)) AS issue FROM supplier) GROUP BY ALL", False)
def issues_summary(spark, d):
    k = F.col("s_suppkey")
    n = p.table(spark, d, "supplier").select(
        k.cast("string").alias("id"), F.when(k % 6 != 0, "file").alias("type"), F.when(k % 4 != 1, "low").alias("complexity"), F.lit(None).cast("string").alias("summary"), F.col("s_name").alias("name"), F.when(k % 3 != 0, F.array(F.lit("x"))).alias("tags")
    )
    return repair.issue_counts(repair.node_defaults(n))


@query("SELECT target AS id, count(DISTINCT source) AS fan FROM edges WHERE source <> target GROUP BY ALL ORDER BY fan DESC, id LIMIT 20")
def fan_in_top20(spark, d):
    return analytics.fan(p.edges(spark, d), True)


@query("SELECT source AS id, count(DISTINCT target) AS fan FROM edges WHERE source <> target GROUP BY ALL ORDER BY fan DESC, id LIMIT 20")
def fan_out_top20(spark, d):
    return analytics.fan(p.edges(spark, d), False)


@query("""SELECT id, score FROM (SELECT n.id, CASE WHEN regexp_matches(file_path, '(^|/)index$') THEN 3 ELSE 0 END + CASE WHEN len(string_split(file_path, '/')) - 1 <= 1 THEN 1 ELSE 0 END
+ CASE WHEN fo >= quantile_disc(fo, 0.9) OVER () AND fo > 0 THEN 1 ELSE 0 END + CASE WHEN fi <= quantile_disc(fi, 0.25) OVER () THEN 1 ELSE 0 END AS score
FROM (SELECT n.id, n.file_path, coalesce(o.n, 0) AS fo, coalesce(i.n, 0) AS fi FROM nodes n LEFT JOIN (SELECT source, count(DISTINCT target) AS n FROM edges GROUP BY ALL) o ON o.source = n.id LEFT JOIN (SELECT target, count(DISTINCT source) AS n FROM edges GROUP BY ALL) i ON i.target = n.id WHERE file_path IS NOT NULL) n) ORDER BY score DESC, id LIMIT 5""")
def entry_score(spark, d):
    return analytics.entry_scores(p.nodes(spark, d), p.edges(spark, d))


_BETWEEN = _PLACES + ", met AS (SELECT a.container AS a, b.container AS b, count(*) AS n FROM edges e JOIN places a ON a.id = e.source JOIN places b ON b.id = e.target WHERE e.type IN ('serves', 'contains') GROUP BY ALL)"


@query(_BETWEEN + " SELECT container, CAST(sum(i) AS BIGINT) AS inner, CAST(sum(n) AS BIGINT) AS total, round(sum(i) / sum(n), 4) AS density FROM (SELECT a AS container, CASE WHEN a = b THEN n ELSE 0 END AS i, n FROM met UNION ALL SELECT b, 0, n FROM met WHERE a <> b) GROUP BY container".replace("AS inner", 'AS "inner"'))
def intra_group_density(spark, d):
    return analytics.group_density(p.edges(spark, d, "serves", "customer", "supplier"), places(spark, d))


@query(_BETWEEN + """ SELECT least(a, b) AS first, greatest(a, b) AS second, CAST(sum(CASE WHEN a < b THEN n ELSE 0 END) AS BIGINT) AS out, CAST(sum(CASE WHEN a < b THEN 0 ELSE n END) AS BIGINT) AS back,
CASE WHEN sum(CASE WHEN a < b THEN n ELSE 0 END) >= sum(CASE WHEN a < b THEN 0 ELSE n END) THEN least(a, b) || '->' || greatest(a, b) ELSE greatest(a, b) || '->' || least(a, b) END AS dominant FROM met WHERE a <> b GROUP BY least(a, b), greatest(a, b)""")
def dominant_direction(spark, d):
    return analytics.dominant_direction(graph.container_edges(p.edges(spark, d, "serves", "customer", "supplier"), places(spark, d)))


@query(", per AS (SELECT layer_id, count(*) AS members, count(*) FILTER (complexity = 'complex') AS h, count(*) FILTER (complexity = 'moderate') AS m FROM layer_members JOIN nodes ON id = node_id GROUP BY ALL) SELECT layer_id, members, CASE WHEN h > members * 0.3 THEN 'complex' WHEN m > members * 0.3 THEN 'moderate' ELSE 'simple' END AS complexity FROM per")
def layer_stats(spark, d):
    return graph.layer_stats(p.nodes(spark, d, "customer", "supplier"), p.layer_members(spark, d))


_TRADE = ", trade AS (SELECT DISTINCT 'file:customer/' || o_custkey AS source, 'file:supplier/' || l_suppkey AS target FROM lineitem JOIN orders ON o_orderkey = l_orderkey), lt AS (SELECT a.layer_id AS a, b.layer_id AS b, source, target FROM trade JOIN layer_members a ON a.node_id = source JOIN layer_members b ON b.node_id = target)"


def trade(spark, d):
    o, lines = p.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), p.table(spark, d, "lineitem")
    pairs = parted(lines.join(held(o), "l_orderkey").select("o_custkey", "l_suppkey"), lines.count(), "o_custkey", "l_suppkey").distinct()
    return pairs.select(F.concat(F.lit("file:customer/"), F.col("o_custkey").cast("string")).alias("source"), F.concat(F.lit("file:supplier/"), F.col("l_suppkey").cast("string")).alias("target"), F.lit("calls").alias("type"))


@query(_TRADE + " SELECT a AS source_layer, b AS target_layer, count(*) AS count FROM lt WHERE a <> b GROUP BY ALL")
def layer_edges(spark, d):
    return graph.layer_edges(trade(spark, d), p.layer_members(spark, d))


@query(_TRADE + " SELECT layer_id, count(*) AS connections FROM (SELECT b AS layer_id FROM lt WHERE a = 'layer:asia' AND b <> a UNION ALL SELECT a FROM lt WHERE b = 'layer:asia' AND b <> a) GROUP BY ALL")
def portals(spark, d):
    return graph.portals(trade(spark, d), p.layer_members(spark, d), "layer:asia")


@query(_TRADE + " SELECT source AS id FROM lt WHERE a = 'layer:asia' AND b = 'layer:europe' UNION SELECT target FROM lt WHERE b = 'layer:asia' AND a = 'layer:europe'")
def cross_layer_nodes(spark, d):
    return graph.crossing_nodes(trade(spark, d), p.layer_members(spark, d), "layer:asia", "layer:europe")


@query("SELECT count(n_chars) AS n, min(n_chars) AS min, quantile_disc(n_chars, 0.5) AS p50, quantile_disc(n_chars, 0.95) AS p95, max(n_chars) AS max, round(avg(n_chars), 2) AS mean FROM documents", False)
def distribution(spark, d):
    return analytics.distribution(p.table(spark, d, "documents"), "n_chars")


@query("SELECT count(*) AS expected, count(DISTINCT l_suppkey) AS covered, round(count(DISTINCT l_suppkey) / count(*), 4) AS coverage FROM (SELECT s_suppkey, l_suppkey FROM supplier LEFT JOIN (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_suppkey % 5 <> 0) ON l_suppkey = s_suppkey)", False)
def integrity(spark, d):
    used = p.table(spark, d, "lineitem").where("l_suppkey % 5 != 0").select(F.col("l_suppkey").alias("id"))
    return analytics.coverage(p.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), used)


@query(", n AS (SELECT id, string_split(file_path, '/') AS s FROM nodes WHERE type = 'file') SELECT id, s[1] AS container FROM n")
def folder_containers(spark, d):
    return graph.directory_groups(p.nodes(spark, d, "customer", "supplier"))


_LAYER_CASE = " ".join(f"WHEN list_has_any(s, {[q + e for q in ps for e in ('', 's')]}) THEN '{name}'" for name, ps in v.LAYER_PATTERNS.items())
_API = ", paths AS (SELECT p_partkey, 'src/' || ['apis', 'services', 'Models', 'ui', 'other', 'utils/tests', 'config'][p_partkey % 7 + 1] || '/' || p_brand AS path FROM part)"


def part_paths(spark, d):
    k = F.col("p_partkey")
    mid = F.element_at(F.array(*map(F.lit, ["apis", "services", "Models", "ui", "other", "utils/tests", "config"])), (k % 7 + 1).cast("int"))
    return p.table(spark, d, "part").select(k.alias("id"), F.concat(F.lit("src/"), mid, F.lit("/"), F.col("p_brand")).alias("file_path"))


@query(_API + f" SELECT p_partkey AS id, CASE {_LAYER_CASE} ELSE 'Core' END AS layer FROM (SELECT p_partkey, string_split(lower(path), '/') AS s FROM paths)")
def detect_layers(spark, d):
    return analytics.detect_layers(part_paths(spark, d))


@query(_API + " SELECT p_partkey AS id, CASE WHEN path LIKE 'src/apis%' OR path LIKE '%/src/apis%' THEN 'Front' WHEN path LIKE 'ui%' OR path LIKE '%/ui%' OR path LIKE 'Mod%' OR path LIKE '%/Mod%' THEN 'Back' ELSE 'Other' END AS layer FROM paths")
def apply_patterns(spark, d):
    return analytics.apply_patterns(part_paths(spark, d), [("Front", ["src/apis"]), ("Back", ["ui", "Mod"])])


@query("SELECT file_path AS path, (row_number() OVER (ORDER BY file_path) - 1) // 12 AS batch FROM nodes WHERE type = 'file'")
def count_fallback_batches(spark, d):
    return analytics.count_batches(p.nodes(spark, d, "customer", "supplier").select(F.col("file_path").alias("path")))


_BRANDS = ", g AS (SELECT p_brand AS container, 'class:part/' || p_partkey AS id FROM part)"


def brands(spark, d):
    return p.table(spark, d, "part").select(F.col("p_brand").alias("container"), F.concat(F.lit("class:part/"), F.col("p_partkey").cast("string")).alias("id"))


@query(_BRANDS + " SELECT container, id, CAST(floor(r / ceil(n / ceil(n / 35.0))) AS BIGINT) AS part FROM (SELECT *, count(*) OVER (PARTITION BY container) AS n, row_number() OVER (PARTITION BY container ORDER BY id) - 1 AS r FROM g)")
def split_over_cap(spark, d):
    return analytics.split_large(brands(spark, d)).withColumn("part", F.col("part").cast("long"))


_SMALL = ", g AS (SELECT 'c' || (s_suppkey * s_suppkey % 41) AS container, 'file:supplier/' || s_suppkey AS id FROM supplier)"


@query(_SMALL + ", n AS (SELECT *, count(*) OVER (PARTITION BY container) AS n FROM g) SELECT id, container AS batch FROM n WHERE n >= 3 UNION ALL SELECT id, 'misc/' || CAST((row_number() OVER (ORDER BY id) - 1) // 25 AS VARCHAR) FROM n WHERE n < 3")
def misc_merge(spark, d):
    k = F.col("s_suppkey")
    return analytics.merge_small(p.table(spark, d, "supplier").select(F.concat(F.lit("c"), (k * k % 41).cast("string")).alias("container"), F.concat(F.lit("file:supplier/"), k.cast("string")).alias("id")))


@query(_TRADE + """, batches AS (SELECT node_id AS id, layer_id AS batch FROM layer_members), two AS (SELECT source AS id, target AS neighbour FROM trade UNION SELECT target, source FROM trade), deg AS (SELECT id, count(*) AS n FROM two GROUP BY id)
SELECT two.id, neighbour FROM two JOIN batches a ON a.id = two.id JOIN batches b ON b.id = neighbour JOIN deg ON deg.id = neighbour WHERE a.batch <> b.batch QUALIFY row_number() OVER (PARTITION BY two.id ORDER BY deg.n DESC, neighbour) <= 50""")
def neighbor_map_top50(spark, d):
    return analytics.batch_neighbours(trade(spark, d), p.layer_members(spark, d).select(F.col("node_id").alias("id"), F.col("layer_id").alias("batch")))


_TWO = ", old AS (SELECT source || '/' || doc_id AS path, sha256(text) AS h, lang AS s FROM documents WHERE doc_id % 11 <> 0), new AS (SELECT source || '/' || doc_id AS path, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS h, CASE WHEN doc_id % 10 = 0 THEN lang || '*' ELSE lang END AS s FROM documents WHERE doc_id % 13 <> 0), diff AS (SELECT coalesce(old.path, new.path) AS path, CASE WHEN old.path IS NULL THEN 'new' WHEN new.path IS NULL THEN 'deleted' WHEN old.h = new.h THEN 'unchanged' WHEN old.s = new.s THEN 'cosmetic' ELSE 'structural' END AS change FROM old FULL JOIN new ON old.path = new.path)"


def snapshots(spark, d):
    docs, k = p.table(spark, d, "documents"), F.col("doc_id")
    path = F.concat_ws("/", "source", k.cast("string")).alias("path")
    old = docs.where(k % 11 != 0).select(path, F.sha2("text", 256).alias("content_hash"), F.col("lang").alias("signature"))
    new = docs.where(k % 13 != 0).select(path, F.sha2(F.when(k % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("content_hash"), F.when(k % 10 == 0, F.concat("lang", F.lit("*"))).otherwise(F.col("lang")).alias("signature"))
    return change.changes(old, new)


@query(_TWO + " SELECT path, change FROM diff")
def fingerprint_diff(spark, d):
    return snapshots(spark, d)


@query(_TWO + """ SELECT structural, total, CASE WHEN structural = 0 THEN 'SKIP' WHEN structural > 30 OR structural > total * 0.5 THEN 'FULL' WHEN structural > 10 THEN 'ARCHITECTURE' ELSE 'PARTIAL' END AS update
FROM (SELECT count(*) FILTER (change IN ('new', 'deleted', 'structural')) AS structural, count(*) FILTER (change <> 'deleted') AS total FROM diff)""".replace("AS update", 'AS "update"'))
def classify_update(spark, d):
    return change.update_class(snapshots(spark, d))


@query(", gone AS (SELECT id FROM nodes WHERE file_path LIKE 'region_2/%') SELECT type, count(*) AS n FROM edges WHERE source NOT IN (SELECT id FROM gone) AND target NOT IN (SELECT id FROM gone) GROUP BY ALL")
def merge_update(spark, d):
    n, e = p.nodes(spark, d), p.edges(spark, d)
    changed = n.where("file_path like 'region_2/%'").select("file_path").distinct()
    _, left = change.merge_update(n, e, changed, n.limit(0), e.limit(0))
    return left.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(_DOUBLE + " SELECT layer_id, count(DISTINCT node_id) AS nodes FROM (SELECT * FROM double_members UNION ALL SELECT * FROM layer_members) GROUP BY ALL")
def subdomain_merge_layers(spark, d):
    return change.merge_layers(double_members(spark, d).unionByName(p.layer_members(spark, d)))


@query(_HALF + " SELECT source, target FROM edges WHERE type = 'triggers' AND (source NOT IN (SELECT id FROM half) OR target NOT IN (SELECT id FROM half))")
def pending_edges(spark, d):
    found = repair.dangling(p.edges(spark, d, "events"), p.nodes(spark, d, "steps").where("ord % 3 != 0"))
    return change.pending(found, ["triggers"]).select("source", "target")


def _nation_change(spark, d):
    paths = p.nodes(spark, d, "nation").where("id in ('service:nation/3', 'service:nation/9')").select("file_path")
    n = p.nodes(spark, d, "nation", "customer", "supplier", "orders")
    return n, change.impact(n, p.edges(spark, d, "nation", "customer", "supplier", "orders"), p.layer_members(spark, d), paths)


_IMPACT = ", grown AS (SELECT unnest(['service:nation/3', 'service:nation/9']) AS id UNION SELECT e.target FROM grown JOIN edges e ON e.source = grown.id AND e.type = 'contains'), near AS (SELECT target AS id FROM edges WHERE type = 'contains' AND source IN (SELECT id FROM grown) UNION SELECT source FROM edges WHERE type = 'contains' AND target IN (SELECT id FROM grown)), affected AS (SELECT id FROM near WHERE id NOT IN (SELECT id FROM grown))"


@query(_IMPACT + " SELECT id, 'changed' AS role FROM grown UNION ALL SELECT id, 'affected' FROM affected")
def diff_impact(spark, d):
    _, (changed, affected, _) = _nation_change(spark, d)
    return changed.select("id", F.lit("changed").alias("role")).unionByName(affected.select("id", F.lit("affected").alias("role")))


@query(_IMPACT + """, l AS (SELECT count(DISTINCT layer_id) AS n FROM layer_members WHERE node_id IN (SELECT id FROM grown UNION SELECT id FROM affected))
SELECT (SELECT count(*) FROM grown JOIN nodes USING (id) WHERE complexity = 'complex') AS complex_changes, (SELECT count(*) FROM affected) AS affected, l.n AS layers, CAST(0 AS BIGINT) AS unmapped,
(SELECT count(*) FROM grown JOIN nodes USING (id) WHERE complexity = 'complex') > 0 AS has_complex, l.n > 1 AS crosses_layers, (SELECT count(*) FROM affected) > 5 AS wide FROM l""")
def change_risk(spark, d):
    n, (changed, affected, layers) = _nation_change(spark, d)
    return graph.risk(n.join(changed, "id", "left_semi"), affected, layers, 0)


@query(", walk AS (SELECT 'module:region/1' AS id, 0 AS depth UNION SELECT e.target, depth + 1 FROM walk JOIN edges e ON e.source = walk.id WHERE depth < 8) SELECT id, min(depth) AS depth FROM walk GROUP BY id")
def bfs_depth(spark, d):
    return traverse.bfs_depth(p.edges(spark, d), spark.createDataFrame([("module:region/1",)], "id string"))


def _levels(start: str, most: int) -> str:
    """SQL of a search level by level: each node's least list of edge places, of all shortest ones."""
    parts = [f", few AS (SELECT * FROM edges WHERE type IN ('contains', 'serves') AND source NOT LIKE 'file:customer/%'), arcs AS (SELECT u, v, min(place) AS place FROM (SELECT source AS u, target AS v, 2 * ord AS place FROM few UNION ALL SELECT target, source, 2 * ord + 1 FROM few) GROUP BY ALL)",
             f", l0 AS (SELECT '{start}' AS id, [0::BIGINT] AS places, ['{start}'] AS ids), s0 AS (SELECT id FROM l0)"]
    for k in range(1, most + 1):
        parts.append(f", l{k} AS (SELECT v AS id, min(list_append(places, place)) AS places, arg_min(list_append(ids, v), list_append(places, place)) AS ids FROM l{k - 1} JOIN arcs ON u = id WHERE v NOT IN (SELECT id FROM s{k - 1}) GROUP BY v), s{k} AS (SELECT id FROM s{k - 1} UNION ALL SELECT id FROM l{k})")
    return "".join(parts)


@query(_levels("file:customer/1", 6) + f", found AS ({' UNION ALL '.join(f'SELECT ids FROM l{k} WHERE id = {chr(39)}class:part/1{chr(39)}' for k in range(1, 7))}) SELECT CAST(unnest(range(len(ids))) AS INTEGER) AS pos, unnest(ids) AS id FROM found")
def shortest_path(spark, d):
    return traverse.shortest_path(p.edges(spark, d, "nation", "customer", "supplier", "serves"), "file:customer/1", "class:part/1")


@query(", few AS (SELECT source, target FROM edges WHERE type = 'contains'), walk AS (SELECT id, 0 AS level FROM nodes WHERE type IN ('module', 'service', 'file', 'function') AND id NOT IN (SELECT target FROM few) UNION SELECT f.target, level + 1 FROM walk JOIN few f ON f.source = walk.id) SELECT id, max(level) AS level FROM walk GROUP BY id")
def topological_levels(spark, d):
    n = p.nodes(spark, d, "region", "nation", "customer", "supplier", "orders")
    return traverse.topological_levels(n, p.edges(spark, d, "nation", "customer", "supplier", "orders")).select("id", "level")


@query(", few AS (SELECT DISTINCT source, target FROM edges WHERE type = 'triggers') SELECT a.source AS a, a.target AS b FROM few a JOIN few b ON a.source = b.target AND a.target = b.source WHERE a.source < a.target")
def coupled_pairs(spark, d):
    return analytics.mutual_pairs(p.edges(spark, d, "events"))


@query()
def coupling_clusters(spark, d):
    e = p.edges(spark, d, "events").select("source", "target").distinct()
    return traverse.coupling_clusters(analytics.mutual_pairs(e), e)


@query("SELECT 'file:customer/' || c_custkey AS id, CAST(0.1 AS DOUBLE) AS score FROM customer WHERE lower(c_name) LIKE '%00001%' AND c_custkey > 0 ORDER BY c_custkey LIMIT 10", False)
def name_search(spark, d):
    return search.fuzzy(p.nodes(spark, d, "customer").select("id", "type", "name", "ord"), "00001", k=10)


def _fuzzy(tokens: list[str], nodes: str) -> str:
    """SQL of each node's score (its name alone) for the tokens of a query."""
    one = lambda t: f"CASE WHEN low = '{t}' THEN 0.0 WHEN contains(low, '{t}') THEN 0.1 WHEN near_{tokens.index(t)} <= {max(1, int(len(t) * 0.4))} THEN 0.2 + near_{tokens.index(t)} / {float(len(t))} * 0.8 END"
    near = ", ".join(f"list_min(list_transform(list_filter(regexp_split_to_array(low, '[^a-z0-9#_]+'), lambda w: w <> ''), lambda w: levenshtein(w, '{t}'))) AS near_{k}" for k, t in enumerate(tokens))
    return f", low AS (SELECT id, type, ord, lower(name) AS low FROM nodes WHERE {nodes}), near AS (SELECT *, {near} FROM low), scored AS (SELECT id, type, ord, round(least({', '.join(map(one, tokens))}), 6)::DOUBLE AS score FROM near)"


@query(_fuzzy(["custmer", "000012"], "id LIKE 'file:customer/%' OR type = 'class'") + " SELECT id, score FROM scored WHERE score IS NOT NULL AND type = 'file' ORDER BY score, ord LIMIT 20")
def fuzzy_search(spark, d):
    return search.indexed(search.index(p.nodes(spark, d, "customer", "part")), "custmer 000012", ["file"], 20)


_CHAT = _fuzzy(["gremany", "#000000003"], "id LIKE 'file:%' OR type = 'service'") + """, hits AS (SELECT id FROM scored WHERE score IS NOT NULL ORDER BY score, ord LIMIT 15), few AS (SELECT * FROM edges WHERE type = 'contains' AND source LIKE 'service:%'),
around AS (SELECT id FROM hits UNION SELECT target FROM few WHERE source IN (SELECT id FROM hits) UNION SELECT source FROM few WHERE target IN (SELECT id FROM hits))"""


@query(_CHAT + """ SELECT 'node' AS part, id AS a, type AS b FROM nodes WHERE id IN (SELECT id FROM around) AND (type = 'file' OR type = 'service')
UNION ALL SELECT 'edge', source, target FROM few WHERE source IN (SELECT id FROM around) AND target IN (SELECT id FROM around) UNION ALL SELECT DISTINCT 'layer', layer_id, NULL FROM layer_members WHERE node_id IN (SELECT id FROM around)""")
def chat_context(spark, d):
    """Search, neighbourhood, inner edges and layers of a question, as one operator."""
    n = p.nodes(spark, d, "nation", "customer", "supplier")
    got = search.chat_context(search.index(n), n, p.edges(spark, d, "customer", "supplier"), p.layer_members(spark, d), "gremany #000000003")
    text = lambda c: F.col(c).cast("string")
    return got["nodes"].select(F.lit("node").alias("part"), text("id").alias("a"), text("type").alias("b")).unionByName(got["edges"].select(F.lit("edge").alias("part"), text("source").alias("a"), text("target").alias("b"))).unionByName(got["layers"].select(F.lit("layer").alias("part"), text("layer_id").alias("a"), F.lit(None).cast("string").alias("b")))


@query("""SELECT vec_id AS id, 1 - s AS score FROM (SELECT e.vec_id, round(list_dot_product(e.v, q.v) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(q.v, q.v))), 6) AS s
FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings) e, (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE vec_id = 7) q) WHERE s >= 0 ORDER BY 1 - s, id LIMIT 10""", False)
def semantic_topk(spark, d):
    e = p.table(spark, d, "embeddings")
    query_vector = e.where("vec_id = 7").first().embedding
    return search.semantic(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), query_vector)


@query("SELECT doc_id, len(text) - len(replace(text, chr(10), '')) AS lines FROM documents", False)
def doc_line_counts(spark, d):
    return p.table(spark, d, "documents").select("doc_id", parse.line_count(F.col("text")).alias("lines"))


@query("SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1", False)
def doc_hash_dups(spark, d):
    return change.equal_contents(p.table(spark, d, "documents"), "text", "doc_id")


@query("SELECT page_id, pos, href FROM hrefs")
def page_links(spark, d):
    return p.hrefs(spark, d).select("page_id", F.col("pos").cast("long").alias("pos"), "href")


@query("SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, count(*) AS n FROM pages GROUP BY ALL", False)
def page_hosts(spark, d):
    return analytics.histogram(p.table(spark, d, "pages").select(parse.host(F.col("url")).alias("host")), "host")


@query("SELECT doc_id, array_to_string(list_filter(['license', 'the', 'de', 'und', '@'], lambda k: contains(lower(text), k)), ',') AS concepts FROM documents", False)
def concepts(spark, d):
    return p.table(spark, d, "documents").select("doc_id", F.array_join(parse.concepts(F.col("text"), ["license", "the", "de", "und", "@"]), ",").alias("concepts"))


@query("SELECT lang, source, grouping_id(lang, source) AS level, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ())", False)
def language_stats(spark, d):
    return sources.grouped_counts(p.table(spark, d, "documents"), "lang", "source")


@query("SELECT id, 'region_' || r || '/nation_' || n || '/index' AS config FROM (SELECT id, split_part(split_part(file_path, '/', 1), '_', 2) AS r, split_part(split_part(file_path, '/', 2), '_', 2) AS n FROM nodes WHERE type = 'file')")
def nearest_ancestor(spark, d):
    files = p.nodes(spark, d, "customer", "supplier").select("id", F.col("file_path").alias("path"))
    near = imports.nearest_config(files.select("path"), p.nodes(spark, d, "nation").select(F.col("file_path").alias("config")))
    return files.join(near, "path").select("id", "config")


_ELEMENT = "'file:supplier/3'"


@query(f"""SELECT {_ELEMENT} AS id, 'element' AS role UNION ALL SELECT DISTINCT target, 'child' FROM edges WHERE type = 'contains' AND source = {_ELEMENT}
UNION ALL (SELECT id, 'connected' FROM (SELECT target AS id FROM edges WHERE source = {_ELEMENT} UNION SELECT source FROM edges WHERE target = {_ELEMENT}) WHERE id <> {_ELEMENT} AND id NOT IN (SELECT target FROM edges WHERE type = 'contains' AND source = {_ELEMENT}))
UNION ALL SELECT layer_id, 'layer' FROM layer_members WHERE node_id = {_ELEMENT}""")
def explain_element(spark, d):
    n = p.nodes(spark, d, "supplier")
    path = n.where("id = 'file:supplier/3'").first().file_path
    return views.explain(n, p.edges(spark, d, "serves", "supplier"), p.layer_members(spark, d), path)


@query("""SELECT 'orphan' AS check, 'warning' AS level, count(*) AS n FROM nodes WHERE id NOT IN (SELECT source FROM edges UNION SELECT target FROM edges)
UNION ALL SELECT 'file in no layer', 'critical', count(*) FROM nodes WHERE type IN ('file', 'service') AND id NOT IN (SELECT node_id FROM layer_members)
UNION ALL SELECT 'self edge', 'warning', count(*) FROM edges WHERE source = target
UNION ALL SELECT 'weight out of range', 'warning', n FROM (SELECT count(*) AS n FROM edges WHERE weight < 0 OR weight > 1) WHERE n > 0""".replace("AS check", 'AS "check"'))
def graph_review(spark, d):
    tour = spark.createDataFrame([(1, "module:region/0")], "step int, id string")
    return views.review(p.nodes(spark, d), p.edges(spark, d), p.layer_members(spark, d), tour)


@query(", f AS (SELECT id, string_split(file_path, '/') AS s FROM nodes WHERE type = 'file'), a AS (SELECT id, s, unnest(range(1, len(s) + 1)) AS n FROM f) SELECT DISTINCT array_to_string(s[1:n - 1], '/') AS parent, s[n] AS name, array_to_string(s[1:n], '/') AS path, n < len(s) AS folder, CASE WHEN n = len(s) THEN id END AS id FROM a")
def file_tree(spark, d):
    return views.file_tree(p.nodes(spark, d, "customer", "supplier"))


@query(", own AS (SELECT node_id AS id FROM layer_members WHERE layer_id = 'layer:asia' UNION SELECT target FROM edges JOIN layer_members ON node_id = source WHERE layer_id = 'layer:asia' AND type = 'contains') SELECT type, count(*) AS n FROM edges WHERE source IN (SELECT id FROM own) AND target IN (SELECT id FROM own) GROUP BY ALL")
def layer_detail(spark, d):
    _, between = views.layer_detail(p.nodes(spark, d, "customer", "supplier", "orders", "part"), p.edges(spark, d), p.layer_members(spark, d), "layer:asia")
    return between.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source AS id, count(DISTINCT target) AS children FROM edges WHERE type = 'contains' GROUP BY source")
def node_children(spark, d):
    return graph.children(p.edges(spark, d, "nation", "customer", "supplier", "orders"))


@query(f", w AS (SELECT type, CASE WHEN type = 'contains' THEN 1.0 WHEN type IN ('depends_on', 'triggers') THEN 0.6 ELSE 0.5 END::DOUBLE AS weight FROM edges) SELECT type, weight, count(*) AS n FROM w GROUP BY ALL")
def default_weights(spark, d):
    return p.edges(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("n")).select("type", build.default_weight(F.col("type")).alias("weight"), "n")


@query("""SELECT page_id, href, CASE WHEN regexp_matches(href, '\\.[A-Za-z0-9]+$') THEN lower(regexp_extract(href, '\\.([A-Za-z0-9]+)$', 1)) ELSE '' END AS ext FROM hrefs""")
def link_extensions(spark, d):
    return p.hrefs(spark, d).select("page_id", "href", parse.link_extension(F.col("href")).alias("ext"))


def _containers(spark, d):
    return p.nodes(spark, d, "region", "nation", "customer", "supplier").select("id"), p.edges(spark, d, "nation", "customer", "supplier")


@query()
def communities(spark, d):
    return community.communities(*_containers(spark, d))


def _regions(spark, d):
    """``id, container``: every node of the containers' graph in its region."""
    e = _containers(spark, d)[1].select("source", "target")
    top = e.where("source like 'module:%'").select(F.col("source").alias("container"), F.col("target").alias("id"))
    low = e.where("source like 'service:%'").join(top.withColumnRenamed("id", "source"), "source").select("container", F.col("target").alias("id"))
    return top.unionByName(low).unionByName(top.select("container", F.col("container").alias("id")).distinct())


_REGIONS = """, few AS (SELECT source, target FROM edges WHERE source LIKE 'module:%' OR source LIKE 'service:%'), top AS (SELECT source AS container, target AS id FROM few WHERE source LIKE 'module:%'),
part AS (SELECT * FROM top UNION ALL SELECT top.container, few.target FROM few JOIN top ON top.id = few.source UNION ALL SELECT DISTINCT container, container FROM top),
ends AS (SELECT source AS s, target AS t FROM few UNION ALL SELECT target, source FROM few),
per AS (SELECT a.container, count(*) AS k, count(*) FILTER (WHERE a.container = b.container) AS inside FROM ends JOIN part a ON a.id = s JOIN part b ON b.id = t GROUP BY 1)"""


@query(_REGIONS + " SELECT round(sum(inside) / (SELECT count(*) FROM ends) - sum(k * k) / ((SELECT count(*) FROM ends) * (SELECT count(*) FROM ends)), 6) AS modularity FROM per")
def modularity_of_regions(spark, d):
    return community.modularity(_containers(spark, d)[1], _regions(spark, d)).select(F.round("modularity", 6).alias("modularity"))


@query("SELECT true AS whole, true AS better", False)
def communities_quality(spark, d):
    """Every node has one community, and their modularity is no less than that of the regions."""
    nodes, e = _containers(spark, d)
    found = community.communities(nodes, e)
    whole = found.agg((F.count(F.lit(1)) == F.count_distinct("id")).alias("once"), F.count(F.lit(1)).alias("n")).crossJoin(nodes.agg(F.count(F.lit(1)).alias("all")))  # one row each
    both = community.modularity(e, found).crossJoin(community.modularity(e, _regions(spark, d)).withColumnRenamed("modularity", "known"))
    return whole.crossJoin(both).select((F.col("once") & (F.col("n") == F.col("all"))).alias("whole"), (F.col("modularity") >= F.col("known")).alias("better"))


@query("SELECT 'd' || doc_id AS id, 'd' || (doc_id % 8) AS community FROM documents", False)
def planted_communities(spark, d):
    """Documents in eight blocks: each is tied to twelve hashed ones of its block, and one in four to one of the next; whatever their number, the blocks are the best partition."""
    docs = p.table(spark, d, "documents").select("doc_id")
    size = docs.agg(F.floor((F.max("doc_id") + 1) / 8).alias("size"))
    drawn = docs.crossJoin(F.broadcast(size)).select("doc_id", "size", F.explode(F.sequence(F.lit(0), F.lit(12))).alias("k")).where("k < 12 or doc_id % 4 = 1")  # one row
    other = (F.col("doc_id") + F.when(F.col("k") == 12, 1).otherwise(0)) % 8 + 8 * F.pmod(F.xxhash64("doc_id", "k"), F.col("size"))
    name = lambda c: F.concat(F.lit("d"), c.cast("string"))
    found = community.communities(docs.select(name(F.col("doc_id")).alias("id")), drawn.select(name(F.col("doc_id")).alias("source"), name(other).alias("target")))
    least = found.groupBy("container").agg(F.min(F.substring("id", 2, 20).cast("long")).alias("least"))
    return found.join(least, "container").select("id", name(F.col("least")).alias("community"))


@query()
def heuristic_tour(spark, d):
    n = p.nodes(spark, d, "region", "nation", "supplier")
    order = traverse.topological_levels(n, p.edges(spark, d, "nation", "supplier")).select("id", "pos")
    return views.heuristic_tour(order, n, p.layer_members(spark, d))


@query("""SELECT concat_ws('/', source, lang, doc_id || '.txt') AS path, coalesce(source = 'de' OR lang = 'de', false) OR (doc_id % 10 = 7 AND NOT coalesce(lang = 'en' AND source IS NOT NULL, false)) AS ignored FROM documents""", False)
def ignored_documents(spark, d):
    """Documents as files of a tree: a folder's rule in other case, an ending, and files that are taken back."""
    rules = spark.createDataFrame([("", ignore.TREE, 0, "DE/"), ("", ignore.CALLER, 0, "*7.txt"), ("", ignore.CALLER, 1, "!*/en/*7.txt"), ("", ignore.DATA, 0, "*.txt"), ("", ignore.DATA, 1, "!*.txt"), ("", ignore.CALLER, 2, "# en/")], "dir string, layer int, line int, pattern string")
    paths = p.table(spark, d, "documents").select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"))
    return ignore.ignored_paths(paths, rules).select("path", "ignored")


@query("""WITH t AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS place, unnest(x) AS token FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z_]+|[0-9]+|\\n|[^A-Za-z_0-9 \\t\\n\\f\\r\\v]') AS x FROM documents)),
n AS (SELECT *, sum(CASE WHEN token IN ('(', '[') THEN 1 WHEN token IN (')', ']') THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS inside,
sum(CASE WHEN token = '\n' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS feeds FROM t)
SELECT doc_id, count(*) AS tokens, max(1 + coalesce(feeds, 0))::INTEGER AS last_line, max(coalesce(inside, 0))::INTEGER AS deepest, min(coalesce(inside, 0))::INTEGER AS lowest FROM n WHERE token <> '\n' GROUP BY doc_id""".replace("'\n'", "chr(10)"), False)
def text_nesting(spark, d):
    """Tokens of whole texts with their lines and open brackets."""
    docs = p.table(spark, d, "documents").where("text is not null")
    found = F.regexp_extract_all("text", F.lit(r"[A-Za-z_]+|[0-9]+|\n|[^A-Za-z_0-9 \t\n\f\r\x0B]"), F.lit(0))
    toks = syntax.nested(docs.select("doc_id", F.posexplode(found).alias("at", "token")), ["doc_id"], comments=False)
    return toks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("tokens"), F.max("line").alias("last_line"), F.max("inside").alias("deepest"), F.min("inside").alias("lowest"))


@query("""WITH e AS (SELECT DISTINCT doc_id AS a, doc_id + 7 AS b FROM documents), known AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 11 <> 3)
SELECT CASE WHEN b IN (SELECT * FROM known) THEN 'live' ELSE 'waiting' END AS status, a AS source, b AS target FROM e WHERE a IN (SELECT * FROM known)""", False)
def incremental_edges(spark, d):
    """Documents come in three batches, each with a flow to one seven further on; then some of them go: edges wait while their end is missing."""
    name = lambda c: F.concat(F.lit("step:"), c.cast("string"))
    docs = p.table(spark, d, "documents").where("doc_id is not null").groupBy("doc_id").agg(F.max("text").alias("text"))
    node = F.array(F.struct(name(F.col("doc_id")).alias("id"), F.lit("step").alias("type"), F.col("doc_id").cast("string").alias("name")))
    edge = F.array(F.struct(name(F.col("doc_id")).alias("source"), name(F.col("doc_id") + 7).alias("target"), F.lit("flow_step").alias("type"), F.lit(0.5).alias("weight")))
    rows = docs.select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("path"), F.lit("2024-01-01").cast("timestamp").alias("ts"), F.lit("put").alias("op"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), F.lit("").alias("signature"), node.alias("nodes"), edge.alias("edges"), "doc_id")
    kept = incremental.GraphState(spark, f"{checkpoint_dir(spark)}/state-{uuid.uuid4().hex}")
    for k in range(3):
        kept.apply(rows.where(F.col("doc_id") % 3 == k).drop("doc_id"), k)
    kept.apply(rows.where("doc_id % 11 = 3").withColumn("op", F.lit("delete")).drop("doc_id"), 3)
    _, live, waiting = kept.graph(3)
    number = lambda c: F.substring_index(c, ":", -1).cast("long").alias(c)
    both = live.withColumn("status", F.lit("live")).unionByName(waiting.withColumn("status", F.lit("waiting")))
    return both.select("status", number("source"), number("target"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL", False)
def event_windows(spark, d):
    return refresh.event_windows(p.table(spark, d, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))
