"""Views of a graph for one question: an element, a domain, a layer, a file tree, a tour; and reviews of a whole graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from ..plans.loops import cut, held, numbered
from .graph import first_layer, induced


def find_element(nodes: DataFrame, target: str) -> DataFrame:
    """The node that ``path`` or ``path:name`` (the last colon parts) means: by name within the file, else the first of the path."""
    path, _, name = target.rpartition(":")
    exact = (F.col("file_path") == path) & (F.col("name") == name)
    whole = F.col("file_path") == target
    rank = F.when(exact, 0).when(whole, 1)
    return nodes.withColumn("__rank", rank).where("__rank is not null").orderBy("__rank", "ord").limit(1).drop("__rank")


def explain(nodes: DataFrame, edges: DataFrame, members: DataFrame, target: str) -> DataFrame:
    """``id, role``: the element, its children, what is tied to it, and its layer."""
    own = find_element(nodes, target).select("id")
    one = F.broadcast(own)
    down = edges.where("type = 'contains'").join(one.withColumnRenamed("id", "source"), "source", "left_semi").select(F.col("target").alias("id")).distinct()
    out = edges.join(one.withColumnRenamed("id", "source"), "source", "left_semi").select(F.col("target").alias("id"))
    into = edges.join(one.withColumnRenamed("id", "target"), "target", "left_semi").select(F.col("source").alias("id"))
    tied = out.unionByName(into).distinct().join(down, "id", "left_anti").join(own, "id", "left_anti")
    layer = first_layer(members).join(one.withColumnRenamed("id", "node_id"), "node_id", "left_semi").select(F.col("layer_id").alias("id"))
    parts = {"element": own, "child": down, "connected": tied, "layer": layer}
    return reduce(DataFrame.unionByName, (df.select("id", F.lit(role).alias("role")) for role, df in parts.items()))


def domain_overview(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, flows, steps`` of each domain."""
    flows = edges.where("type = 'contains_flow'").select(F.col("source").alias("id"), F.col("target").alias("flow")).distinct()
    steps = edges.where("type = 'flow_step'").groupBy(F.col("source").alias("flow")).agg(F.count_distinct("target").alias("n"))
    per = flows.join(steps, "flow", "left").groupBy("id").agg(F.count("flow").alias("flows"), F.coalesce(F.sum("n"), F.lit(0)).alias("steps"))
    return nodes.where("type = 'domain'").select("id").join(per, "id", "left").select("id", F.coalesce("flows", F.lit(0)).alias("flows"), F.coalesce("steps", F.lit(0)).alias("steps"))


def flow_steps(edges: DataFrame) -> DataFrame:
    """``flow, step, position``: a step's place is its edge's weight times ten, rounded."""
    return edges.where("type = 'flow_step'").select(F.col("source").alias("flow"), F.col("target").alias("step"), F.round(F.col("weight") * 10).cast("int").alias("position"))


def file_tree(nodes: DataFrame) -> DataFrame:
    """``parent, name, path, folder, id`` of all files and the folders above them; paths that climb out are left out, file nodes are preferred."""
    clean = F.regexp_replace(F.regexp_replace("file_path", r"\\", "/"), r"^(\./|/)+", "")
    ok = nodes.withColumn("path", clean).where("path != '' and path not rlike '(^|/)\\\\.\\\\.(/|$)' and instr(path, char(0)) = 0")
    best = ok.groupBy("path").agg(F.min_by("id", F.struct(F.when(F.col("type") == "file", 0).otherwise(1), "ord")).alias("id"))
    parts = F.split("path", "/")
    above = best.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("path"), (n < F.size(parts)).alias("folder")))).alias("x"), "id")
    flat = above.select("x.path", "x.folder", F.when(~F.col("x.folder"), F.col("id")).alias("id")).distinct()
    name = F.element_at(F.split("path", "/"), -1)
    parent = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    return flat.select(parent.alias("parent"), name.alias("name"), "path", "folder", "id")


def layer_detail(nodes: DataFrame, edges: DataFrame, members: DataFrame, layer: str, technical: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes of a layer with the classes and functions they contain, and the edges between them."""
    own = members.where(F.col("layer_id") == layer).select(F.col("node_id").alias("id"))
    inner = nodes.where(F.col("type").isin("class", "function") if technical else F.lit(False)).select(F.col("id").alias("target"))
    kids = edges.where("type = 'contains'").join(held(own.withColumnRenamed("id", "source")), "source", "left_semi").join(held(inner), "target", "left_semi").select(F.col("target").alias("id"))
    ids = own.unionByName(kids).distinct()
    return nodes.join(ids, "id", "left_semi"), induced(edges, ids)


def heuristic_tour(order: DataFrame, nodes: DataFrame, members: DataFrame, size: int = 3) -> DataFrame:
    """``step, title, id``: nodes of a topological order by layer (those of none under Supporting), concepts last; without layers in batches."""
    met = order.join(nodes.select("id", "type"), "id").join(first_layer(members).withColumnRenamed("node_id", "id"), "id", "left")
    plain = F.concat(F.lit("Part "), (F.floor(F.col("pos") / size) + 1).cast("string"))
    title = F.when(F.col("type") == "concept", "Concepts").otherwise(F.coalesce("layer_id", F.lit("Supporting") if not members.isEmpty() else plain))
    titled = met.select("id", "pos", title.alias("title"), (F.col("type") == "concept").cast("int").alias("late"), F.when(title == "Supporting", 1).otherwise(0).alias("rest"))
    first = titled.groupBy("title").agg(F.min(F.struct("late", "rest", "pos")).alias("at"))
    steps = first.withColumn("step", F.row_number().over(Window.orderBy("at")))  # one row a step
    return titled.join(steps.select("title", "step"), "title").select("step", "title", "id", "pos")


def review(nodes: DataFrame, edges: DataFrame, members: DataFrame, tour: DataFrame) -> DataFrame:
    """``check, level, n`` of the reviewer's checks that found something (``tour``: step, id)."""
    known = [t for types in v.NODE_TYPES.values() for t in types]
    kinds = [t for types in v.EDGE_CATEGORIES.values() for t in types]
    file_level = F.col("type").isin("file", "config", "document", "service", "table", "endpoint", "pipeline", "schema", "resource")
    # what says which ids are known, and where, meets once by id; an id that is null is unknown everywhere
    at = ("node", "file", "source", "target", "member", "stop")

    def marks(df: DataFrame, **of: Column) -> DataFrame:
        return df.select("id", *[of.get(x, F.lit(0)).cast("int").alias(x) for x in at])

    ends = edges.select(F.inline(F.array(F.struct(F.col("source").alias("id"), F.lit(1).alias("s")), F.struct(F.col("target").alias("id"), F.lit(0).alias("s")))))
    rows = [
        marks(nodes, node=F.lit(1), file=F.coalesce(file_level, F.lit(False))), marks(ends, source=F.col("s"), target=1 - F.col("s")),
        marks(members.select(F.col("node_id").alias("id")), member=F.lit(1)), marks(tour, stop=F.lit(1)),
    ]
    ids = reduce(DataFrame.unionByName, rows).groupBy("id").agg(*[F.sum(x).alias(x) for x in at])
    no = lambda *names: F.col("id").isNull() | (sum(F.col(x) for x in names) == 0)
    total = lambda x, where: F.coalesce(F.sum(F.when(where, F.col(x))), F.lit(0))
    count = lambda condition: F.count_if(F.expr(condition) if isinstance(condition, str) else condition)
    found = [
        (nodes, {
            ("unknown node type", "critical"): count(~F.col("type").isin(known)),
            ("missing field", "critical"): count("id is null or name is null or type is null"),
            ("id without its type", "warning"): count("not startswith(id, concat(type, ':'))"),
        }),
        (edges, {
            ("unknown edge type", "critical"): count(~F.col("type").isin(kinds)),
            ("self edge", "warning"): count("source = target"),
            ("weight out of range", "warning"): count("weight < 0 or weight > 1 or weight is null"),
        }),
        (members.groupBy("node_id").agg(F.count_distinct("layer_id").alias("n")), {("node in several layers", "warning"): count("n > 1")}),
        (ids, {
            ("dangling source", "critical"): total("source", no("node")),
            ("dangling target", "critical"): total("target", no("node")),
            ("duplicate id", "critical"): count("node > 1"),
            ("file in no layer", "critical"): total("file", no("member")),
            ("unknown layer member", "critical"): total("member", no("node")),
            ("unknown tour member", "critical"): total("stop", no("node")),
            ("orphan", "warning"): total("node", no("source", "target")),
        }),
    ]
    told = [df.agg(F.array(*[F.struct(F.lit(c).alias("check"), F.lit(l).alias("level"), n.alias("n")) for (c, l), n in checks.items()]).alias("told")).select(F.inline("told")) for df, checks in found]
    return reduce(DataFrame.unionByName, told).where("n > 0")


#: Steps that a tour should have, from and to.
STEPS = (5, 15)


def tour_review(tour: DataFrame, nodes: DataFrame) -> DataFrame:
    """``check, n`` of a tour (``step, id``): places from 1 on that no step has, steps too few or too many (one row of their number), steps without a known node, nodes that come twice."""
    steps = tour.groupBy("step").agg(F.count_distinct("id").alias("n"))
    one = steps.agg(F.count(F.lit(1)).alias("steps"), F.coalesce(F.max("step"), F.lit(0)).alias("last"), F.count(F.when(F.col("step") >= 1, 1)).alias("placed"))
    known = tour.join(nodes.select("id"), "id", "left_semi").select("step").distinct()
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n"))
    found = {
        "missing place": one.select((F.greatest(F.col("last"), F.lit(0)) - F.col("placed")).alias("n")),
        "number of steps": one.select(F.when(~F.col("steps").between(*STEPS), F.col("steps")).otherwise(0).alias("n")),
        "step without a node": count(steps.join(known, "step", "left_anti")),
        "node in several steps": count(tour.groupBy("id").agg(F.count_distinct("step").alias("k")).where("k > 1")),
    }
    return reduce(DataFrame.unionByName, (df.select(F.lit(check).alias("check"), F.col("n").cast("long").alias("n")) for check, df in found.items())).where("n > 0")


def sound_layers(members: DataFrame, layers: DataFrame, nodes: DataFrame) -> DataFrame:
    """``layer_id, nodes``: members (``layer_id, member_ord, node_id``) that exist, in order (without ``member_ord`` by id); layers that lose all of theirs stay, empty."""
    kept = members.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    place = F.col("member_ord") if "member_ord" in members.columns else F.lit(0)
    per = kept.groupBy("layer_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("member_ord"), "node_id"))), lambda x: x["node_id"]).alias("nodes"))
    return layers.select("layer_id").join(per, "layer_id", "left").select("layer_id", F.coalesce("nodes", F.array().cast("array<string>")).alias("nodes"))


def freshness(commits: DataFrame, built: str, head: str, changed: DataFrame) -> dict:
    """How a graph built at one commit stands to another (``commits``: child, parent; ``changed``: path not yet committed)."""
    from .traverse import distances

    if built == head:
        n = changed.count()
        return {"state": "dirty" if n else "fresh", "files": n}
    links = cut(commits.sparkSession, commits.select(F.col("child").alias("u"), F.col("parent").alias("v")).where("u != v").distinct())
    if links.where((F.col("u") == built) | (F.col("v") == built)).isEmpty():
        return {"state": "unknown", "files": 0}

    def above(a: str, b: str) -> bool:
        start = links.sparkSession.createDataFrame([(a,)], "id string")
        return not distances(links, start, b).where(F.col("id") == b).isEmpty()

    relation = "behind" if above(head, built) else "ahead" if above(built, head) else "diverged"
    return {"state": "stale", "relation": relation, "files": changed.count()}


def focus(nodes: DataFrame, edges: DataFrame, seen: DataFrame, seed: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of what is seen (``id``), a hop around a node."""
    inside = induced(edges, seen)
    near = inside.where((F.col("source") == seed) | (F.col("target") == seed)).select(F.explode(F.array("source", "target")).alias("id"))
    ids = near.unionByName(seen.where(F.col("id") == seed).select("id")).distinct()
    return nodes.join(ids, "id", "left_semi"), induced(inside, ids, few=True)


def matches_per_layer(found: DataFrame, members: DataFrame) -> DataFrame:
    """``layer_id, n``: search results (``id``) by the first layer of each."""
    return found.select(F.col("id").alias("node_id")).distinct().join(first_layer(members), "node_id").groupBy("layer_id").agg(F.count(F.lit(1)).alias("n"))


def node_details(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """``role, id, place`` for one node: wikilinks, backlinks, category (the first), flows, steps by weight, children and other ties."""
    out, into = edges.where(F.col("source") == node), edges.where(F.col("target") == node)
    first = into.sparkSession.createDataFrame([], "role string, id string, weight double, ord long")
    rows = [
        out.where("type = 'related'").select(F.lit("wikilink").alias("role"), F.col("target").alias("id"), "weight", "ord"),
        into.where("type = 'related'").select(F.lit("backlink").alias("role"), F.col("source").alias("id"), "weight", "ord"),
        out.where("type = 'categorized_under'").orderBy("ord").limit(1).select(F.lit("category").alias("role"), F.col("target").alias("id"), "weight", "ord"),
        out.where("type = 'contains_flow'").select(F.lit("flow").alias("role"), F.col("target").alias("id"), "weight", "ord"),
        out.where("type = 'flow_step'").select(F.lit("step").alias("role"), F.col("target").alias("id"), "weight", "ord"),
        out.where("type = 'contains'").select(F.lit("child").alias("role"), F.col("target").alias("id"), "weight", "ord"),
        out.where("type not in ('related', 'categorized_under', 'contains_flow', 'flow_step', 'contains')").select(F.lit("other").alias("role"), F.col("target").alias("id"), "weight", "ord"),
        into.where("type != 'related'").select(F.lit("other").alias("role"), F.col("source").alias("id"), "weight", "ord"),
    ]
    every = reduce(DataFrame.unionByName, rows, first).join(nodes.select("id"), "id", "left_semi")
    place = F.row_number().over(Window.partitionBy("role").orderBy(F.when(F.col("role") == "step", F.col("weight")), "ord"))  # one node's ties
    return every.select("role", "id", place.alias("place"))


def domain_detail(edges: DataFrame, domain: str) -> DataFrame:
    """``flow, step, position`` of one domain, steps by their edges' weights; flows without steps have a null one."""
    own = edges.where((F.col("type") == "contains_flow") & (F.col("source") == domain)).select(F.col("target").alias("flow")).distinct()
    return own.join(flow_steps(edges), "flow", "left").select("flow", "step", "position")


def knowledge_visible(nodes: DataFrame, shown: dict[str, bool]) -> DataFrame:
    """Nodes of knowledge types that are switched on; all others stay."""
    off = [k for k, on in shown.items() if not on]
    return nodes.where(~F.col("type").isin(off)) if off else nodes


def has_active_filters(current: dict[str, set], default: dict[str, set]) -> bool:
    return any(set(current.get(k, x)) != set(x) for k, x in default.items())


def exported(nodes: DataFrame, edges: DataFrame, members: DataFrame, tour: DataFrame, seen: DataFrame) -> DataFrame:
    """``part, json`` of what is seen (``id``): nodes, edges between them, layers and steps with the members that are left."""
    n = nodes.join(seen, "id", "left_semi")
    m = members.join(seen.withColumnRenamed("id", "node_id"), "node_id", "left_semi")
    t = tour.join(seen, "id", "left_semi")
    layers = m.groupBy("layer_id").agg(F.array_sort(F.collect_list("node_id")).alias("nodes"))
    steps = t.groupBy("step").agg(F.array_sort(F.collect_list("id")).alias("nodes"))
    parts = {"node": n, "edge": induced(edges, seen), "layer": layers, "step": steps}
    return reduce(DataFrame.unionByName, (df.select(F.lit(k).alias("part"), F.to_json(F.struct(*sorted(df.columns))).alias("json")) for k, df in parts.items()))


def answered_layers(answer: DataFrame, nodes: DataFrame) -> DataFrame:
    """``layer_id, name, node_id, member_ord`` of a model's layers (``json``: a list, or one under ``layers``); ``nodes``, ``node_ids`` and ``files`` all name members.

    A layer without id gets one of its name; paths become file ids; members that do not exist go.
    """
    doc = F.try_parse_json("json")
    items = F.coalesce(F.try_variant_get(doc, "$.layers", "array<variant>"), F.try_variant_get(doc, "$", "array<variant>"))
    rows = answer.select(F.posexplode(items).alias("at", "x"))
    name = F.try_variant_get("x", "$.name", "string")
    slug = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-|-$", "")
    lists = [F.try_variant_get("x", f"$.{k}", "array<string>") for k in ("nodeIds", "node_ids", "nodes", "files")]
    spread = rows.select(F.coalesce(F.try_variant_get("x", "$.id", "string"), F.concat(F.lit("layer:"), slug)).alias("layer_id"), name.alias("name"), F.posexplode(F.coalesce(*lists)).alias("member_ord", "m"))
    node = F.when(F.col("m").rlike("^[A-Za-z]+:"), F.col("m")).otherwise(F.concat(F.lit("file:"), F.regexp_replace("m", r"^\./", "")))
    return spread.select("layer_id", "name", node.alias("node_id"), "member_ord").join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi").select("layer_id", "name", "node_id", "member_ord")


def sound_tour(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """``step, title, nodes``: steps (``ord, title, nodes``) with the members that exist, in order, numbered anew; steps without title go."""
    spread = steps.where("trim(coalesce(title, '')) != ''").select("ord", "title", F.posexplode_outer("nodes").alias("at", "id"))
    known = nodes.select("id", F.lit(True).alias("__k"))
    met = spread.join(known, "id", "left")
    per = met.groupBy("ord", "title").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("__k"), F.struct("at", "id")))), lambda x: x["id"]).alias("nodes"))
    return per.withColumn("step", F.row_number().over(Window.orderBy("ord"))).select("step", "title", "nodes")  # one row a step


def fatal(project: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``problem`` rows that no repair mends: no name of the project, or no node with id and name."""
    bad = project.agg(F.count_if(F.trim(F.coalesce("name", F.lit(""))) != "").alias("n")).where("n = 0").select(F.lit("bad project").alias("problem"))
    none = nodes.agg(F.count_if(F.col("id").isNotNull() & F.col("name").isNotNull()).alias("n")).where("n = 0").select(F.lit("no valid node").alias("problem"))
    return bad.unionByName(none)


def checked_rows(nodes: DataFrame) -> DataFrame:
    """All nodes with ``problem``: of those that must go the first reason, else null; repeated ids stay."""
    known = [t for types in v.NODE_TYPES.values() for t in types]
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    why = F.when(blank("id"), "missing id").when(blank("name"), "missing name").when(~F.col("type").isin(known), "unknown type").when(~F.col("complexity").isin(v.COMPLEXITIES), "unknown complexity")
    return nodes.withColumn("problem", why)


def repaired_layout(items: DataFrame, width: float = 200.0, height: float = 60.0) -> DataFrame:
    """``id, parent, width, height`` of boxes (``id, parent, ord, width, height``): default sizes, one box an id and parent, no parent that is missing or lies inside its own child."""
    one = items.groupBy("id", "parent").agg(F.min_by(F.struct("width", "height"), "ord").alias("s"), F.min("ord").alias("ord"))
    known = one.select(F.col("id").alias("parent"), F.lit(True).alias("__p")).distinct()
    met = one.join(known, "parent", "left").where("parent is null or __p")
    spark = items.sparkSession
    up = met.where("parent is not null").select(F.col("id").alias("at"), F.col("parent").alias("above"))
    reach = cut(spark, up.select(F.col("at").alias("id"), F.col("above").alias("at")).distinct())
    seen = reach
    while not reach.isEmpty():  # parents of parents, until nothing is new
        step = reach.join(up, "at").select("id", F.col("above").alias("at")).distinct()
        reach = cut(spark, step.join(seen, ["id", "at"], "left_anti"))
        seen = cut(spark, seen.unionByName(reach))
    loops = seen.where("id = at").select("id").distinct().withColumn("__loop", F.lit(True))
    return met.join(loops, "id", "left").select("id", F.when(F.col("__loop").isNull(), F.col("parent")).alias("parent"), F.coalesce("s.width", F.lit(width)).alias("width"), F.coalesce("s.height", F.lit(height)).alias("height"))


# fixed values: containers by folder need so many of them, none with a greater share; from so many nodes on, one node makes no container
LEAST_BUCKETS, SHARE, FEW_NODES = 2, 0.7, 3


def derived_containers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, container, strategy`` of a layer's nodes (``id, file_path, ord``): the folder after the part that all folders' names share, ``~`` for what has none; communities
    (``cluster-0`` and so on, in the order of their first nodes) where folders part badly; null where a node would be alone in its container."""
    from .community import communities

    spark = nodes.sparkSession
    held = F.col("file_path").isNotNull() & (F.col("file_path") != "")
    folder = F.regexp_replace("file_path", "/?[^/]*$", "")
    ends = nodes.where(held).agg(F.min(folder).alias("a"), F.max(folder).alias("b"))
    # what the least and the greatest name share, all share; it ends after its last slash
    same = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.least(F.length("a"), F.length("b")), F.lit(1))), lambda k: F.substr(F.col("a"), F.lit(1), k) == F.substr(F.col("b"), F.lit(1), k)))
    shared = F.regexp_replace(F.substr(F.col("a"), F.lit(1), F.when((F.length("a") == 0) | (F.length("b") == 0), 0).otherwise(same)), "[^/]*$", "")
    met = nodes.crossJoin(F.broadcast(ends.select(F.coalesce(F.length(shared), F.lit(0)).alias("skip"))))  # one row
    rest = F.substr(F.col("file_path"), F.col("skip") + 1)
    own = cut(spark, met.select("id", "ord", F.when(held & rest.contains("/"), F.substring_index(rest, "/", 1)).otherwise("~").alias("container")))
    sizes = own.groupBy("container").agg(F.count(F.lit(1)).alias("n"))
    told = sizes.agg(F.count(F.lit(1)).alias("buckets"), F.max("n").alias("most"), F.sum("n").alias("all")).first()
    if not told.all:
        return own.select("id", "container", F.lit("folder").alias("strategy"))
    by_folder = told.buckets >= LEAST_BUCKETS and told.most <= SHARE * told.all
    if not by_folder:
        found = communities(nodes.select("id"), edges).join(nodes.select("id", "ord"), "id")
        first = found.groupBy("container").agg(F.min("ord").alias("first"))
        own = cut(spark, found.join(numbered(first, [F.col("first")], "nth"), "container").select("id", F.concat(F.lit("cluster-"), "nth").alias("container")))
        sizes = own.groupBy("container").agg(F.count(F.lit(1)).alias("n"))
    alone = (F.col("n") == 1) & F.lit(told.all >= FEW_NODES)
    return own.join(sizes, "container").select("id", F.when(~alone, F.col("container")).alias("container"), F.lit("folder" if by_folder else "community").alias("strategy"))
