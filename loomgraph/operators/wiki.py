"""Wiki pages to a graph: articles, topics, sources, links between them, layers and the places of entities and claims.

Names are found in other names and in texts by a join on one part of them: the rarest run of up to eight characters of what is looked for
meets the texts that hold it, and only those are searched.  So no name is tried on every text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from ..functions.columns import lookup
from ..plans.loops import cut
from . import parse


def stem(path):
    return F.lower(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.md$", ""))


def wiki_graph(pages: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (``id, type, name, complexity``) and edges of wiki pages (``path, content``) and an index page with ``##`` sections.

    Links meet pages by base name; names that several pages share meet none.  Complexity follows the number of links: over 15, over 5.
    """
    own = pages.select("path", stem(F.col("path")).alias("key"))
    unique = own.join(own.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n = 1"), "key", "left_semi")
    article = lambda c: F.concat(F.lit("article:"), F.regexp_replace(c, r"\.md$", ""))
    links = parse.wikilinks(pages).select(F.col("path").alias("from"), stem(F.col("target")).alias("key")).distinct()
    met = links.join(unique, "key").where("path != from")
    related = met.select(article(F.col("from")).alias("source"), article(F.col("path")).alias("target"), F.lit("related").alias("type"), F.lit(0.7).alias("weight"))
    found = parse.index_categories(index).select("category", stem(F.col("target")).alias("key")).distinct().join(unique, "key")
    topic = lambda c: F.concat(F.lit("topic:"), F.regexp_replace(F.lower(c), r"\s+", "-"))
    filed = found.select(article(F.col("path")).alias("source"), topic(F.col("category")).alias("target"), F.lit("categorized_under").alias("type"), F.lit(0.6).alias("weight"))
    n = links.groupBy(F.col("from").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    title = F.regexp_extract("content", r"(?m)^#\s+(.+)$", 1)
    size = F.when(F.col("n") > 15, "complex").when(F.col("n") > 5, "moderate").otherwise("simple")
    nodes = pages.join(n, "path", "left").select(article(F.col("path")).alias("id"), F.lit("article").alias("type"), F.when(title != "", title).otherwise(stem(F.col("path"))).alias("name"), size.alias("complexity"))
    topics = found.select(topic(F.col("category")).alias("id"), F.lit("topic").alias("type"), F.col("category").alias("name"), F.lit("simple").alias("complexity")).distinct()
    return nodes.unionByName(topics), related.unionByName(filed)


def merge_entities(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (``id, name, ord``) of one normalised name become the first of them; also ``old, new, ord`` of those that went."""
    key = F.regexp_replace(F.lower(F.trim("name")), r"[^\p{L}\p{N}]+", " ")
    first = entities.groupBy(key.alias("key")).agg(F.min_by("id", "ord").alias("new"))
    met = entities.withColumn("key", key).join(first, "key")
    return met.where("id = new").select(entities.columns), met.where("id != new").select(F.col("id").alias("old"), "new", "ord")


#: Pages at the top of a wiki that are no articles.
INFRASTRUCTURE = ["index.md", "log.md", "claude.md", "agents.md", "soul.md"]
#: Characters of the runs by which texts are found: as many as a pattern has.
RUNS = (1, 2, 4, 8)


def containing(patterns: DataFrame, texts: DataFrame) -> DataFrame:
    """``pattern_id, text_id`` of all pairs where a text (``text_id, text``) contains a pattern (``pattern_id, pattern``, not empty), once each."""

    def runs(text, n: int):
        # one pass over a text; substr would count its characters again for every place.  Half a surrogate pair begins a run of its own in patterns and texts alike
        return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))

    spark = texts.sparkSession
    patterns, texts = cut(spark, patterns), cut(spark, texts)
    found = [patterns.limit(0).select("pattern_id").crossJoin(texts.limit(0).select("text_id"))]  # no rows: the types
    length = F.greatest(*(F.when(F.length("pattern") >= n, n) for n in RUNS))
    lengths = {r[0] for r in patterns.select(length).distinct().collect()} - {None}  # as many as RUNS at most
    for n in sorted(lengths):
        asked = cut(spark, patterns.where(length == n).select("pattern_id", "pattern", F.explode(runs(F.col("pattern"), n)).alias("run")).distinct())
        # of a text's runs only those that are asked for are kept, so where patterns are few nothing else is shuffled
        wanted = cut(spark, asked.select("run").distinct())
        held = cut(spark, texts.select("text_id", F.explode(runs(F.col("text"), n)).alias("run")).join(wanted, "run", "left_semi").distinct())
        # a pattern with a run that no text holds is in none
        counts = held.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
        rarest = asked.join(counts, "run", "left").groupBy("pattern_id", "pattern").agg(F.min_by("run", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("run"))
        met = rarest.join(held, "run").join(texts, "text_id")
        found.append(met.where(F.col("text").contains(F.col("pattern"))).select("pattern_id", "text_id"))
    return reduce(DataFrame.unionByName, found).distinct()


def page_names(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``key, stem`` of all names of pages (``path``, below the wiki's folder): whole paths, and base names that one page has; and the first page of every ending of these."""
    stem = F.regexp_replace("path", r"\.md$", "")
    own = pages.select("path", stem.alias("stem"))
    whole = own.select(F.lower("stem").alias("key"), "stem")
    base = own.select(F.lower(F.element_at(F.split("stem", "/"), -1)).alias("key"), "stem")
    shared = base.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("stem").alias("stem"))
    shared = cut(pages.sparkSession, shared)
    names = whole.unionByName(shared.where("n = 1").select("key", "stem")).join(shared.where("n > 1").select("key"), "key", "left_anti").groupBy("key").agg(F.min("stem").alias("stem"))
    names = cut(pages.sparkSession, names)
    parts = F.split("key", "/")
    endings = names.select("stem", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))).alias("key"))
    return names, endings.groupBy("key").agg(F.min("stem").alias("stem"))


def resolved_links(links: DataFrame, pages: DataFrame, prefix: str = "") -> DataFrame:
    """Adds ``page`` (a stem, null if there is none) to links (``target``, any other columns): by whole path or unshared base name, with or without the wiki's folder, else by the first page whose path ends so; never to a page of the infrastructure."""
    spark = pages.sparkSession
    names, endings = page_names(pages)
    endings = cut(spark, endings)
    key = F.lower(F.trim("target"))
    short = F.when(key.startswith(prefix + "/"), F.substr(key, F.lit(len(prefix) + 2))) if prefix else F.lit(None).cast("string")
    asked = links.select("target").distinct().select("target", F.when(~key.startswith("-"), key).alias("k1"), F.when(~key.startswith("-"), short).alias("k2"))
    met = asked
    for table, column in ((names, "a"), (endings, "e")):
        for k in ("1", "2"):
            met = met.join(table.select(F.col("key").alias(f"k{k}"), F.col("stem").alias(column + k)), f"k{k}", "left")
    page = F.coalesce("a1", "a2", "e1", "e2")
    top = ~page.contains("/") & F.concat(F.lower(page), F.lit(".md")).isin(INFRASTRUCTURE)
    return links.join(met.select("target", F.when(~top, page).alias("page")), "target", "left")


def wiki_scan(files: DataFrame, wiki: str = "wiki", raw: str = "raw") -> dict[str, DataFrame]:
    """A wiki's tree (``path, content, size``) as ``nodes`` (id, type, name, path, tags, complexity, backlinks, ord), ``edges`` (source, target, type, weight, ord) and ``unresolved`` links (path, target).

    Pages are the Markdown files of the wiki's folder; its index (or that of the tree), in any case, gives the topics; files of the raw folder are sources.
    Articles come in the order of their paths, then topics in the index's, then sources.  Backlinks are one a link, in the order of links.
    """
    inside = files.where(F.col("path").startswith(wiki + "/") & F.col("path").endswith(".md")).select(F.substr(F.col("path"), F.lit(len(wiki) + 2)).alias("path"), "content")
    articles = inside.where(~(~F.col("path").contains("/") & F.lower("path").isin(INFRASTRUCTURE)))
    index = files.where(F.lower("path").isin(f"{wiki}/index.md", "index.md") & (F.col("path").startswith(wiki + "/") | ~F.col("path").contains("/")))
    best = index.agg(F.min_by(F.struct("path", "content"), F.struct((~F.col("path").startswith(wiki + "/")).alias("outer"), (F.element_at(F.split("path", "/"), -1) != "index.md").alias("other"), "path"))["content"].alias("content")).select(F.lit("index").alias("path"), "content")
    listed = parse.lines(best)
    head = F.when(F.col("text").rlike(r"^##\s+\S"), F.trim(F.regexp_extract("text", r"^##\s+(.+)$", 1)))
    order = Window.orderBy("line")  # lines of one page
    marked = listed.withColumn("category", F.last(head, True).over(order)).withColumn("heads", head.isNotNull())
    topics = marked.where("heads").groupBy("category").agg(F.min("line").alias("line"))
    slug = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit("-"))
    pattern = r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"
    entries = marked.where("category is not null and not heads").select("category", "line", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("nth", "target"))
    entries, articles = cut(files.sparkSession, entries.withColumn("target", F.trim("target"))), cut(files.sparkSession, articles)
    filed = cut(files.sparkSession, resolved_links(entries, inside, wiki).where("page is not null"))
    links = articles.select("path", F.posexplode(F.regexp_extract_all("content", F.lit(pattern), F.lit(1))).alias("nth", "target")).withColumn("target", F.trim("target"))
    met = cut(files.sparkSession, resolved_links(links, inside, wiki).withColumn("stem", F.regexp_replace("path", r"\.md$", "")))
    article = lambda c: F.concat(F.lit("article:"), c)
    related = met.where("page is not null and page != stem").select(article(F.col("stem")).alias("source"), article(F.col("page")).alias("target"), F.lit("related").alias("type"), F.lit(0.7).alias("weight"), F.struct(F.lit(0).alias("kind"), F.col("path").alias("at"), F.lit(0).alias("line"), "nth").alias("ord"))
    under = filed.select(article(F.col("page")).alias("source"), F.concat(F.lit("topic:"), slug("category")).alias("target"), F.lit("categorized_under").alias("type"), F.lit(0.6).alias("weight"), F.struct(F.lit(1).alias("kind"), F.lit("").alias("at"), "line", "nth").alias("ord"))
    edges = related.unionByName(under).groupBy("source", "target", "type").agg(F.first("weight").alias("weight"), F.min("ord").alias("ord"))
    # the category of a page is the last one whose entry is its base name, else its path
    said = F.lower("target")
    entry = entries.select("category", "line", "nth", F.explode(F.array_distinct(F.array(said, F.when(said.startswith(wiki + "/"), F.substr(said, F.lit(len(wiki) + 2))).otherwise(said)))).alias("key")).groupBy("key").agg(F.max_by("category", F.struct("line", "nth")).alias("category"))
    stem = F.regexp_replace("path", r"\.md$", "")
    own = articles.select("path", stem.alias("stem"), "content", F.lower(F.element_at(F.split(stem, "/"), -1)).alias("base"))
    own = own.join(entry.select(F.col("key").alias("base"), F.col("category").alias("c1")), "base", "left").join(entry.select(F.col("key").alias("low"), F.col("category").alias("c2")), F.lower("stem") == F.col("low"), "left")
    n = links.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    back = related.groupBy(F.col("target").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "source"))), lambda x: x["source"]).alias("backlinks"))  # links of one page
    title = F.trim(F.regexp_extract("content", r"(?m)^#\s+(.+)$", 1))
    folder = F.nullif(F.regexp_replace("path", r"/?[^/]+$", ""), F.lit(""))
    named = F.filter(F.transform(F.split(F.coalesce(parse.frontmatter(F.col("content"))["tags"], F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    tags = F.array_sort(F.array_distinct(F.concat(F.array_compact(F.array(F.lower(F.coalesce("c1", "c2")), folder)), named)))
    size = F.when(F.col("n") > 15, "complex").when(F.col("n") > 5, "moderate").otherwise("simple")
    none = F.array().cast("array<string>")
    shown = own.join(n, "path", "left").select(article(F.col("stem")).alias("id"), F.lit("article").alias("type"), F.when(title != "", title).otherwise(F.element_at(F.split("stem", "/"), -1)).alias("name"), F.concat(F.lit(wiki + "/"), "path").alias("path"), tags.alias("tags"), size.alias("complexity"), F.struct(F.lit(0).alias("kind"), F.col("path").alias("at"), F.lit(0).alias("line")).alias("ord"))
    shown = shown.join(back, "id", "left").withColumn("backlinks", F.coalesce("backlinks", none))
    topic = topics.select(F.concat(F.lit("topic:"), slug("category")).alias("id"), F.lit("topic").alias("type"), F.col("category").alias("name"), F.lit(None).cast("string").alias("path"), F.array(F.lit("category")).alias("tags"), F.lit("simple").alias("complexity"), F.struct(F.lit(1).alias("kind"), F.lit("").alias("at"), "line").alias("ord"), none.alias("backlinks"))
    kept = files.where(F.col("path").startswith(raw + "/") & ~F.element_at(F.split("path", "/"), -1).startswith("."))
    base = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(base, r"^.+\.([^.]+)$", 1))
    source = kept.select(F.concat(F.lit("source:"), F.substr(F.regexp_replace("path", r"(?<=[^/])\.[^./]+$", ""), F.lit(len(raw) + 2))).alias("id"), F.lit("source").alias("type"), base.alias("name"), "path", F.array(F.lit("raw"), F.when(ext == "", "unknown").otherwise(ext)).alias("tags"), F.lit("simple").alias("complexity"), F.struct(F.lit(2).alias("kind"), F.col("path").alias("at"), F.lit(0).alias("line")).alias("ord"), none.alias("backlinks"))
    return {"nodes": reduce(DataFrame.unionByName, (shown, topic, source)), "edges": edges, "unresolved": met.where("page is null").select("path", "target")}


def placed_children(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, article`` of entities and claims (nodes: ``id, type, name, content, ord``; edges: ``source, target, ord``): the first article an edge ties it to; else the one
    that its id names; else the first whose bare name holds the id's stem, or is held by it; else the first whose name, or (from three characters on) content, holds its name, in any case."""
    # each step begins from what is written, as the next ones look at it many times
    spark = nodes.sparkSession
    nodes = cut(spark, nodes.select("id", "type", "name", "content", "ord"))
    children, articles = nodes.where("type in ('entity', 'claim')"), nodes.where("type = 'article'")
    both = edges.select(F.col("source").alias("a"), F.col("target").alias("b"), "ord").unionByName(edges.select(F.col("target").alias("a"), F.col("source").alias("b"), "ord"))
    tied = both.join(articles.select(F.col("id").alias("a")), "a", "left_semi").join(children.select(F.col("id").alias("b")), "b", "left_semi").groupBy(F.col("b").alias("id")).agg(F.min_by("a", "ord").alias("article"))
    tied = cut(spark, tied)
    bare = F.when(F.col("id").contains("/"), F.element_at(F.split("id", "/"), -1)).otherwise(F.replace(F.col("id"), F.lit("article:"), F.lit("")))
    bares = cut(spark, nodes.where(F.col("id").startswith("article:")).groupBy(bare.alias("bare")).agg(F.min("ord").alias("ord"), F.max_by("id", "ord").alias("article")))
    raw = F.when(F.col("id").contains(":"), F.regexp_replace("id", "^[^:]*:", "")).otherwise(F.col("id"))
    left = children.join(tied, "id", "left_anti").select("id", "name", F.split(raw, ":")[0].alias("stem"))
    exact = cut(spark, left.join(bares, F.col("stem") == F.col("bare")).select("id", "article"))
    left = cut(spark, left.join(exact, "id", "left_anti"))
    stems = left.where("stem != ''").select("stem").distinct()
    up = containing(stems.select(F.col("stem").alias("pattern_id"), F.col("stem").alias("pattern")), bares.select(F.col("bare").alias("text_id"), F.col("bare").alias("text"))).select(F.col("pattern_id").alias("stem"), F.col("text_id").alias("bare"))
    down = containing(bares.where("bare != ''").select(F.col("bare").alias("pattern_id"), F.col("bare").alias("pattern")), stems.select(F.col("stem").alias("text_id"), F.col("stem").alias("text"))).select(F.col("text_id").alias("stem"), F.col("pattern_id").alias("bare"))
    near = left.join(up.unionByName(down).join(bares, "bare").groupBy("stem").agg(F.min_by("article", "ord").alias("article")), "stem").select("id", "article")
    near = cut(spark, near)
    left = cut(spark, left.join(near, "id", "left_anti").where("name != ''").select("id", F.lower("name").alias("low")))
    lows = left.select("low").distinct()
    asked = lambda df: df.select(F.col("low").alias("pattern_id"), F.col("low").alias("pattern"))
    inside = nodes.where(F.col("id").startswith("article:")).select(F.col("id").alias("text_id"), F.lower("name").alias("text"), F.lower("content").alias("content"), "ord")
    hits = containing(asked(lows), inside.select("text_id", "text").where("text is not null")).unionByName(containing(asked(lows.where(F.length("low") >= 3)), inside.select("text_id", F.col("content").alias("text")).where("text is not null")))
    named = left.join(hits.select(F.col("pattern_id").alias("low"), "text_id").join(inside.select("text_id", "ord"), "text_id").groupBy("low").agg(F.min_by("text_id", "ord").alias("article")), "low").select("id", "article")
    return reduce(DataFrame.unionByName, (tied, exact, near, named))


def wiki_layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``layer_id, node_id`` of a wiki's graph: each topic with its articles (an article in every topic that files it) and the children of those whose last topic it is; all other nodes are Other."""
    topics = nodes.where("type = 'topic'").select(F.col("id").alias("topic"), F.col("ord").alias("place"))
    filed = edges.where("type = 'categorized_under'").select(F.col("source").alias("node_id"), F.col("target").alias("topic")).join(topics, "topic").unionByName(topics.select(F.col("topic").alias("node_id"), "topic", "place"), True).distinct()
    last = filed.groupBy("node_id").agg(F.max_by("topic", "place").alias("topic"))
    children = placed_children(nodes, edges).join(last.withColumnRenamed("node_id", "article"), "article").select(F.col("id").alias("node_id"), "topic")
    layer = F.concat(F.lit("layer:"), F.regexp_replace("topic", "^topic:", "")).alias("layer_id")
    placed = filed.select("node_id", "topic").unionByName(children).select(layer, "node_id").distinct()
    rest = nodes.select(F.col("id").alias("node_id")).join(placed.select("node_id"), "node_id", "left_anti")
    return placed.unionByName(rest.select(F.lit("layer:other").alias("layer_id"), "node_id"))


#: Kinds of nodes that answers about wikis name otherwise.
NODE_NAMES = {kind: v.NODE_ALIASES[kind] + v.OTHER_NODE_ALIASES.get(kind, []) for kind in v.NODE_TYPES["knowledge"]}
# fixed values: kinds of edges that such answers name otherwise
EDGE_NAMES = {
    "cites": ["references", "cites_source"],
    "contradicts": ["conflicts_with", "disagrees_with"],
    "builds_on": ["refines", "elaborates"],
    "exemplifies": ["illustrates", "instance_of", "example_of"],
    "categorized_under": ["belongs_to", "tagged_with"],
    "authored_by": ["written_by", "created_by"],
    "related": ["relates_to", "related_to"],
}


def merged_answers(base_nodes: DataFrame, base_edges: DataFrame, nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """A wiki's nodes (``id, type, name``) and edges (``source, target, type, weight``) with those of answers about it, which come in batches (``batch, ord`` and these columns).

    Nodes of unknown kinds are dropped, of equal ids the last stays.  Of entities whose names differ in case and blanks alone the first stays,
    and edges of its batch and later ones follow to it.  Edges of unknown kinds are ``related``; an edge whose end no batch up to its own has
    brought is dropped; of equal edges the first stays.  Also a ``report``: ``what, n``.
    """
    spark = nodes.sparkSession
    kinds = [t for family, types in v.NODE_TYPES.items() if family != "design" for t in types]
    links = [t for category, types in v.EDGE_CATEGORIES.items() if category != "design" for t in types]
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    place = F.struct("batch", "ord")
    known = cut(spark, nodes.withColumn("type", lookup(low("type"), NODE_NAMES, default=low("type"))).where(F.col("type").isin(kinds)))
    name = F.regexp_replace(low("name"), r"\s+", " ")
    entities = known.where("type = 'entity'").withColumn("key", name)
    first = entities.groupBy("key").agg(F.min_by("id", place).alias("new"), F.min(place).alias("at"))
    told = cut(spark, entities.join(first, "key").select("batch", "ord", "id", "new", (place == F.col("at")).alias("first")))
    kept = known.join(told.where("not first").select("batch", "ord"), ["batch", "ord"], "left_anti").select("batch", "ord", "id", "type", "name")
    every = base_nodes.select(F.lit(-1).alias("batch"), F.lit(0).cast("long").alias("ord"), "id", "type", "name").unionByName(kept)
    last = cut(spark, every.groupBy("id").agg(F.max_by(F.struct("type", "name"), place).alias("r"), F.min("batch").alias("since")))
    remap = told.where("not first").select(F.col("id").alias("old"), "new", F.col("batch").alias("b"), F.col("ord").alias("o"))
    kind = lookup(low("type"), EDGE_NAMES, default=low("type"))
    rows = edges.select("batch", "ord", "source", "target", F.when(kind.isin(links), kind).otherwise("related").alias("type"), F.coalesce("weight", F.lit(0.5)).alias("weight"))
    for end in ("source", "target"):
        # the last word of the batches up to the edge's own
        met = rows.join(remap, (F.col("old") == F.col(end)) & (F.col("b") <= F.col("batch")), "left")
        to = F.coalesce(F.max_by("new", F.when(F.col("new").isNotNull(), F.struct("b", "o"))), F.first(end)).alias(f"__{end}")
        others = [c for c in ("source", "target", "type", "weight") if c != end]
        rows = met.groupBy("batch", "ord").agg(to, *(F.first(c).alias(c) for c in others)).withColumnRenamed(f"__{end}", end)
    rows = cut(spark, rows)
    for end in ("source", "target"):
        rows = rows.join(last.select(F.col("id").alias(end), F.col("since").alias(f"{end}_since")), end, "left")
    whole = F.coalesce((F.col("source_since") <= F.col("batch")) & (F.col("target_since") <= F.col("batch")), F.lit(False))
    rows = cut(spark, rows.withColumn("whole", whole))
    numbered_base = base_edges.select("source", "target", "type", "weight", F.struct(F.lit(-1).alias("batch"), F.lit(0).cast("long").alias("ord")).alias("at"))
    both = numbered_base.unionByName(rows.where("whole").select("source", "target", "type", "weight", place.alias("at")))
    final = both.groupBy("source", "target", "type").agg(F.min_by("weight", "at").alias("weight"))
    count = lambda what, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    report = [count("new entities", told.where("first")), count("same entities", told.where("not first")), count("new claims", known.where("type = 'claim'")), count("dropped edges", rows.where("not whole")), count("unknown kinds of nodes", nodes.where(~lookup(low("type"), NODE_NAMES, default=low("type")).isin(kinds)))]
    return {"nodes": last.select("id", "r.type", "r.name"), "edges": final, "report": reduce(DataFrame.unionByName, report)}
