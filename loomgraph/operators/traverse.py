"""Traversals: chains are jumped over by pointer doubling, what is left is walked by frontiers.

A node through which a walk can only pass on (one way in and one way out, apart from turning
back) is passed in no round of its own: every edge that begins at such a node points back to the one edge that leads there, and
pointers are doubled until they reach an edge from elsewhere.  So a chain of n nodes
takes log2(n) rounds, and becomes one edge as long as the chain.  The frontier then goes over these
edges and keeps what is nearer than before; it is empty when all nodes have their depth.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.loops import SENT, Grown, cut, dealt, numbered


def _passages(arcs: DataFrame, ends: DataFrame, turns: bool) -> DataFrame:
    """``id, before, other``: nodes that a walk only passes, and the one or two that it may come from (two where it may go either way, if turns); never the given ends."""
    null = F.lit(None).cast("string")
    per = (
        arcs.select(F.col("v").alias("id"), F.col("u").alias("i"), null.alias("o"))
        .unionByName(arcs.select(F.col("u").alias("id"), null.alias("i"), F.col("v").alias("o")))
        .groupBy("id")
        .agg(F.count("i").alias("ins"), F.count("o").alias("outs"), F.min("i").alias("before"), F.max("i").alias("other"), F.min("o").alias("after"), F.max("o").alias("last"))
    )
    one_way = "ins = 1 and outs = 1 and before != after"
    both_ways = "ins = 2 and outs = 2 and before = after and other = last"
    return per.where(f"({one_way}) or ({both_ways})" if turns else one_way).select("id", "before", "other").join(ends, "id", "left_anti")


def _jumped(arcs: DataFrame, ends: DataFrame, longest: bool = False) -> DataFrame:
    """``u, v, w``: the edges from nodes that are more than passages, to every node that a walk then only passes, and their lengths; of several the shortest, or the longest (of edges in one direction)."""
    spark = arcs.sparkSession
    via = cut(spark, _passages(arcs, ends, not longest))
    passed = via.count()
    if not passed:
        return arcs.withColumn("w", F.lit(1).cast("long"))
    if passed > SENT:
        via = dealt(via)
    met = arcs.join(via.withColumnRenamed("id", "u"), "u", "left")
    came = F.when(F.col("before") != F.col("v"), F.col("before")).otherwise(F.col("other"))
    # an edge whose tail is a passage points to the edge before it (pu, pv = its tail); any other is at its root
    state = met.select("u", "v", F.when(F.col("before").isNull(), F.col("u")).alias("root"), came.alias("pu"), F.when(F.col("before").isNotNull(), F.col("u")).alias("pv"), F.lit(1).cast("long").alias("w"))
    made = Grown(state)
    open_ = made.all().where("root is null")
    left = open_.count()
    while left:
        # what can be pointed at: edges that lead to passages, at their roots or on their way
        done = made.all().where("root is not null").join(via.select(F.col("id").alias("v")), "v", "left_semi").select(*state.columns)
        at = done.unionByName(open_).select(F.col("u").alias("pu"), F.col("v").alias("pv"), "root", F.col("pu").alias("qu"), F.col("pv").alias("qv"), F.col("w").alias("more"))
        step = open_.drop("root").join(dealt(at), ["pu", "pv"]).select("u", "v", "root", F.col("qu").alias("pu"), F.col("qv").alias("pv"), (F.col("w") + F.col("more")).alias("w"))
        open_ = made.add(step, lambda df: df.where("root is not null")).where("root is null")
        before, left = left, open_.count()
        if left == before:  # doubling ends every chain in time: these are rings that nothing leads into
            break
    done = made.all().where("root is not null")
    return done.select(F.col("root").alias("u"), "v", "w").groupBy("u", "v").agg((F.max("w") if longest else F.min("w")).alias("w"))


def distances(arcs: DataFrame, start: DataFrame, end: str | None = None) -> DataFrame:
    """``id, depth`` along arcs ``u, v`` (distinct, no loops) from ``start.id``; with an end, all that are no farther than it (others may be left out)."""
    spark = arcs.sparkSession
    seeds = cut(spark, start.select("id").distinct())
    ends = seeds if end is None else seeds.unionByName(spark.createDataFrame([(end,)], "id string"))
    edges = cut(spark, _jumped(arcs, ends))
    nearest = lambda df: df.groupBy("id").agg(F.min("depth").alias("depth"))
    known = Grown(seeds.withColumn("depth", F.lit(0).cast("long")))
    frontier = known.all()
    while True:
        step = nearest(edges.join(frontier.withColumnRenamed("id", "u"), "u").select(F.col("v").alias("id"), (F.col("depth") + F.col("w")).alias("depth")))
        better = step.join(dealt(nearest(known.all()).withColumnRenamed("depth", "was")), "id", "left").where("was is null or depth < was")
        frontier = known.add(better, nearest)
        least, n = frontier.agg(F.min("depth"), F.count(F.lit(1))).first()
        if n > SENT:
            frontier = dealt(frontier)
        if least is None:
            break
        if end is not None:
            reached = known.all().where(F.col("id") == end).agg(F.min("depth")).first()[0]
            if reached is not None and reached <= least:
                break
    return nearest(known.all())


def bfs_depth(edges: DataFrame, start: DataFrame) -> DataFrame:
    """``id, depth`` along directed edges from ``start.id``."""
    spark = edges.sparkSession
    arcs = cut(spark, edges.select(F.col("source").alias("u"), F.col("target").alias("v")).where("u != v").distinct())
    return distances(arcs, start).withColumn("depth", F.col("depth").cast("int"))


def shortest_path(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``pos, id`` of the path that a first-in first-out search finds, edges taken in order and in either direction; empty if there is none.

    That path is, of all shortest ones, the one whose edges come first, compared from its beginning on.  So depths from both ends
    tell the edges of shortest paths, each node keeps its first one, and the path is followed by doubling steps.
    """
    spark = edges.sparkSession
    none = spark.createDataFrame([], "pos int, id string")
    both = edges.select(F.col("source").alias("u"), F.col("target").alias("v"), (F.col("ord") * 2).alias("at")).unionByName(edges.select(F.col("target").alias("u"), F.col("source").alias("v"), (F.col("ord") * 2 + 1).alias("at")))
    both = cut(spark, both.where("u != v").groupBy("u", "v").agg(F.min("at").alias("at")))
    if a == b:
        return none
    arcs = both.select("u", "v")
    there = cut(spark, distances(arcs, spark.createDataFrame([(a,)], "id string"), b))
    far = there.where(F.col("id") == b).first()
    if far is None:
        return none
    back = distances(arcs, spark.createDataFrame([(b,)], "id string"), a).withColumnRenamed("depth", "left")
    on = cut(spark, there.join(back, "id").where(F.col("depth") + F.col("left") == far.depth).select("id", "depth"))
    ways = both.join(on.select(F.col("id").alias("u"), F.col("depth").alias("du")), "u").join(on.select(F.col("id").alias("v"), F.col("depth").alias("dv")), "v").where("dv = du + 1")
    jump = cut(spark, ways.groupBy("u").agg(F.min_by("v", "at").alias("v")))
    path, steps = cut(spark, on.where(F.col("id") == a)), 1
    while steps <= far.depth:  # the nodes within twice as many steps of the beginning
        ahead = path.select(F.col("id").alias("u")).join(jump, "u").select(F.col("v").alias("id")).join(on, "id")
        path = cut(spark, path.unionByName(ahead))
        steps *= 2
        if steps <= far.depth:
            jump = cut(spark, jump.join(jump.select(F.col("u").alias("v"), F.col("v").alias("w")), "v").select("u", F.col("w").alias("v")))
    return path.select(F.col("depth").cast("int").alias("pos"), "id")


def longest_depths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, level``: the longest way to each node from where no edge leads, as Kahn's order by levels has it; -1 on cycles and after them.

    A round takes a level of what is left when chains are jumped over, so it is for long graphs what ``topological_levels`` is for flat ones; it gives no order within a level.
    """
    spark = nodes.sparkSession
    ids = cut(spark, nodes.select("id").distinct())
    known = edges.select(F.col("source").alias("u"), F.col("target").alias("v")).join(dealt(ids.withColumnRenamed("id", "u")), "u", "left_semi").join(dealt(ids.withColumnRenamed("id", "v")), "v", "left_semi")
    arcs = cut(spark, known.distinct())
    loops = arcs.where("u = v").select(F.col("u").alias("id"))
    jumps = cut(spark, _jumped(arcs.where("u != v"), dealt(loops), longest=True))
    degree = jumps.groupBy(F.col("v").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    # a node that edges lead to, but no jump, is in a ring of passages; it is never free, and neither is one that leads to itself
    led = arcs.groupBy(F.col("v").alias("id")).agg(F.max((F.col("u") == F.col("v")).cast("int")).alias("own"))
    never = F.lit(1 << 40)
    first = ids.join(dealt(degree), "id", "left").join(dealt(led), "id", "left").select("id", F.when(F.col("own") == 1, never).when(F.col("n").isNull() & F.col("own").isNotNull(), never).otherwise(F.coalesce("n", F.lit(0))).alias("n"), F.lit(0).cast("long").alias("level"))
    left, done = cut(spark, first), None
    while True:
        ready = left.where("n = 0").select("id", "level")
        if done is None:
            done = Grown(ready)
            level = done.all()
        else:
            level = done.add(ready)
        if level.isEmpty():
            break
        freed = dealt(jumps).join(level.withColumnRenamed("id", "u"), "u").groupBy(F.col("v").alias("id")).agg(F.count(F.lit(1)).alias("m"), F.max(F.col("level") + F.col("w")).alias("late"))
        left = cut(spark, left.where("n > 0").join(dealt(freed), "id", "left").select("id", (F.col("n") - F.coalesce("m", F.lit(0))).alias("n"), F.greatest("level", F.coalesce("late", F.lit(0))).alias("level")))
    return done.all().unionByName(left.select("id", F.lit(-1).cast("long").alias("level")))


def topological_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, level, pos``: Kahn's order by levels; nodes on cycles come last, level -1, in node order."""
    spark = nodes.sparkSession
    ids = nodes.select("id", "ord")
    e = edges.join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi").select("source", "target", "ord")
    e = cut(spark, e)
    degree = e.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    left = cut(spark, ids.join(degree, "id", "left").fillna(0, ["n"]).select("id", "ord", "n", F.lit(None).cast("struct<pos:bigint,at:bigint>").alias("last")))
    done, offset = None, 0
    for k in count():
        ready = left.where("n = 0")
        order = [F.col("last").asc_nulls_first(), F.col("ord")]
        rows = numbered(ready, order, "pos", offset).select("id", F.lit(k).alias("level"), "pos")
        level = Grown(rows) if done is None else done.add(rows)
        done, level = (level, level.all()) if done is None else (done, level)
        size = level.count()
        if not size:
            break
        offset += size
        freed = e.join(level.select(F.col("id").alias("source"), "pos"), "source").groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("m"), F.max(F.struct("pos", F.col("ord").alias("at"))).alias("late"))
        left = left.where("n > 0").join(freed, "id", "left").select("id", "ord", (F.col("n") - F.coalesce("m", F.lit(0))).alias("n"), F.when(F.col("late").isNull(), F.col("last")).otherwise(F.greatest("late", F.coalesce("last", "late"))).alias("last"))
        left = cut(spark, left)
    rest = numbered(left.select("id", "ord"), [F.col("ord")], "pos", offset).select("id", F.lit(-1).alias("level"), "pos")
    return done.all().unionByName(rest)


def coupling_clusters(pairs: DataFrame, links: DataFrame, largest: int = 5) -> DataFrame:
    """``cluster, id``: mutual pairs, grown by nodes tied to two members or more, up to a size."""
    spark = pairs.sparkSession
    name = F.concat_ws("|", "a", "b")
    members = cut(spark, pairs.select(name.alias("cluster"), F.explode(F.array("a", "b")).alias("id")))
    both = links.select(F.col("source").alias("id"), F.col("target").alias("other")).unionByName(links.select(F.col("target").alias("id"), F.col("source").alias("other"))).distinct()
    while True:  # ends when no cluster has room or ties left
        tied = both.join(members, "id").groupBy("cluster", F.col("other").alias("id")).agg(F.count_distinct(both.id).alias("n")).where("n >= 2")
        new = tied.join(members, ["cluster", "id"], "left_anti")
        room = members.groupBy("cluster").agg((F.lit(largest) - F.count(F.lit(1))).alias("room")).where("room > 0")
        rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "id"))
        grown = cut(spark, new.join(room, "cluster").withColumn("rank", rank).where("rank <= room").select("cluster", "id"))
        if grown.isEmpty():
            break
        members = cut(spark, members.unionByName(grown))
    return members
