"""Communities by modularity (Louvain): local moving in parallel, then the same on the contracted graph.

Edges count once in either direction, loops not at all; isolated nodes stay alone.  In a round
every node that may have a reason looks for the neighbouring community of greatest gain (the smallest name on
a tie).  Of all moves that are wanted at once, a set is carried out that surely gains:

* A community either takes nodes in or lets nodes go in a round.  Each wanted move has a hash of its own; what the least hash at a
  community asks for is what the community does.
* Moves into, and out of, one community stand in the order of 16 ranges of their hashes.  A move is
  carried out if it gains even with the weight of all moves up to its own range added to its goal and taken from its
  origin, or if it is the first of both.  Ties between nodes that move together only add to that.

So the modularity rises in every round that moves a node, the move of least hash is always carried out, and no cap on
rounds is needed.  After a round that moved few only their neighbours, and nodes whose move had to wait, look again; when none is left all nodes
look once more.  A level ends when none of them wants to move, or before, when a round carries out less than a third of what is wanted: then communities
are too small to tell where a node belongs, and go on faster as wholes.  What a level put together wrongly no higher one can part, and with it
communities are tied that should not be; so after every level single nodes look again from where they are, before the next is built.  At the end no
node and no community gains by moving.

Nodes are numbered in the order of their names.  Rounds are aggregations and joins; no neighbourhood or community is collected in one task: the ties of a
node of great weight are dealt by their communities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.loops import cut, held, numbered

#: Ranges of hashes within which moves into or out of one community are summed.
RANGES = 16
#: Gains (in edges) that are no more than rounding.
LEAST = 1e-7
#: A level ends early when a round carries out less than one in so many of the moves that are wanted.
STALL = 3
#: Only neighbours look again when a round moves less than one in so many nodes.
FEW_MOVED = 256
#: Weight of ties, about, that one task adds up for a node.
HUB = 1 << 16


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``modularity`` of communities (``id, container``) under edges counted once in either direction, without loops."""
    both = _both(edges, labels.select("id")).where("s != t")
    s = labels.select(F.col("id").alias("s"), F.col("container").alias("cs"))
    t = labels.select(F.col("id").alias("t"), F.col("container").alias("ct"))
    inside = F.sum(F.when(F.col("cs") == F.col("ct"), F.col("w")).otherwise(0.0))
    per = both.join(s, "s").join(t, "t").groupBy("cs").agg(inside.alias("inside"), F.sum("w").alias("all"))
    # sums of squares and of weights, so one pass tells the share of each against the total
    sums = per.agg(F.sum("inside").alias("i"), F.sum(F.col("all") * F.col("all")).alias("q"), F.sum("all").alias("m"))
    return sums.select((F.col("i") / F.col("m") - F.col("q") / (F.col("m") * F.col("m"))).alias("modularity"))


def _directed(edges: DataFrame) -> DataFrame:
    """``s, t, w``: both directions of every pair of nodes that an edge joins."""
    pairs = edges.where("source != target").select(F.least("source", "target").alias("s"), F.greatest("source", "target").alias("t")).distinct()
    there, back = F.struct("s", "t", F.lit(1.0).alias("w")), F.struct(F.col("t").alias("s"), F.col("s").alias("t"), F.lit(1.0).alias("w"))
    return pairs.select(F.inline(F.array(there, back)))


def _both(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``s, t, w``: both directions of every pair of known nodes that an edge joins."""
    known = nodes.select("id").distinct()
    return _directed(edges.join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi"))


def _tied(both: DataFrame, labels: DataFrame) -> DataFrame:
    """``s, t, w, k``: ties between different nodes, with the weight of the first."""
    return both.where("s != t").join(held(labels.select(F.col("id").alias("s"), "k")), "s").select("s", "t", "w", "k")


def _wanted(ties: DataFrame, look: DataFrame | None, labels: DataFrame, total: float, turn: int) -> DataFrame:
    """``id, k, own, goal, gain, hash``: the best move of each node that looks (all without ``look``), if it gains."""
    near = ties if look is None else ties.join(look.withColumnRenamed("id", "s"), "s", "left_semi")
    now = labels.join(labels.groupBy("container").agg(F.sum("k").alias("all")), "container")
    seen = near.join(held(now.select(F.col("id").alias("t"), "container", "all")), "t").select("s", "k", "container", "all", "w", F.lit(False).alias("home"))
    # a node without ties inside its community still leaves its weight behind
    own = now.select(F.col("id").alias("s"), "k", "container", "all", F.lit(0.0).alias("w"), F.lit(True).alias("home"))
    dealt = seen.unionByName(own).withColumn("part", F.pmod(F.xxhash64("container"), F.ceil(F.col("k") / HUB))).repartition("s", "part")
    met = dealt.groupBy("s", "part", "container").agg(F.sum("w").alias("w"), F.max("home").alias("home"), F.first("k").alias("k"), F.first("all").alias("all"))
    value = F.col("w") - F.col("k") * (F.col("all") - F.when(F.col("home"), F.col("k")).otherwise(0.0)) / (2 * total)
    # the greatest value, and of equal ones the smallest name
    first = F.min(F.when(~F.col("home"), F.struct((-F.round(value, 9)).alias("value"), F.col("container").alias("goal"))))
    per = met.groupBy("s", "part").agg(first.alias("best"), F.max(F.when(F.col("home"), value)).alias("stay"), F.max(F.when(F.col("home"), F.col("container"))).alias("own"), F.first("k").alias("k"))
    per = per.groupBy(F.col("s").alias("id")).agg(F.min("best").alias("best"), F.max("stay").alias("stay"), F.max("own").alias("own"), F.first("k").alias("k")).where("best is not null")
    moves = per.select("id", "k", "own", F.col("best.goal").alias("goal"), (-F.col("best.value") - F.col("stay")).alias("gain"), F.xxhash64("id", F.lit(turn)).alias("hash"))
    return moves.where(F.col("gain") > LEAST)


def _carried(moves: DataFrame, total: float) -> DataFrame:
    """``id, goal`` of the moves that are carried out together."""
    out = moves.select(F.col("own").alias("c"), F.lit(True).alias("leaves"), "k", "hash")
    into = moves.select(F.col("goal").alias("c"), F.lit(False).alias("leaves"), "k", "hash")
    span = F.shiftright("hash", 65 - RANGES.bit_length()).alias("span")
    spans = out.unionByName(into).groupBy("c", "leaves", span).agg(F.sum("k").alias("k"), F.min("hash").alias("first"))
    # at most 2 * RANGES rows a community
    upto = Window.partitionBy("c", "leaves").orderBy("span")
    every = Window.partitionBy("c", "leaves")
    spans = spans.select("c", "leaves", "span", F.sum("k").over(upto).alias("upto"), F.min("first").over(every).alias("first"))
    role = spans.groupBy("c").agg(F.min(F.struct("first", "leaves"))["leaves"].alias("lets"))
    told = spans.join(role, "c").where("leaves = lets")
    side = lambda leaves, name, n: told.where(F.col("leaves") == leaves).select(F.col("c").alias(name), "span", F.col("upto").alias(f"k{n}"), F.col("first").alias(f"f{n}"))
    met = moves.withColumn("span", span).join(side(True, "own", 0), ["own", "span"]).join(side(False, "goal", 1), ["goal", "span"])
    first = (F.col("hash") == F.col("f0")) & (F.col("hash") == F.col("f1"))
    sure = F.col("gain") > F.col("k") * (F.col("k0") + F.col("k1") - 2 * F.col("k")) / (2 * total) + LEAST
    return met.where(first | sure).select("id", "goal")


def _rounds(ties: DataFrame, labels: DataFrame, total: float, early: bool) -> tuple[DataFrame, bool]:
    """``id, k, container`` after rounds of moves, and whether no node wants to move any more; ``early`` ends when most moves have to wait."""
    spark, nodes = ties.sparkSession, labels.count()
    look, turn = None, 0
    while True:
        wanted = cut(spark, _wanted(ties, look, labels, total, turn))
        wants = wanted.count()
        if not wants:
            if look is None:
                return labels, True
            look = None
            continue
        told = labels.join(_carried(wanted, total), "id", "left")
        told = cut(spark, told.select("id", "k", F.coalesce("goal", "container").alias("container"), F.col("goal").isNotNull().alias("moved")))
        labels, moved = told.drop("moved"), told.where("moved").select(F.col("id").alias("s"))
        moves = moved.count()
        if early and moves * STALL < wants:
            return labels, False
        look = None
        if moves * FEW_MOVED < nodes:
            look = cut(spark, ties.join(moved, "s", "left_semi").select(F.col("t").alias("id")).unionByName(wanted.select("id")).distinct())
        turn += 1


def _moved(both: DataFrame, labels: DataFrame, total: float) -> DataFrame:
    """``id, k, container`` of a weighted graph given in both directions (``s, t, w``) and of its nodes' communities so far, after all moves that gain."""
    return _rounds(cut(both.sparkSession, _tied(both, labels)), labels, total, False)[0]


def _single(both: DataFrame) -> DataFrame:
    """``id, k, container``: every node alone."""
    return cut(both.sparkSession, both.groupBy(F.col("s").alias("id")).agg(F.sum("w").alias("k")).withColumn("container", F.col("id")))


def _raised(both: DataFrame, labels: DataFrame, total: float) -> DataFrame | None:
    """``id, k, container`` after communities have moved as wholes, one level; nothing if none of them moves."""
    spark = both.sparkSession
    a, b = labels.select(F.col("id").alias("s"), F.col("container").alias("cs")), labels.select(F.col("id").alias("t"), F.col("container").alias("ct"))
    packed = cut(spark, both.join(held(a), "s").join(held(b), "t").groupBy(F.col("cs").alias("s"), F.col("ct").alias("t")).agg(F.sum("w").alias("w")))
    alone = _single(packed)
    found = _rounds(cut(spark, _tied(packed, alone)), alone, total, True)[0]
    if found.where("id != container").isEmpty():
        return None
    return cut(spark, labels.join(found.select(F.col("id").alias("container"), F.col("container").alias("new")), "container").select("id", "k", F.col("new").alias("container")))


def communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, container``: a community's name is one of its members' ids."""
    spark = nodes.sparkSession
    names = cut(spark, numbered(nodes.select("id").distinct(), [F.col("id")], "n"))
    name = lambda end, n: held(names.select(F.col("id").alias(end), F.col("n").alias(n)))
    known = edges.where("source != target").select("source", "target").join(name("source", "a"), "source").join(name("target", "b"), "target")
    both = cut(spark, _directed(known.select(F.col("a").alias("source"), F.col("b").alias("target"))))
    total = (both.agg(F.sum("w")).first()[0] or 0.0) / 2
    labels = _single(both)
    if total:
        ties = cut(spark, _tied(both, labels))
        labels, settled = _rounds(ties, labels, total, True)
        while (raised := _raised(ties, labels, total)) is not None or not settled:
            # where no community moves as a whole, ending early would help nothing
            labels, settled = _rounds(ties, labels if raised is None else raised, total, raised is not None)
    found = labels.select(F.col("id").alias("n"), F.col("container").alias("c"))
    found = names.join(found, "n", "left").join(names.select(F.col("n").alias("c"), F.col("id").alias("container")), "c", "left")
    return found.select("id", F.coalesce("container", "id").alias("container"))
