"""Mixing sources to target weights by a low-discrepancy schedule.

Each source has blocks of its own length: a SLOTS-th of all targets, or a SHARE-th of its target where that is less (one
word at least).  Slots are dealt to sources: the slot's golden-ratio point (a Weyl sequence in 32-bit integers) falls into
one source's stretch of the cumulative weights, which are the numbers of blocks that sources need (SHARE at least).  A
source's slots are ranked; its k-th slot takes the k-th of its shuffled equal-token blocks, again from the first when all
are used, and its last one the words that are left of its target.  So each source takes its rounded target, at any size of
the input.  Half as many slots again as are needed outlast the sequence's discrepancy, which grows
with the logarithm of their number while a stretch's surplus is SHARE / 2 slots or more.  DataFrame functions only.

Defined cases: a null text or one without words has size 0 and nothing is taken of
it; a null source is a source of its own, last in the order; repeated rows (equal
doc_id) are shuffled by hashes of id and text and count once each; an empty table or one
without any word gives targets and takes of 0; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read

#: Slots that all targets are cut into, about, and slots of a source's target, at least (where it has as many words).
SLOTS, SHARE = 1 << 17, 64
#: The golden ratio's fraction times 2**32.
GOLDEN = 2654435769
WEIGHTS = (5, 2, 1)
MOST = 3
#: Rows of a source in a stretch of its shuffled order, about.
STRETCH = 4096
#: Stretches of a source, at most (a count for each is kept).
STRETCHES = 1 << 20


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """``source, source_size, source_rows, target, goal, block, blocks, need, low, high, slots``.

    The level at which capped weights share all words, blocks, and stretches of 2**32.
    One row a source: the windows below order the sources, not the documents.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("k", F.row_number().over(ordered) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("k") % len(WEIGHTS) + 1).cast("int")).cast("long")
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * MOST)
    everything = Window.partitionBy(F.lit(1))
    by_level = Window.orderBy((F.col("cap") / F.col("weight")), "k")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("sharing", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.col("left") / F.col("sharing"))
        .withColumn("free", F.col("level") * F.col("weight") < F.col("cap"))
        .withColumn("water", F.min(F.when(F.col("free"), F.struct((F.col("cap") / F.col("weight")).alias("r"), "k", "level"))).over(everything)["level"])
    )
    target = F.when(F.col("total") == 0, F.lit(0.0)).otherwise(
        F.coalesce(F.least(F.col("cap").cast("double"), F.col("water") * F.col("weight")), F.col("cap").cast("double"))
    )
    per = per.withColumn("target", target).withColumn("goal", F.floor(F.col("target") + 0.5).cast("long"))
    per = per.withColumn("block", F.expr(f"greatest(1L, least(goal div {SHARE}, total div {SLOTS}))"))
    per = per.withColumn("blocks", F.expr("(source_size + block - 1) div block"))
    # whole epochs, then the blocks that hold what is left
    per = per.withColumn("need", F.expr("if(goal = 0, 0L, goal div source_size * blocks + (goal % source_size + block - 1) div block)"))
    per = per.withColumn("wide", F.when(F.col("need") > 0, F.greatest(F.col("need"), F.lit(SHARE))).otherwise(F.lit(0)).cast("long"))
    per = per.withColumn("all", F.sum("wide").over(everything)).withColumn("upto", F.sum("wide").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    per = per.withColumn("high", F.expr("if(all = 0, 0L, upto * 4294967296 div all)")).withColumn("low", F.expr("if(all = 0, 0L, (upto - wide) * 4294967296 div all)"))
    return per.select("source", "source_size", "source_rows", "target", "goal", "block", "blocks", "need", "low", "high", F.expr(f"(all * 3 div 2) + {SHARE}").alias("slots"))


def schedule(spark: SparkSession, targets: DataFrame) -> DataFrame:
    """``source, slot, block_id, epoch, words`` for every slot that takes something: the first ``words`` of the block."""
    t = targets.where("need > 0").drop("source_rows", "target")
    n = t.agg(F.max("slots")).first()[0] or 0
    slots = spark.range(n).select(F.col("id").alias("slot"), (F.col("id") * GOLDEN).bitwiseAND((1 << 32) - 1).alias("point"))
    # points and stretches meet in cells of 2**20, so the join is by equality
    cells = t.withColumn("cell", F.explode(F.sequence(F.shiftright("low", 20), F.shiftright(F.col("high") - 1, 20))))
    dealt = slots.withColumn("cell", F.shiftright("point", 20)).join(cells, "cell").where("point >= low and point < high")
    rank = F.row_number().over(Window.partitionBy("source").orderBy("slot")) - 1
    taking = dealt.withColumn("rank", rank.cast("long")).where("rank < need").selectExpr("source", "slot", "rank % blocks AS block_id", "rank div blocks AS epoch", "block", "source_size", "goal")
    words = "least(block, source_size - block_id * block, goal - epoch * source_size - block_id * block)"
    return taking.selectExpr("source", "slot", "block_id", "epoch", f"{words} AS words", "words = least(block, source_size - block_id * block) AS full")


def shuffled(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Each row's stretch ``[start, start + size)`` of its source's words, in the order of a hash of its id.

    A source is cut into stretches of hashes by its own number of rows, so a source with a third of all rows is
    summed in many tasks; only one sum a stretch is ordered within a source.
    """
    order = ["shuffle", "doc_id", "salt"]
    pieces = F.greatest(F.lit(1), F.least(F.lit(STRETCHES), F.ceil(F.col("source_rows") / STRETCH))).cast("long")
    t = targets.select(F.col("source").alias("t_source"), "source_size", "source_rows", "target", "block")
    df = sized.join(t, sized.source.eqNullSafe(t.t_source)).drop("t_source")
    df = df.withColumn("stretch", F.floor(F.conv(F.substring("shuffle", 1, 8), 16, 10).cast("long") * pieces / float(1 << 32)).cast("long"))
    sums = df.groupBy("source", "stretch").agg(F.sum("size").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("source").alias("s_source"), F.col("stretch").alias("s_stretch"), before.alias("before"))
    df = df.join(sums, df.source.eqNullSafe(sums.s_source) & (df.stretch == sums.s_stretch)).drop("s_source", "s_stretch")
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("source", "stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("start", F.col("before") + inside)


def taken_words(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, salt, source_size, target, taken``; one row for each of the input's."""
    spark = docs.sparkSession
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    sized = cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.md5(id_text.cast("binary")).alias("shuffle"), F.xxhash64("text").alias("salt")))
    targets = cut(source_targets(sized))
    placed = shuffled(sized, targets)
    # at most one slot of a source takes a part of its block
    times = schedule(spark, targets).groupBy("source", "block_id").agg(F.count_if("full").alias("times"), F.max(F.when(~F.col("full"), F.col("words"))).alias("part"))
    last = F.expr("(start + size - 1) div block")
    first = F.expr("start div block")
    # a row lies in size / block + 2 blocks at most: over all rows that is no more than rows and slots together
    ids = ["doc_id", "source", "size", "shuffle", "salt", "source_size", "target", "start"]
    pieces = placed.withColumn("block_id", F.explode(F.when(F.col("size") > 0, F.sequence(first, last)).otherwise(F.array(F.lit(-1).cast("long")))))
    t = times.select(F.col("source").alias("t_source"), F.col("block_id").alias("t_block"), "times", "part")
    met = pieces.join(t, pieces.source.eqNullSafe(t.t_source) & (pieces.block_id == t.t_block), "left")
    begin = F.greatest(F.col("start"), F.col("block_id") * F.col("block"))
    end = F.least(F.col("start") + F.col("size"), (F.col("block_id") + 1) * F.col("block"))
    partly = F.greatest(F.lit(0), F.least(end, F.col("block_id") * F.col("block") + F.coalesce("part", F.lit(0))) - begin)
    part = F.when(F.col("size") > 0, (end - begin) * F.coalesce("times", F.lit(0)) + partly).otherwise(F.lit(0))
    taken = met.groupBy(*ids).agg(F.sum(part).cast("long").alias("taken"), F.count(F.when(F.col("size") == 0, 1)).alias("empties"))
    # rows without words have no stretch of their own: equal ones meet in a group and part again
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), "empties")))).drop("empties", "copy", "start", "shuffle")


#: Rows of a group of repeated rows that are numbered in one task, about.
NUMBERED = 64


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix in whole documents: each is repeated as often as its taken words fill its size, rounded.

    Rows that repeat id, source and text share what their group takes, as evenly as whole rows allow.
    """
    taken = taken_words(docs)
    times = F.floor(F.col("taken") / F.greatest("size", F.lit(1)).cast("double") + 0.5).cast("int")
    per = taken.groupBy("doc_id", "source", "salt").agg(F.sum(times).cast("long").alias("__mix_times"), F.count(F.lit(1)).cast("long").alias("__mix_rows"))
    keys = per.select(F.col("doc_id").alias("__mix_id"), F.col("source").alias("__mix_source"), F.col("salt").alias("__mix_salt"), "__mix_times", "__mix_rows").where("__mix_times > 0")
    df = docs.withColumn("__mix_hash", F.xxhash64("text"))
    met = df.join(keys, df.doc_id.eqNullSafe(F.col("__mix_id")) & df.source.eqNullSafe(F.col("__mix_source")) & (F.col("__mix_hash") == F.col("__mix_salt")))
    own = docs.columns
    once = met.where("__mix_rows = 1").withColumn("__mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix_times")))).select(*own)
    again = met.where("__mix_rows > 1")
    if again.isEmpty():
        return once
    # rows that repeat are numbered in parts, and the parts are given their offsets
    group = ["__mix_id", "__mix_source", "__mix_salt", "__mix_part"]
    again = cut(again.withColumn("__mix_part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.ceil(F.col("__mix_rows") / float(NUMBERED))).cast("int")))
    sizes = again.groupBy(*group).agg(F.count(F.lit(1)).alias("__mix_n"))
    ahead = Window.partitionBy(*group[:3]).orderBy("__mix_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(c).alias(f"{c}_") for c in group], F.coalesce(F.sum("__mix_n").over(ahead), F.lit(0)).alias("__mix_ahead"))
    numbered = again.withColumn("__mix_row", F.row_number().over(Window.partitionBy(*group).orderBy("__mix_hash")) - 1)
    same = F.lit(True)
    for c in group:
        same = same & numbered[c].eqNullSafe(F.col(f"{c}_"))
    copies = F.expr("__mix_times div __mix_rows + if(__mix_ahead + __mix_row < __mix_times % __mix_rows, 1, 0)")
    numbered = numbered.join(offsets, same).withColumn("__mix_copies", copies).where("__mix_copies > 0")
    return once.unionByName(numbered.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix_copies")))).select(*own))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = taken_words(read(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return df.select("doc_id", "size", "source_size", "target", "taken")


_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS shuffle,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST(CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS weight, source_size * 3 AS cap,
         CAST(sum(source_size) OVER () AS BIGINT) AS total FROM per),
level AS (
  SELECT *, total - coalesce(CAST(sum(cap) OVER w AS BIGINT), 0) AS rest,
         CAST(sum(weight) OVER () AS BIGINT) - coalesce(CAST(sum(weight) OVER w AS BIGINT), 0) AS sharing
  FROM weighed WINDOW w AS (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (
  SELECT rest / sharing AS water FROM level WHERE rest / sharing * weight < cap ORDER BY cap / weight, k LIMIT 1),
targets AS (
  SELECT source, k, source_size, total,
         CASE WHEN total = 0 THEN 0.0::DOUBLE ELSE coalesce(least(cap::DOUBLE, (SELECT water FROM water) * weight), cap::DOUBLE) END AS target
  FROM level),
goals AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS goal FROM targets),
cut AS (SELECT *, greatest(1, least(goal // {SHARE}, CAST(total AS BIGINT) // {SLOTS})) AS block FROM goals),
need AS (
  SELECT *, CASE WHEN goal = 0 THEN 0 ELSE goal // source_size * ((source_size + block - 1) // block) + (goal % source_size + block - 1) // block END AS need,
         (source_size + block - 1) // block AS blocks FROM cut),
wide AS (SELECT *, CASE WHEN need > 0 THEN greatest(need, {SHARE}) ELSE 0 END AS wide FROM need),
summed AS (
  SELECT *, CAST(sum(wide) OVER () AS BIGINT) AS everything,
         CAST(sum(wide) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto FROM wide),
bounds AS (SELECT *, (upto - wide) * 4294967296 // greatest(everything, 1) AS low, upto * 4294967296 // greatest(everything, 1) AS high FROM summed),
points AS (SELECT i AS slot, (i * {GOLDEN}) % 4294967296 AS point FROM (SELECT unnest(range((SELECT max(everything) * 3 // 2 + {SHARE} FROM bounds))) AS i)),
ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.k ORDER BY slot) - 1 AS rank FROM points JOIN bounds b ON point >= low AND point < high WHERE need > 0),
dealt AS (
  SELECT k, rank % blocks AS block_id, least(block, source_size - (rank % blocks) * block) AS length,
         goal - (rank // blocks) * source_size - (rank % blocks) * block AS rest
  FROM ranked WHERE rank < need),
times AS (SELECT k, block_id, count(*) FILTER (rest >= length) AS times, coalesce(max(rest) FILTER (rest < length), 0) AS part FROM dealt GROUP BY ALL),
placed AS (
  SELECT s.*, b.k, b.source_size, b.target, b.block,
         coalesce(CAST(sum(size) OVER (PARTITION BY b.k ORDER BY shuffle, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start
  FROM sized s JOIN bounds b ON s.source IS NOT DISTINCT FROM b.source),
pieces AS (SELECT *, unnest(CASE WHEN size > 0 THEN range(start // block, (start + size - 1) // block + 1) ELSE [-1] END) AS block_id FROM placed)
SELECT doc_id, size, source_size, target,
       CAST(sum(CASE WHEN size > 0 THEN
         (least(start + size, (p.block_id + 1) * block) - greatest(start, p.block_id * block)) * coalesce(times, 0)
         + greatest(0, least(start + size, (p.block_id + 1) * block, p.block_id * block + coalesce(part, 0)) - greatest(start, p.block_id * block)) ELSE 0 END) AS BIGINT) AS taken
FROM pieces p LEFT JOIN times t ON p.k = t.k AND p.block_id = t.block_id
GROUP BY doc_id, size, source_size, target, start
"""
QUERIES = {"op9_source_mixing": op9_source_mixing}
ORACLE_SQL = {"op9_source_mixing": _SQL}
