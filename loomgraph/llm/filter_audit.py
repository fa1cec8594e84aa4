"""Filter interaction audit by a subset-zeta transform.

Each document gets a mask of the filters that it fails.  A part's documents are counted
once per mask; the zeta transform over subsets turns these counts into survivors of every
set of filters (the documents whose mask does not meet it), and a step of any order is the
difference between two neighbouring sets.  Counts of documents that a label marks go the same way.
So all orders cost one pass over the texts, and after it a row a part.

Equal texts are found by SHA-256.  Rows meet their labels by doc_id, then are counted by text,
part, mask and label, so a text that a third of all rows hold is a few rows before its smallest
doc_id is looked for.

Defined cases: a null text is an empty one; a null language is the part of the empty string; a
null doc_id has no label, and is neither larger nor smaller than another; rows of one doc_id are
counted row by row, and none of them makes the other a later copy; a doc_id with several labels counts as marked if any of them marks
it; labels of unknown documents play no part; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: Least number of words; least percentage of distinct ones; most upper-case letters in a hundred code points; characters of markup.
WORDS, DISTINCT, UPPER, MARKUP = 200, 50, 3, "[#$%&*|]"
FILTERS = "ABCDE"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_failures(text: Column, words: Column) -> dict[str, Column]:
    """The filters that look at one text, and what fails them; ``words`` is the array of its words."""
    upper = F.length(text) - F.length(F.translate(text, _UPPER, ""))
    return {
        "A": F.size(words) < WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < DISTINCT * F.size(words),
        "C": 100 * upper > UPPER * F.length(text),
        "D": text.rlike(MARKUP),
    }


def masked(docs: DataFrame) -> DataFrame:
    """``doc_id, part, digest, mask``: the bits of the filters that a row's text fails by itself."""
    text = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    split = text.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    fails = text_failures(F.col("text"), F.col("words"))
    bits = [F.when(c, 1 << FILTERS.index(f)).otherwise(0) for f, c in fails.items()]
    return split.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), sum(bits[1:], bits[0]).alias("mask"))


def mask_counts(rows: DataFrame, labels: DataFrame, copies: str = "E") -> DataFrame:
    """``part, mask, good, toxic, n`` of rows ``doc_id, part, digest, mask``, with the bit of later copies added."""
    mark = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(mark("quality"), mark("toxic"))
    told = rows.where("doc_id is not null").join(marks, "doc_id", "left").fillna(0, ["quality", "toxic"])
    per = told.groupBy("doc_id", "digest", "part", "mask", "quality", "toxic").agg(F.count(F.lit(1)).alias("n"))
    key = ["digest", "part", "mask", "quality", "toxic"]
    groups = per.groupBy(*key).agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("first"))
    least = groups.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    met = groups.join(least, "digest")
    firsts = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(F.lit(0))
    bit = 1 << FILTERS.index(copies)
    both = met.select("part", "quality", "toxic", F.inline(F.array(F.struct("mask", firsts.alias("n")), F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - firsts).alias("n")))))
    nameless = rows.where("doc_id is null").select("part", F.lit(0).alias("quality"), F.lit(0).alias("toxic"), "mask", F.lit(1).cast("long").alias("n"))
    return both.unionByName(nameless).where("n > 0").groupBy("part", "mask", F.col("quality").alias("good"), "toxic").agg(F.sum("n").alias("n"))


def zeta(counts: np.ndarray) -> np.ndarray:
    """Sums over the subsets of each set, along the last axis (2**k entries, sets as bits)."""
    out = counts.copy()
    for k in range(out.shape[-1].bit_length() - 1):
        by = out.reshape(*out.shape[:-1], -1, 2, 1 << k)
        by[..., 1, :] += by[..., 0, :]
    return out


class Orders:
    """Every step of every order of k filters: sets before and after it."""

    def __init__(self, filters: str) -> None:
        k, self.full = len(filters), (1 << len(filters)) - 1
        listed = list(permutations(range(k)))
        self.filter = np.array(listed).reshape(-1)
        self.after = np.cumsum(1 << np.array(listed), axis=1).reshape(-1)
        self.before = self.after - (1 << self.filter)
        self.names = ["".join(filters[f] for f in order) for order in listed for _ in order]
        self.step = np.tile(np.arange(1, k + 1, dtype=np.int32), len(listed))

    def audit(self, counts: np.ndarray) -> list[np.ndarray]:
        """Columns of a part from ``counts[all, good, toxic][mask]``: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
        # who fails none of a set has a mask among the subsets of what is outside the set
        alive = zeta(counts)[:, self.full - np.arange(self.full + 1)]
        n, bit = alive[0], 1 << self.filter
        lost = alive[:, self.before] - alive[:, self.after]
        fails, alone = n[0] - n[bit], n[self.full ^ bit] - n[self.full]
        shares = np.zeros(len(bit), np.int64)
        np.add.at(shares, self.filter, lost[0])
        return [n[self.after], lost[0], fails - lost[0], alone, lost[1], lost[2], shares[self.filter]]


_STEPS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Every step of every order of the filters in every part, from ``part, mask, good, toxic, n``."""
    seen = F.collect_list(F.struct("mask", "good", "toxic", "n"))  # an entry for each mask and labels of a part: 4 * 2**k, no more
    names = [x.split()[0] for x in _STEPS.split(", ")]

    def audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = Orders(filters)
        for batch in batches:
            for part, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = np.zeros((3, orders.full + 1), np.int64)
                for x in entries:
                    held[:, x["mask"]] += np.array([1, x["good"], x["toxic"]]) * x["n"]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(orders.names)), pa.array(orders.names), pa.array(orders.step), *map(pa.array, orders.audit(held))], names=names)

    return counts.groupBy("part").agg(seen.alias("seen")).mapInArrow(audited, _STEPS)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = masked(read(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    return interactions(mask_counts(rows, read(spark, sf_dir, "labels", "doc_id", "quality", "toxic")))


#: Step by step over all orders, from the definition.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
first AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT r, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words), 'C': 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * len(text),
     'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(w.doc_id > least, false)} AS fails
  FROM w JOIN first USING (text) LEFT JOIN marks USING (doc_id)),
long AS (SELECT r, part, good, toxic, unnest(['A', 'B', 'C', 'D', 'E']) AS filter, unnest([fails.A, fails.B, fails.C, fails.D, fails.E]) AS failed FROM f),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
parts AS (SELECT DISTINCT part FROM d),
ends AS (SELECT r, part, good, toxic, filter_order, min(CASE WHEN failed THEN strpos(filter_order, filter) END) AS removed_at, count(*) FILTER (WHERE failed) AS failures FROM long, orders GROUP BY ALL),
ended AS (SELECT part, filter_order, removed_at AS step, count(*) AS removed, sum(good) AS good_lost, sum(toxic) AS toxic_lost FROM ends WHERE removed_at IS NOT NULL GROUP BY ALL),
sizes AS (SELECT part, count(*) AS n FROM d GROUP BY part),
single AS (SELECT part, filter, count(*) AS fails, count(*) FILTER (WHERE total = 1) AS unique_fails FROM (SELECT *, count(*) FILTER (WHERE failed) OVER (PARTITION BY r) AS total FROM long) WHERE failed GROUP BY ALL),
told AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS filter, coalesce(removed, 0) AS removed, coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost
  FROM parts CROSS JOIN steps LEFT JOIN ended USING (part, filter_order, step))
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(n - sum(removed) OVER (PARTITION BY part, filter_order ORDER BY step) AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(coalesce(fails, 0) - removed AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM told JOIN sizes USING (part) LEFT JOIN single USING (part, filter)
"""

QUERIES = {"op11_filter_audit": op11_filter_audit}
ORACLE_SQL = {"op11_filter_audit": SQL}
