"""Near-duplicate vectors: random-hyperplane sign hashing, exact cosine, components.

Equal vectors of a label are one class, with a count.  Each of TABLES tables signs a
class by the sides of some random hyperplanes; classes that share a sign in some table
are compared by their cosine in double precision.  Two vectors at cosine 0.98 differ
in a sign bit with probability 0.064, so all tables miss such a pair with probability
(1 - 0.936**bits)**tables.  The bits follow the largest label, so that chance meetings do not
grow with it (see :func:`shape`), and the tables the bits, so that the probability stays below MISS.

Buckets of several tables with equal members are one, that of the first; so a group of near copies moves once.
A pair is counted in the first table where it meets, so links are counted without
listing pairs: a bucket gives a count for each class and the edges of a forest.  Large
buckets are cut into blocks of at most BLOCK classes; each pair of blocks is a task's
matrix product.

Defined cases: vectors that are null, zero, or hold null or non-finite components,
and vectors of a null label, link with nothing and are components of their own; vectors of
unequal length never link; equal rows link as equal vectors of different ids do, and
rows that repeat a vec_id share that id's component; an empty table gives an empty
result; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Forest, components, cut, read

COSINE = 0.98
#: Probability that a pair at the least cosine meets in no table, at most; and other classes that a class shares a bucket with by chance, about.
MISS, CHANCE = 1e-4, 0.25
#: Bits of a table, at least and at most.
BITS = (8, 40)
BLOCK = 1024
SEED = 7


def shape(rows: int, least: float = COSINE) -> tuple[int, int]:
    """Bits and tables for a label of so many classes."""
    bits = min(max(math.ceil(math.log2(max(1, rows) / CHANCE)), BITS[0]), BITS[1])
    same = (1 - math.acos(least) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - same))


def planes(dims: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, dims]).normal(size=(dims, bits * tables))


def signatures(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(n, tables) sign words."""
    side = (vectors @ planes(vectors.shape[1], bits, tables) > 0).reshape(len(vectors), tables, bits)
    return side @ (1 << np.arange(bits, dtype=np.int64))


def _sound(v: Column) -> Column:
    """Whether a vector can link: no null or non-finite component, and not all of them zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def classes(vectors: DataFrame) -> DataFrame:
    """``class_id`` (its smallest vec_id), ``copies``, ``label``, ``k1, k2, vec``: the distinct linkable vectors of each label."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    linkable = vectors.where(F.col("embedding").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & _sound(v))
    # adding 0.0 makes the two zeros equal
    rows = linkable.select("vec_id", "label", F.transform(v, lambda x: x + 0.0).alias("vec")).select("*", *_key("vec"))
    return rows.groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec"))


def _key(vec: str) -> list[Column]:
    """128 bits of a vector."""
    return [F.xxhash64(vec).alias("k1"), F.xxhash64(vec, F.lit(1)).alias("k2")]


def _rows(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def keys(found: DataFrame, bits: int, tables: int) -> DataFrame:
    """A row for each class and table: ``class_id, label, dims, t, sign``."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.asarray(pc.list_value_length(b.column(2)), np.int64)
            for dims in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dims)
                part = b.take(pa.array(at))
                s = signatures(_rows(part.column(2)), bits, tables)
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(np.asarray(part.column(0)), tables)),
                        pa.array(np.repeat(np.asarray(part.column(1)), tables)),
                        pa.array(np.full(n * tables, dims, np.int32)),
                        pa.array(np.tile(np.arange(tables, dtype=np.int32), n)),
                        pa.array(s.ravel()),
                    ],
                    names=["class_id", "label", "dims", "t", "sign"],
                )

    return found.select("class_id", F.col("label").cast("long").alias("label"), "vec").mapInArrow(sign, "class_id long, label long, dims int, t int, sign long")


def _compare(a: np.ndarray, b: np.ndarray, ia: np.ndarray, ib: np.ndarray, sa: np.ndarray, sb: np.ndarray, t: int, same: bool, least: float) -> np.ndarray:
    """Pairs (places in a and b) with a cosine of least or more that meet in no table before t."""
    near = a @ b.T >= least - 1e-9
    if same:
        near = np.triu(near, 1)
    x, y = np.nonzero(near)
    cos = np.einsum("ij,ij->i", a[x], b[y])
    first = (sa[x, :t] != sb[y, :t]).all(axis=1) if t else np.ones(len(x), bool)
    keep = first & (cos >= least) & (ia[x] != ib[y])
    return np.stack([x[keep], y[keep]])


def linked(found: DataFrame, least: float = COSINE, bits: int | None = None, tables: int | None = None, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``class_id, links`` (linked vectors of other classes) in parts to be summed, and ``a, b`` edges that connect the classes."""
    if bits is None or tables is None:
        largest = found.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        bits, tables = shape(largest or 1, least)
    own = keys(found, bits, tables)
    bucket = ["label", "dims", "t", "sign"]
    mark = [F.bit_xor(F.xxhash64("class_id", F.lit(k))).alias(f"x{k}") for k in (0, 1)]
    sizes = own.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n"), *mark).where("n > 1")
    # of buckets with equal members the first table's stays: a pair's first meeting is never in another one
    sizes = sizes.groupBy("label", "dims", "n", "x0", "x1").agg(F.min(F.struct("t", "sign")).alias("at")).select("label", "dims", "at.t", "at.sign", "n")
    met = own.join(sizes, bucket).withColumn("blocks", F.ceil(F.col("n") / float(block)).cast("int"))
    mine = F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int")
    # a class goes to each pair of blocks with its own; most buckets have one block
    spread = met.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("class_id", *bucket, "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    full = spread.join(found.select("class_id", "copies", "vec"), "class_id")
    group = [*bucket, "i", "j"]
    dealt = full.repartition(*group).sortWithinPartitions(*group, "class_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held, key = Forest(), [], None
        counts: dict[int, int] = {}

        def done() -> None:
            if not held:
                return
            table = pa.Table.from_batches(held).combine_chunks()
            if len(table) > 1:
                vec = _rows(table.column("vec").combine_chunks())
                sign = signatures(vec, bits, tables)
                unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
                ids, copies, mine = (np.asarray(table.column(c)) for c in ("class_id", "copies", "mine"))
                t, i, j = key[2], key[4], key[5]
                if i == j:
                    x, y = _compare(unit, unit, ids, ids, sign, sign, t, True, least)
                else:
                    p, q = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
                    x, y = _compare(unit[p], unit[q], ids[p], ids[q], sign[p], sign[q], t, False, least)
                    x, y = p[x], q[y]
                for at, other in ((x, y), (y, x)):
                    for c, n in zip(ids[at].tolist(), copies[other].tolist(), strict=True):
                        counts[c] = counts.get(c, 0) + n
                for a, b in zip(ids[x].tolist(), ids[y].tolist(), strict=True):
                    forest.join(a, b)
            held.clear()

        def out() -> pa.RecordBatch:
            edges = list(forest.links())
            a = [*counts, *(x for x, _ in edges)]
            b = [None] * len(counts) + [y for _, y in edges]
            n = [*counts.values(), *[0] * len(edges)]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "links"])

        names = group
        for batch in batches:
            if not len(batch):
                continue
            cols = [np.asarray(batch.column(batch.schema.get_field_index(c))) for c in names]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            for s, e in zip([0, *change.tolist()], [*change.tolist(), len(batch)], strict=True):
                k = tuple(int(c[s]) for c in cols)
                if k != key:
                    done()
                    key = k
                held.append(batch.slice(s, e - s))
        done()
        yield out()

    got = cut(dealt.select(*group, "mine", "class_id", "copies", "vec").mapInArrow(work, "a long, b long, links long"))
    return got.where("b is null").select(F.col("a").alias("class_id"), "links"), got.where("b is not null").select("a", "b")


def near_duplicates(vectors: DataFrame, least: float = COSINE, bits: int | None = None, tables: int | None = None, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, a row for each vector."""
    vectors = vectors.select("vec_id", "embedding", "label")
    found = cut(classes(vectors))
    counts, edges = linked(found, least, bits, tables, block)
    joined = components(edges, "a", "b")
    links = counts.groupBy("class_id").agg(F.sum("links").alias("links"))
    per = (
        found.join(links, "class_id", "left")
        .join(joined, F.col("class_id") == F.col("node"), "left")
        .select("label", "k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "class_id").alias("component_id"))
    )
    v = F.transform("embedding", lambda x: x.cast("double") + 0.0)
    rows = vectors.select("vec_id", "label", v.alias("_vec")).select("vec_id", "label", *[F.when(_sound(F.col("_vec")), k).alias(n) for k, n in zip(_key("_vec"), ("k1", "k2"), strict=True)])
    per = per.select(F.col("label").alias("_label"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "n_links", "component_id")
    met = rows.join(per, (rows.label == F.col("_label")) & (rows.k1 == F.col("_k1")) & (rows.k2 == F.col("_k2")) & F.col("vec_id").isNotNull(), "left")
    component = F.coalesce("component_id", "vec_id")
    return met.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL),
u AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {COSINE}),
reach AS (SELECT vec_id AS n, vec_id AS r FROM embeddings UNION SELECT p.b, reach.r FROM reach JOIN pairs p ON p.a = reach.n),
least AS (SELECT n, min(r) AS component_id FROM reach GROUP BY n),
links AS (SELECT a, count(*) AS n_links FROM pairs GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, component_id = e.vec_id AS kept
FROM embeddings e JOIN least ON least.n = e.vec_id LEFT JOIN links ON links.a = e.vec_id
"""
QUERIES = {"op10_embedding_dedup": op10_embedding_dedup}
ORACLE_SQL = {"op10_embedding_dedup": _SQL}
