"""N-gram Jaccard join by prefix trees.

A document's set holds its distinct 5-word shingles as 64-bit hashes.  Two documents
link when 100 * intersection >= 80 * union; of n shingles at most n // 5 may then be
missing in the partner.  The join goes through four steps, and no step lists the pairs
of a group:

1. Frequencies.  Half of the hashes (the even ones; all of them for the few sets
   where that half has n // 5 members or fewer) are counted over all documents.  A
   task sends each bucket one packed row for a batch of texts and gets back the
   hashes that other documents hold too.  A set with more than n // 5 unique even
   hashes links with nothing.
2. Blocks.  The n // 5 + 1 rarest hashes of the others (their prefix in the global
   order) are tied to the smallest document that holds them, within a batch first;
   the connected blocks hold every link.
3. Trees.  Each block's distinct sets, its frequent shingles first, are stored in a
   path-compressed trie.  A set walks down the trie with the overlap so far, shared by
   all sets below a node, and leaves a subtree when remaining lengths cannot reach the
   overlap needed, or when the subtree is wholly linked to it already.  Blocks of more
   than BLOCK sets are joined by pairs of parts, so no task gathers more than two parts.
4. Components of the links found.

Defined cases: a null, empty or wordless text has an empty set and links with nothing;
fewer than five words are one shingle; rows with a null doc_id keep their shingle
count, link with nothing and have a null component; rows that repeat a doc_id are one
document with all their links; an empty table gives an empty result; other columns
play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Forest, bytes_of, chunks, components, cut, read
from .hashing import buffer_sets

#: Sets of a block that meet in one tree.
BLOCK = 4096
#: Bytes of text that a bucket of shingles comes from, about; and buckets, at most (from 16 TB on they grow instead).
BUCKET, BUCKETS = 1 << 26, 1 << 18


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    owner, h = buffer_sets([t or b"" for t in texts])
    return np.split(h, np.searchsorted(owner, np.arange(1, len(texts)))) if texts else []


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


_REQUEST = "bucket int, batch long, ids binary, known binary, sizes binary, counts binary, hashes binary"
_ANSWER = "batch long, ids binary, known binary, sizes binary, unique_even binary, counts binary, hashes binary, df binary"


def requests(docs: DataFrame, buckets: int) -> DataFrame:
    """Step 1, asking: a row for each batch of texts and bucket of hashes; bucket -1 carries ids and set sizes."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_id = TaskContext.get().partitionId() << 32
        shift = np.uint64(1)
        for batch in batches:
            for part in chunks(batch, "text"):
                sets = shingle_sets(bytes_of(part.column(1)))
                n = np.array([len(s) for s in sets], np.int64)
                sent = [e if len(e := s[(s & shift) == 0]) > len(s) // 5 else s for s in sets]
                doc = np.repeat(np.arange(len(sets)), [len(s) for s in sent])
                h = np.concatenate(sent) if sent else np.zeros(0, np.uint64)
                b = ((h >> np.uint64(1)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(b, kind="stable")
                h, doc, b = h[order], doc[order], b[order]
                ends = np.searchsorted(b, np.arange(buckets + 1))
                ids = part.column(0)
                rows = [(-1, batch_id, _blob(np.asarray(ids.fill_null(0), np.int64)), _blob(np.asarray(ids.is_valid(), bool)), _blob(n), None, None)]
                for k in range(buckets):
                    s, e = ends[k], ends[k + 1]
                    if e > s:
                        rows.append((k, batch_id, None, None, None, _blob(np.bincount(doc[s:e], minlength=len(sets)).astype(np.uint32)), _blob(h[s:e])))
                kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "batch", "ids", "known", "sizes", "counts", "hashes"])
                batch_id += 1

    return docs.select("doc_id", "text").mapInArrow(ask, _REQUEST)


def answers(asked: DataFrame, buckets: int) -> DataFrame:
    """Step 1, answering: for each batch and bucket the hashes that several documents hold, and the number of the even ones that do not."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["batch", "ids", "known", "sizes", "unique_even", "counts", "hashes", "df"]
        kinds = [pa.int64(), *[pa.binary()] * 7]

        def rows_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        held: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            passed = []
            for r in batch.to_pylist():
                if r["bucket"] < 0:
                    passed.append((r["batch"], r["ids"], r["known"], r["sizes"], None, None, None, None))
                else:
                    held.setdefault(r["bucket"], []).append((r["batch"], np.frombuffer(r["counts"], np.uint32), np.frombuffer(r["hashes"], np.uint64)))
            if passed:
                yield rows_of(passed)
        for bucket in sorted(held):
            asked = held.pop(bucket)
            every = np.concatenate([h for _, _, h in asked])
            every.sort()
            first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            df = np.diff(np.append(first, len(every)))
            shared, shared_df = every[first[df > 1]], df[df > 1].astype(np.uint32)
            del every, first, df
            out = []
            for batch_id, counts, h in asked:
                at = np.searchsorted(shared, h)
                met = np.zeros(len(h), bool)
                inside = at < len(shared)
                met[inside] = shared[at[inside]] == h[inside]
                doc = np.repeat(np.arange(len(counts)), counts)
                alone = np.bincount(doc[~met & ((h & np.uint64(1)) == 0)], minlength=len(counts)).astype(np.uint32)
                out.append((batch_id, None, None, None, _blob(alone), _blob(np.bincount(doc[met], minlength=len(counts)).astype(np.uint32)), _blob(h[met]), _blob(shared_df[at[met]])))
                if len(out) >= 64:
                    yield rows_of(out)
                    out = []
            if out:
                yield rows_of(out)

    # packed rows of about equal size: the bucket's number is its partition
    where = F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(F.pmod(F.xxhash64("batch"), F.lit(buckets)).cast("int"))
    return asked.repartitionById(buckets, where).mapInArrow(answer, _ANSWER)


_FOUND = "kind int, a long, b long"


def prefixes(answered: DataFrame) -> DataFrame:
    """Step 2: kind 0 rows (doc_id, set size) for every document, 1 (hash, doc_id) for prefixes, 2 (doc_id, doc_id) for ties within a batch."""

    def gather(rows: list[dict]) -> pa.RecordBatch:
        head = next(r for r in rows if r["ids"] is not None)
        ids, known, n = (np.frombuffer(head[c], k) for c, k in (("ids", np.int64), ("known", bool), ("sizes", np.int64)))
        parts = [r for r in rows if r["ids"] is None]
        alone, asked = np.zeros(len(ids), np.int64), []
        for r in parts:
            alone += np.frombuffer(r["unique_even"], np.uint32)
            counts = np.frombuffer(r["counts"], np.uint32)
            asked.append((np.repeat(np.arange(len(ids)), counts), np.frombuffer(r["hashes"], np.uint64), np.frombuffer(r["df"], np.uint32)))
        doc, h, df = (np.concatenate([x[k] for x in asked]) if asked else np.zeros(0, t) for k, t in ((0, np.int64), (1, np.uint64), (2, np.uint32)))
        even = np.bincount(doc[(h & np.uint64(1)) == 0], minlength=len(ids)) + alone
        left = np.where(even > n // 5, n // 5 + 1 - alone, np.iinfo(np.int64).max)  # a set that sent all of its hashes keeps all as prefix
        keep = (left > 0) & known
        mine = keep[doc]
        doc, h, df = doc[mine], h[mine], df[mine]
        order = np.lexsort((h, df, doc))
        doc, h = doc[order], h[order]
        start = np.searchsorted(doc, np.arange(len(ids)))
        rank = np.arange(len(doc)) - start[doc]
        mine = rank < left[doc]
        doc, h = ids[doc[mine]], h[mine].view(np.int64)
        order = np.lexsort((doc, h))
        doc, h = doc[order], h[order]
        first = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
        hub = doc[np.flatnonzero(first)][np.cumsum(first) - 1] if len(h) else doc
        ties = np.unique(np.stack([doc, hub], axis=1)[doc != hub], axis=0)
        kind = np.repeat(np.arange(3, dtype=np.int32), [len(ids), int(first.sum()), len(ties)])
        a = np.concatenate([ids, h[first], ties[:, 0]])
        b = np.concatenate([n, doc[first], ties[:, 1]])
        valid = np.concatenate([known, np.ones(len(a) - len(ids), bool)])
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(a, pa.int64(), mask=~valid), pa.array(b, pa.int64())], names=["kind", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if held and held[0]["batch"] != r["batch"]:
                    yield gather(held)
                    held = []
                held.append(r)
        if held:
            yield gather(held)

    return answered.repartition("batch").sortWithinPartitions("batch").mapInArrow(run, _FOUND)


def blocks(found: DataFrame) -> DataFrame:
    """``doc_id, block`` of every document that may have a link."""
    held = found.where("kind = 1").select(F.col("a").alias("h"), F.col("b").alias("doc"))
    hubs = held.groupBy("h").agg(F.min("doc").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "hub")
    ties = held.join(hubs, "h").where("doc != hub").select("doc", "hub").distinct()
    ties = ties.unionByName(found.where("kind = 2").select(F.col("a").alias("doc"), F.col("b").alias("hub")))
    part = components(ties, "doc", "hub")
    part = part.select(F.col("node").alias("doc_id"), F.col("component").alias("block"))
    return part.unionByName(part.select(F.col("block").alias("doc_id"), "block").distinct())


class Node:
    __slots__ = ("children", "ends", "last", "least", "most", "root", "tokens", "rest")

    def __init__(self, tokens: np.ndarray) -> None:
        self.tokens = tokens
        self.children: list[Node] = []
        self.ends: list[int] = []


class Trie:
    """Sets of one group, as ranks in the group's order of shingles, in a path-compressed prefix tree."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.n = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets)
        _, place, count = np.unique(every, return_inverse=True, return_counts=True)
        rank = np.empty(len(count), np.int64)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
        shared = int((count > 1).sum())  # ranks from here on are in one set only and meet nothing
        rank, ends = rank[place], np.cumsum(self.n)
        self.ranks = []
        weight = count[place].astype(np.float64)
        self.central = np.zeros(len(sets))
        for k, e in enumerate(ends.tolist()):
            r = np.sort(rank[e - self.n[k] : e])
            self.ranks.append(r[: np.searchsorted(r, shared)])
            self.central[k] = weight[e - self.n[k] : e].mean() if self.n[k] else 0
        self.inside = np.zeros(shared + 1, bool)
        self.forest = Forest()

    def near(self, overlap: int, a: int, b: int) -> bool:
        return 180 * overlap >= 80 * int(self.n[a] + self.n[b])

    def build(self) -> Node:
        order = sorted(range(len(self.n)), key=lambda k: self.ranks[k].astype(">u4").tobytes())
        top = Node(np.zeros(0, np.int64))
        path: list[tuple[Node, int]] = [(top, 0)]  # node, depth at its end
        before = np.zeros(0, np.int64)
        for k in order:
            r = self.ranks[k]
            m = min(len(r), len(before))
            differ = np.flatnonzero(r[:m] != before[:m])
            common = int(differ[0]) if len(differ) else m
            while len(path) > 1 and path[-2][1] >= common:
                path.pop()
            node, depth = path[-1]
            if depth > common:  # the shared part ends inside this node: part it
                cut_at = len(node.tokens) - (depth - common)
                lower = Node(node.tokens[cut_at:])
                lower.children, lower.ends = node.children, node.ends
                node.tokens, node.children, node.ends = node.tokens[:cut_at], [lower], []
                path[-1] = (node, common)
            if len(r) > common:
                leaf = Node(r[common:])
                path[-1][0].children.append(leaf)
                path.append((leaf, len(r)))
            path[-1][0].ends.append(k)
            before = r
        self._sum(top)
        return top

    def _sum(self, top: Node) -> None:
        walk, order = [top], []
        while walk:
            x = walk.pop()
            order.append(x)
            walk += x.children
        for x in reversed(order):
            sizes = [int(self.n[k]) for k in x.ends]
            roots = {self.forest.find(k) for k in x.ends} | {c.root for c in x.children}
            x.root = roots.pop() if len(roots) == 1 else -1
            x.least, x.most = min([*sizes, *(c.least for c in x.children)], default=0), max([*sizes, *(c.most for c in x.children)], default=0)
            x.rest = max([0, *(c.rest + len(c.tokens) for c in x.children)])
            x.last = int(x.tokens[-1]) if len(x.tokens) else -1

    def walk(self, top: Node, k: int) -> None:
        """Links set k with all that the tree holds for it."""
        q, n, find = self.ranks[k], int(self.n[k]), self.forest.find
        self.inside[q] = True
        low, high = -(-4 * n // 5), 5 * n // 4
        stack: list[tuple[Node, int]] = [(top, 0)]
        while stack:
            x, overlap = stack.pop()
            if overlap < 0:  # all below x is done: if it is one component by now, others need not go down
                roots = {find(e) for e in x.ends} | {find(c.root) if c.root >= 0 else -1 for c in x.children}
                x.root = roots.pop() if len(roots) == 1 else -1
                continue
            if x.most < low or x.least > high or (x.root >= 0 and find(x.root) == find(k)):
                continue
            if len(x.tokens):
                overlap += int(np.count_nonzero(self.inside[x.tokens]))
            for other in x.ends:
                if other != k and self.near(overlap, k, other):
                    self.forest.join(k, other)
            if x.children:
                left = len(q) - int(np.searchsorted(q, x.last, "right")) if x.last >= 0 else len(q)
                if 180 * (overlap + min(left, x.rest)) >= 80 * (n + max(x.least, low)):
                    if x.root < 0:
                        stack.append((x, -1))
                    stack += [(c, overlap) for c in x.children]
        self.inside[q] = False

    def join(self) -> Iterator[tuple[int, int]]:
        """Edges of a forest that connects exactly the linked sets."""
        top = self.build()
        # sets of frequent shingles first: they link most of a group of near copies, whose subtrees the others pass by
        for k in np.argsort(-self.central, kind="stable").tolist():
            self.walk(top, k)
        return self.forest.links()


def tree_links(reps: DataFrame, block: int = BLOCK) -> DataFrame:
    """``a, b`` edges between the sets (``block, doc_id, hashes``) of each block, by tries in tasks of bounded size."""
    sizes = reps.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = reps.join(sizes, "block").withColumn("parts", F.ceil(F.col("n") / float(block)).cast("int"))
    met = met.withColumn("mine", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("block", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "doc_id", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets, out = None, [], [], []

        def done() -> None:
            if len(ids) > 1:
                out.extend((ids[a], ids[b]) for a, b in Trie(sets).join())
            ids.clear()
            sets.clear()

        for batch in batches:
            for b, i, j, doc, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (b, i, j) != key:
                    done()
                    key = (b, i, j)
                ids.append(doc)
                sets.append(np.frombuffer(h, np.uint64))
        done()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    return met.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j", "doc_id").mapInArrow(run, "a long, b long")


def linked_components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``doc_id, n_shingles`` of every row, and ``node, component`` of the documents that are not their component's smallest."""
    docs = docs.select("doc_id", "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, min(BUCKETS, -(-total // BUCKET)))
    found = cut(prefixes(answers(requests(docs, buckets), buckets)))
    members = cut(blocks(found))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                h = [_blob(s) for s in shingle_sets(bytes_of(part.column(2)))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([xxhash.xxh3_128_digest(x) for x in h], pa.binary()), pa.array(h, pa.binary())], names=["block", "doc_id", "mark", "hashes"]
                )

    near = docs.join(members, "doc_id").select("block", "doc_id", "text").mapInArrow(make, "block long, doc_id long, mark binary, hashes binary")
    near = cut(near.where(F.length("hashes") > 0))
    reps = near.groupBy("block", "mark").agg(F.min("doc_id").alias("rep"), F.first("hashes").alias("hashes"))
    copies = near.select("block", "mark", "doc_id").join(near.groupBy("block", "mark").agg(F.min("doc_id").alias("rep")), ["block", "mark"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = tree_links(reps.select("block", F.col("rep").alias("doc_id"), "hashes")).unionByName(copies.where("a != b"))
    sizes = found.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"))
    return sizes, components(links, "a", "b")


def ngram_components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id``, a row for each of the input's."""
    sizes, joined = linked_components(docs)
    met = sizes.join(joined, F.col("doc_id") == F.col("node"), "left")
    return met.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component stays, the one of the smallest id; of rows that repeat an id one stays; null ids stay."""
    _, joined = linked_components(docs)
    kept = docs.join(joined.select(F.col("node").alias("__ngram_gone")), docs.doc_id == F.col("__ngram_gone"), "left_anti")
    repeated = cut(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__ngram_n")).where("__ngram_n > 1 and doc_id is not null").select(F.col("doc_id").alias("__ngram_again")))
    if repeated.isEmpty():
        return kept
    # the smallest text of an id stays, then the smallest of its other columns, so reruns agree
    own = F.struct(F.xxhash64("text").alias("__h"), *[F.col(c) for c in docs.columns])
    again = kept.join(repeated, kept.doc_id == F.col("__ngram_again"), "left_semi").groupBy("doc_id").agg(F.min(own).alias("__row")).select(*[F.col(f"__row.{c}").alias(c) for c in docs.columns])
    return kept.join(repeated, kept.doc_id == F.col("__ngram_again"), "left_anti").unionByName(again)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(read(spark, sf_dir, "documents", "doc_id", "text"))


_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
reach AS (SELECT doc_id AS n, doc_id AS r FROM documents UNION SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.n)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT n, min(r) AS component_id FROM reach GROUP BY n) c ON c.n = d.doc_id
"""
QUERIES = {"op3_ngram_join": op3_ngram_join}
ORACLE_SQL = {"op3_ngram_join": _SQL}
