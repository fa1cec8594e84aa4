"""Benchmark decontamination: a prefix-filtered containment join.

A benchmark item is a run of words; each window of WINDOW of them (or the whole of a
shorter item) is a token set that a document must contain whole.  Words are ordered
by rarity, the number of documents that hold them.  At containment 1 a set's prefix
is its rarest word: only at that word can a window begin to match.  Length and
position bounds (the window must fit around the word), then the comparison of the
whole window of words, decide.

Windows are broadcast in blocks of at most BLOCK, so what is broadcast is bounded
whatever the benchmark's size; a larger benchmark takes more passes.

Defined cases: a null or wordless text has 0 words and no hit; a null or wordless
item has no window; equal windows of several items count for each of them; items of
equal item_id are one item; a null item_id counts as the item ``''``; repeated
document rows are answered row by row; an empty benchmark hits nothing; other
columns play no part.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, chunks, cut, read

WINDOW = 10
#: Windows that are broadcast at a time.
BLOCK = 200_000
#: Bytes that are no part of a word, once A-Z are lower case: 00-2F, 3A-60, 7B-7F.
_APART = bytes(32 if b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))


def item_words(text: bytes | None) -> list[bytes]:
    return text.lower().translate(_APART).split() if text else []


def windows(benchmark: DataFrame, length: int = WINDOW) -> DataFrame:
    """``word_list (joined by blanks), items``: every distinct window and the items that hold it."""

    def cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                ids, out = part.column(0).to_pylist(), ([], [])
                for item, text in zip(ids, bytes_of(part.column(1)), strict=True):
                    words = item_words(text)
                    for i in range(max(1, len(words) - length + 1) if words else 0):
                        out[0].append(item or "")
                        out[1].append(b" ".join(words[i : i + length]))
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.binary())], names=["item", "word_list"])

    cutted = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(cutting, "item string, word_list binary")
    return cutted.groupBy("word_list").agg(F.array_sort(F.collect_set("item")).alias("items"))


def document_counts(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """Documents that hold each of the words: one small row for each word and task, summed by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for batch in batches:
            for part in chunks(batch, "text"):
                for text in bytes_of(part.column(0)):
                    held.update(vocabulary.intersection(item_words(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.word): r.n for r in rows}


class Anchors:
    """A block of windows under their rarest words, with that word's place in the window."""

    def __init__(self, block: list[tuple[bytes, list[str]]], rarity: dict[bytes, int]) -> None:
        self.items: list[list[str]] = [items for _, items in block]
        self.by_word: dict[bytes, list[tuple[int, int, list[bytes], int]]] = defaultdict(list)
        for k, (joined, _) in enumerate(block):
            words = joined.split(b" ")
            anchor = min(range(len(words)), key=lambda i: (rarity.get(words[i], 0), words[i], i))
            self.by_word[words[anchor]].append((anchor, len(words), words, k))
        self.by_word.default_factory = None
        self.words = frozenset(self.by_word)

    def find(self, words: list[bytes]) -> tuple[list[int], set[int]]:
        """Starts and ends (alternately) of the stretches of hit words, and the windows found."""
        if self.words.isdisjoint(words):
            return [], set()
        marks, found = np.zeros(len(words) + 1, np.int32), set()
        for at, word in enumerate(words):
            if word in self.words:
                for anchor, length, window, k in self.by_word[word]:
                    start = at - anchor
                    if start >= 0 and start + length <= len(words) and words[start : start + length] == window:
                        found.add(k)
                        marks[start] += 1
                        marks[start + length] -= 1
        if not found:
            return [], found
        hit = np.concatenate([[0], np.cumsum(marks[:-1]) > 0, [0]])
        return np.flatnonzero(np.diff(hit)).tolist(), found


def merge_spans(spans: list[int]) -> list[int]:
    """Starts and ends of stretches, where they overlap or touch made one."""
    out: list[int] = []
    for start, end in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def scan(docs: DataFrame, anchors: Anchors, carry: bool) -> DataFrame:
    """Adds a block's finds to ``doc_id, text, n_words, spans, items``; the text goes on only if more blocks follow."""
    held = docs.sparkSession.sparkContext.broadcast(anchors)
    names = ["doc_id", *["text"] * carry, "n_words", "spans", "items"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = held.value
        for batch in batches:
            for part in chunks(batch, "text"):
                n, spans, items = [], [], []
                old = [x.to_pylist() for x in part.columns[2:]] if part.num_columns > 2 else [[[]] * len(part)] * 2
                for text, s0, i0 in zip(bytes_of(part.column(1)), *old, strict=True):
                    words = item_words(text)
                    s, found = a.find(words)
                    n.append(len(words))
                    spans.append(merge_spans(s0 + s) if s0 else s)
                    items.append(sorted({*i0, *(x for k in found for x in a.items[k])}))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[part.column(1)] * carry, pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=names
                )

    kinds = {"doc_id": "long", "text": "string", "n_words": "long", "spans": "array<long>", "items": "array<string>"}
    columns = ["doc_id", "text", *[c for c in ("spans", "items") if c in docs.columns]]
    return docs.select(*columns).mapInArrow(look, ", ".join(f"{c} {kinds[c]}" for c in names))


def hits(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_words, spans, items``: spans are starts and ends, in words, of the stretches inside any window.

    One block of windows is in the driver and in each worker at a time; where there
    are more, a checkpoint parts the passes.
    """
    found = cut(windows(benchmark, length))
    pieces = max(1, -(-found.count() // block))
    df = docs.select("doc_id", "text")
    for k in range(pieces):
        part = found.where(F.pmod(F.xxhash64("word_list"), F.lit(pieces)) == k) if pieces > 1 else found
        rows = [(bytes(r.word_list), list(r.items)) for r in part.collect()]
        vocabulary = frozenset(w for joined, _ in rows for w in joined.split(b" "))
        df = scan(df, Anchors(rows, document_counts(docs, vocabulary) if rows else {}), k < pieces - 1)
        df = cut(df) if k < pieces - 1 else df
    return df


def digest(found: DataFrame) -> DataFrame:
    odd = F.expr("aggregate(transform(spans, (x, i) -> if(i % 2 = 0, -x, x)), 0L, (a, x) -> a + x)")
    return found.select(
        "doc_id", "n_words", odd.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without any benchmark window.

    Only the ids of contaminated rows are joined; a null id is matched as equal, and
    with repeated ids all rows of a contaminated id go.
    """
    bad = digest(hits(docs, benchmark)).where("contaminated").select(F.col("doc_id").alias("__bench_bad")).distinct()
    return docs.join(bad, docs.doc_id.eqNullSafe(F.col("__bench_bad")), "left_anti")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(hits(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text")))


_SQL = """
WITH d AS (SELECT doc_id, string_split_regex(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), ' ') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, string_split_regex(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), ' ') AS w FROM benchmark),
bw AS (SELECT item, least(10, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i, w FROM b WHERE w[1] <> ''),
windows AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM bw),
lengths AS (SELECT DISTINCT n FROM windows),
dw AS (SELECT doc_id, w, l.n, unnest(range(1, len(w) - l.n + 2)) AS i FROM d, lengths l WHERE w[1] <> '' AND len(w) >= l.n),
ds AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM dw),
met AS (SELECT doc_id, item, ds.n, i FROM ds JOIN windows USING (n, s)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM met) GROUP BY doc_id)
SELECT doc_id, CAST(CASE WHEN w[1] = '' THEN 0 ELSE len(w) END AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_items, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
QUERIES = {"op5_benchmark_decontamination": op5_benchmark_decontamination}
ORACLE_SQL = {"op5_benchmark_decontamination": _SQL}
