"""Best-two-fit packing of token sequences.

Each text becomes ids and one end; what is longer than a sequence is cut into whole
sequences after a first, shorter piece, and nothing else is cut.  A sequence is filled
greedily with the longest piece that fits, until none does; then its smallest piece
gives way to two unpacked ones, if two fit the gap that this opens and fill it better (the
fullest pair; of equally full ones the most even, so that small pieces stay for later gaps).

What the method decides depends on lengths alone, so it runs over the count of each
length: equal sequences in a row are made at once, as often as the counts last.  The
driver holds one count a length (``size`` of them), whatever the corpus, and its runs
are bounded too: each of them ends a length's stock or uses one of the few pieces that
are left of a length whose stock has ended (fewer than ``size / length + 2``).  Every
piece then finds its sequence by its rank among the pieces of its length: its rank
in its own partition and length, plus what partitions before hold.  So no length, however
common, meets in one task, and only placements, not tokens, are shuffled.

Defined cases: a null or empty text is its end alone; the strings of special tokens
inside texts are one token each, as the library takes them by default; repeated rows,
rows of equal ids and null ids are packed row by row; an empty table gives an empty
result; other columns play no part.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, cut, read
from .token_counts import PRE_TOKEN, checked, default_vocabulary

#: Tokens of a sequence, at most, and the id that ends a document.
SIZE, END = 2048, 0
#: Ranks below 2**RANK of a length; a place is found by length and rank in one number.
RANK = 48


def byte_of_character() -> dict[str, int]:
    """The bytes that a byte-level vocabulary's characters stand for: printable ones for themselves, the others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def ranks(vocabulary: bytes) -> dict[bytes, int] | None:
    """Ids by bytes, if merging by least id gives what the library gives; null otherwise.

    It does where ids rise with the merges and every token, standing alone, becomes itself.  Then the last
    two parts of a token are always those of its merge: a stretch of text between two borders that no merge has
    crossed goes through the states of the token standing alone, so no other two parts of it ever meet.
    """
    from tokenizers import Tokenizer

    spec = json.loads(vocabulary)
    model, byte = Tokenizer.from_str(vocabulary.decode()).model, byte_of_character()
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or not t["special"] for t in spec["added_tokens"]):
        return None
    apart = {t["content"] for t in spec["added_tokens"]}
    vocab = {t: k for t, k in spec["model"]["vocab"].items() if t not in apart}
    merged = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in spec["model"]["merges"]]
    single = [k for t, k in vocab.items() if len(t) == 1]
    alone = all([x.id for x in model.tokenize(t)] == [k] for t, k in vocab.items())
    if sorted(merged) != merged or len(single) != 256 or max(single) >= min(merged, default=256) or len(vocab) != 256 + len(merged) or not alone:
        return None
    return {bytes(map(byte.__getitem__, t)): k for t, k in vocab.items()}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit numbers, as the library gives them."""

    def __init__(self, vocabulary: bytes, merges: dict[bytes, int] | None) -> None:
        self.specials = {t["content"]: t["id"].to_bytes(4, "little") for t in json.loads(vocabulary)["added_tokens"]}
        if merges is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_str(vocabulary.decode())
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
            self.encode = self.library
        else:
            import tiktoken

            self.by_rank = tiktoken.Encoding("ids", pat_str=PRE_TOKEN, mergeable_ranks=merges, special_tokens={}).encode_ordinary
            self.parted = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")").split if self.specials else None

    def library(self, texts: list[str | None]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return [self._ids(t) if t else b"" for t in texts]

    def _ids(self, text: str) -> bytes:
        if any(s in text for s in self.specials):
            return b"".join([self.specials[p] if p in self.specials else np.array(self.by_rank(p), "<u4").tobytes() for p in self.parted(text)])
        return np.array(self.by_rank(text), "<u4").tobytes()


def spans(n: int, size: int) -> Iterator[tuple[int, int]]:
    """Start and length of a document's pieces: all full but the first."""
    first = n % size or size
    yield 0, min(first, n)
    for start in range(first, n, size):
        yield start, size


_PIECES = "doc_id long, piece int, start long, length long, ids binary"


def token_pieces(docs: DataFrame, vocabulary_path: str | None = None, size: int = SIZE) -> DataFrame:
    """``doc_id, piece, start, length, ids`` of every document; ids as little-endian unsigned 32-bit numbers, ended by END."""
    with open(vocabulary_path or default_vocabulary(), "rb") as f:
        vocabulary = f.read()
    checked(vocabulary)
    held = docs.sparkSession.sparkContext.broadcast((zlib.compress(vocabulary), ranks(vocabulary)))

    def cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = None, END.to_bytes(4, "little")
        for batch in batches:
            encoder = encoder or Encoder(zlib.decompress(held.value[0]), held.value[1])
            for part in chunks(batch, "text"):
                made = []
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                    ids += end
                    made += [(doc_id, k, start, n, ids[4 * start : 4 * (start + n)]) for k, (start, n) in enumerate(spans(len(ids) // 4, size))]
                cols = zip(*made, strict=True)
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in _PIECES.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(cutting, _PIECES)


@dataclass
class Plan:
    """Where pieces go: rows of one length, by rank from ``first`` on, ``copies`` a sequence from ``sequence`` on, at ``offset`` and after."""

    key: np.ndarray  # length << RANK | first rank, ascending
    copies: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.key, (length << RANK) | rank, "right") - 1
        nth = rank - (self.key[i] & ((1 << RANK) - 1))
        return self.sequence[i] + nth // self.copies[i], self.offset[i] + nth % self.copies[i] * length


def plan(counts: np.ndarray, size: int) -> Plan:
    """Best-two-fit over ``counts[length]``; the sequences are those that the method makes of single pieces, one after the other."""
    left = counts.astype(np.int64).copy()
    present = np.flatnonzero(left)
    below = np.zeros(size + 1, np.int64)  # the longest length in stock that is no longer than the place
    below[present] = present
    below = np.maximum.accumulate(below)
    used = np.zeros(size + 1, np.int64)
    runs: list[tuple[int, int, int, int]] = []
    sequence = 0
    while below[size]:
        fill: dict[int, int] = {}
        gap, x = size, int(below[size])
        while x:  # x falls, and all that fit of it are taken, so what is taken never limits what comes
            fill[x] = min(gap // x, int(left[x]))
            gap -= fill[x] * x
            x = int(below[min(gap, x - 1)])
        need, net = dict(fill), dict(fill)
        smallest = min(fill)
        if gap:
            a = np.arange(gap + 1, smallest)
            a = a[below[a] == a]
            b = below[np.minimum(gap + smallest - a, a)]
            b = np.where((b == a) & (left[a] < 2), below[a - 1], b)
            best = int(np.argmax(np.where(b > 0, a + b, 0))) if len(a) else -1
            if best >= 0 and b[best] > 0 and a[best] + b[best] > smallest:
                net[smallest] -= 1
                for x in (int(a[best]), int(b[best])):
                    need[x] = need.get(x, 0) + 1
                    net[x] = net.get(x, 0) + 1
        times = min((int(left[x]) - need[x]) // k + 1 for x, k in net.items() if k)
        offset = 0
        for x in sorted(net, reverse=True):
            if k := net[x]:
                runs.append(((x << RANK) | int(used[x]), k, sequence, offset))
                offset += k * x
                used[x] += times * k
                left[x] -= times * k
                if not left[x]:
                    below[below == x] = below[x - 1]
        sequence += times
    runs.sort()
    cols = np.array(runs, np.int64).reshape(-1, 4).T
    return Plan(*cols, sequence)


def packed(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows of pieces (a column ``length`` of 1 to size, any others) with ``sequence_id`` and ``offset``."""
    t = cut(pieces.withColumn("_task", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id()))
    held = t.groupBy("_task", "length").count()
    counts = np.zeros(size + 1, np.int64)
    for length, n in held.groupBy("length").agg(F.sum("count")).collect():  # a row a length
        counts[length] = n
    made = t.sparkSession.sparkContext.broadcast(plan(counts, size))
    before = F.sum("count").over(Window.partitionBy("length").orderBy("_task")) - F.col("count")
    offsets = held.select("_task", "length", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("_task", "length").orderBy("_nth")) - 1
    ranked = t.withColumn("_own", own).join(offsets, ["_task", "length"]).withColumn("_rank", (F.col("_own") + F.col("_before")).cast("long"))
    columns = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = made.value.places(np.asarray(b.column("length"), np.int64), np.asarray(b.column("_rank"), np.int64)) if len(b) else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema), "sequence_id long, `offset` long"])
    return ranked.select(*columns, "_rank").mapInArrow(place, schema)


def sequences(placed: DataFrame) -> DataFrame:
    """``sequence_id, ids`` of placed pieces that kept their ids: the training sequences themselves."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # a sequence's pieces, no more than size
    joined = F.aggregate(inside, F.lit(b""), lambda held, x: F.concat(held, x["ids"]))
    return placed.groupBy("sequence_id").agg(joined.alias("ids"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(read(spark, sf_dir, "documents", "doc_id", "text"))
    return packed(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


QUERIES = {"op12_best_fit_packing": op12_best_fit_packing}
ORACLE_SQL: dict[str, str] = {}
