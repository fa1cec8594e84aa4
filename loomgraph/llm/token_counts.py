"""Token counts by a map-side two-tier lookup.

A byte-level BPE never joins bytes of two pre-tokens, so a text's count is the sum
of its pre-tokens' counts.  A first pass finds frequent pre-tokens: each task keeps a
bounded table of counts, and the tables are merged in a tree, bounded again; their
lengths are encoded once and broadcast.  The second pass looks each pre-token up in
that table, then in the worker's own cache; what both miss is encoded with the
library and cached.  No pre-token is ever shuffled, and the result does not depend
on what either tier holds.

Defined cases: a null or empty text has 0 bytes and 0 tokens; the strings of special
tokens inside texts are one token each, as the library takes them by default;
repeated rows are counted row by row; an empty table gives an empty result; other
columns play no part.
"""

from __future__ import annotations

import json
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, merged, read

#: Frequent pre-tokens that are broadcast, at most.
FREQUENT = 1 << 15
#: Pre-tokens whose counts a task of the first pass holds, and those that it hands on.
HELD = 1 << 18
#: Entries of a worker's cache, and characters of all of them; a full one is begun anew.
CACHE, CACHED = 1 << 19, 1 << 25
#: Characters of a pre-token that either tier holds; a longer one is encoded where it is met.
LONG = 256
#: Tokens beyond which a text is over the limit.
LIMIT = 1024

#: Fixed value: how a byte-level BPE of this kind parts a text (contractions; letters, numbers and others with a blank before them; blanks).
PRE_TOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for a text of ASCII characters alone, whose classes need no tables.
ASCII_PRE_TOKEN = PRE_TOKEN.replace(r" ?\p{L}+", " ?[A-Za-z]+").replace(r" ?\p{N}+", " ?[0-9]+").replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Splitter:
    """A text's pre-tokens, special strings apart."""

    def __init__(self, specials: list[str]) -> None:
        self.wide, self.plain = regex.compile(PRE_TOKEN).findall, re.compile(ASCII_PRE_TOKEN, re.ASCII).findall
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True))) if specials else None

    def pre(self, text: str) -> list[str]:
        return self.plain(text) if text.isascii() else self.wide(text)

    def __call__(self, text: str) -> tuple[list[str], int]:
        if self.special is None or self.special.search(text) is None:
            return self.pre(text), 0
        parts = self.special.split(text)
        return [w for p in parts for w in self.pre(p)], len(parts) - 1


def checked(vocabulary: bytes) -> None:
    """Refuses a vocabulary file that parts texts in another way than PRE_TOKEN does, or alters them first."""
    spec = json.loads(vocabulary)
    pre = spec.get("pre_tokenizer") or {}
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
        raise ValueError("the vocabulary file is not a plain byte-level BPE")


def special_strings(vocabulary: bytes) -> list[str]:
    return [t["content"] for t in json.loads(vocabulary)["added_tokens"]]


def _pack(counts: dict[str, int]) -> bytes:
    return zlib.compress(pickle.dumps(dict(counts)), 1)


def _merge(blobs: list[bytes]) -> bytes:
    total: Counter[str] = Counter()
    for blob in blobs:
        total.update(pickle.loads(zlib.decompress(blob)))
    return _pack(dict(total.most_common(FREQUENT)))


def frequent(docs: DataFrame, specials: list[str]) -> list[str]:
    """Frequent pre-tokens over all texts: the merge of bounded tables, one a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held = Splitter(specials), Counter()
        for batch in batches:
            for part in chunks(batch, "text"):
                for text in part.column(0).to_pylist():
                    if text:
                        held.update(w for w in split(text)[0] if len(w) <= LONG)
                if len(held) > HELD:
                    held = Counter(dict(held.most_common(HELD // 2)))
        if held:
            yield pa.RecordBatch.from_pydict({"blob": pa.array([_pack(dict(held.most_common(FREQUENT)))], pa.binary())})

    blob = merged(docs.select("text").mapInArrow(count, "blob binary"), _merge)
    return sorted(pickle.loads(zlib.decompress(blob))) if blob else []


class Lengths:
    """Counts of one vocabulary: the broadcast tier, then the worker's cache, then the library."""

    def __init__(self, vocabulary: bytes, first: dict[str, int]) -> None:
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_str(vocabulary.decode())
        self.encoder.no_truncation()
        self.encoder.no_padding()
        self.encoder.encode_special_tokens = True  # a miss is a piece of text, never a special string
        self.split, self.first, self.cache, self.size = Splitter(special_strings(vocabulary)), first, dict(first), 0

    def encode(self, words: list[str]) -> None:
        """Learns the lengths of distinct pre-tokens."""
        size = sum(map(len, words))
        if len(self.cache) + len(words) > len(self.first) + CACHE or self.size + size > CACHED:
            self.cache, self.size = dict(self.first), 0
        self.size += size
        for w, e in zip(words, self.encoder.encode_batch(words, add_special_tokens=False), strict=True):
            self.cache[w] = len(e.ids)

    def count(self, texts: list[str | None]) -> list[int]:
        parted = [self.split(t) if t else ([], 0) for t in texts]
        missing = set().union(*(words for words, _ in parted)).difference(self.cache) if parted else set()
        if missing:
            before = self.cache
            self.encode(list(missing))
            if self.cache is not before:  # begun anew: what the old one held is missing now
                self.encode([w for w in set().union(*(words for words, _ in parted)) if w not in self.cache])
        look = self.cache.__getitem__
        counts = [sum(map(look, words)) + specials for words, specials in parted]
        for w in [w for w in missing if len(w) > LONG]:  # held for these texts alone
            self.cache.pop(w, None)
        return counts


def token_counts(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_tokens``; the vocabulary file is read by the driver alone and travels with the lookup table."""
    with open(vocabulary_path or default_vocabulary(), "rb") as f:
        vocabulary = f.read()
    checked(vocabulary)
    sc = docs.sparkSession.sparkContext
    words = frequent(docs, special_strings(vocabulary))
    table = Lengths(vocabulary, {})
    table.encode(words)
    held = sc.broadcast((zlib.compress(vocabulary), {w: table.cache[w] for w in words}))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = None
        for batch in batches:
            lengths = lengths or Lengths(zlib.decompress(held.value[0]), held.value[1])
            for part in chunks(batch, "text"):
                n = lengths.count(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return sized.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents", "doc_id", "text")).withColumn("over_limit", F.col("n_tokens") > LIMIT)


QUERIES = {"op7_token_counts": op7_token_counts}
ORACLE_SQL: dict[str, str] = {}
