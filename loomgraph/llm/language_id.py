"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds every substring of a bounded sample of its
labelled text.  A text is parsed greedily into the longest phrases that occur in the
sample (Ziv and Merhav's cross parsing); the language that needs the fewest normalised phrases wins: a phrase is a pointer
into the sample, so it counts as the logarithm of the sample's length, and a language is not favoured for having more of it.
All languages and many stretches of text are parsed in step, as lanes of NumPy arrays.

A text is normalised to its words in lower case (A-Z only) without ASCII digits and
signs, and parsed in stretches of SEGMENT bytes, whole: a phrase ends at its stretch's
end, alike for all languages.

Defined cases: a null text, or one without a letter of any script, is ``und`` with score 0; so
is every text if no labelled row was given; of languages with equally few normalised phrases the
first by name wins; rows with a null doc_id count as training rows; repeated rows are
predicted row by row; an empty table gives an empty result; other columns play no
part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, held_out, read

#: The sample: at most so many texts of a language, and characters of a window of each.
TEXTS, CHARS = 64, 1024
SEGMENT = 1024
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}").search
_PLAIN = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 32 for b in range(256))


def normalised(text: str) -> bytes:
    return b" ".join(text.encode("utf-8", "replace").lower().translate(_PLAIN).split())


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings (Blumer et al.); state 0 is the start."""
    go: list[dict[int, int]] = [{}]
    length, link, last = [0], [-1], 0
    for c in text:
        new = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return go


class Parser:
    """The automata of all languages in one table: ``table[state * width + code]``, -1 where a phrase ends."""

    def __init__(self, samples: dict[str, bytes]) -> None:
        self.languages = sorted(samples)
        #: What a phrase counts: the bits of a pointer into the sample, and one.
        self.cost = np.array([1 + np.log2(len(samples[k]) + 1) for k in self.languages])
        used = sorted(set().union(*samples.values())) if samples else []
        self.width = len(used) + 2  # codes: 0 pads, 1 is met in no sample
        self.codes = np.ones(256, np.uint8)
        for k, b in enumerate(used, 2):
            self.codes[b] = k
        tables, self.roots, self.ends, n = [], [], [], 0
        for name in self.languages:
            go = suffix_automaton(samples[name])
            table = np.full((len(go) + 1, self.width), -1, np.int32)  # the last state goes nowhere: after a byte that the sample lacks
            at = [(s, int(self.codes[c]), t) for s, edges in enumerate(go) for c, t in edges.items()]
            s, c, t = np.array(at, np.int64).reshape(-1, 3).T
            table[s, c] = t + n
            tables.append(table)
            self.roots.append(n)
            n += len(go) + 1
            self.ends.append(n - 1)
        self.table = (np.concatenate(tables) if tables else np.zeros((0, self.width), np.int32)).ravel()
        # a phrase that ends begins anew with the byte that ended it
        start = np.array([self.table[r * self.width : (r + 1) * self.width] for r in self.roots], np.int32).reshape(-1, self.width)
        self.start = np.where(start < 0, np.array(self.ends, np.int32).reshape(-1, 1), start).astype(np.int32)

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases of each text (rows) under each language (columns)."""
        sizes = np.array([len(t) for t in texts], np.int64)
        segments = np.maximum(1, -(-sizes // SEGMENT))
        first = np.cumsum(segments) - segments
        grid = np.zeros((int(segments.sum()), SEGMENT), np.uint8)
        flat = grid.ravel()
        for t, at in zip(texts, (first * SEGMENT).tolist(), strict=True):
            flat[at : at + len(t)] = self.codes[np.frombuffer(t, np.uint8)]
        # long lanes first, so that short ones can leave
        filled = np.minimum(SEGMENT, np.repeat(sizes, segments) - SEGMENT * (np.arange(len(grid)) - np.repeat(first, segments)))
        order = np.argsort(-filled, kind="stable")
        columns = np.ascontiguousarray(grid[order].T).astype(np.int32)
        alive = np.searchsorted(-filled[order], -np.arange(SEGMENT), side="left")
        out = np.zeros((len(self.languages), len(grid)), np.int64)
        for k, end in enumerate(self.ends):
            state, count, start = np.full(len(grid), end, np.int32), np.zeros(len(grid), np.int32), self.start[k]
            for i in range(SEGMENT):
                n = alive[i]
                if not n:
                    break
                code = columns[i, :n]
                to = self.table.take(state[:n] * self.width + code) if len(self.table) < 1 << 31 else self.table[state[:n].astype(np.int64) * self.width + code]
                ended = to < 0
                count[:n] += ended
                state[:n] = np.where(ended, start.take(code), to)
            out[k, order] = count
        return np.add.reduceat(out, first, axis=1).T

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        kept = [i for i, t in enumerate(texts) if t and _LETTER(t)] if self.languages else []
        if not kept:
            return names, scores
        plain = [normalised(texts[i]) for i in kept]
        table = self.phrases(plain) * self.cost
        best = table.argmin(axis=1)
        for row, (i, b) in enumerate(zip(kept, best.tolist(), strict=True)):
            p = table[row]
            names[i] = self.languages[b]
            other = float(np.delete(p, b).min()) if len(p) > 1 else max(8.0 * len(plain[row]), float(p[b]))
            scores[i] = other / (other + float(p[b])) if other > 0 else 0.5
        return names, scores


def samples(labelled: DataFrame, texts: int = TEXTS, chars: int = CHARS) -> dict[str, bytes]:
    """Normalised text of each language: a window at a hashed offset of each of a bounded sample of texts.

    The sample is the texts of the smallest hashes of doc_id, of those that differ and hold a letter; a window without
    a letter gives way to the text from its first letter on.
    """
    text = F.col("text")
    rows = labelled.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("key"), F.xxhash64("doc_id").alias("hash"))
    rows = rows.where(text.rlike(r"\p{L}"))
    by_hash = Window.partitionBy("lang").orderBy("hash", "key")
    keys = rows.groupBy("lang", "key").agg(F.min("hash").alias("hash")).withColumn("k", F.row_number().over(by_hash)).where(F.col("k") <= texts)
    # as few rows as the sample that is collected
    met = rows.drop("hash").join(F.broadcast(keys), ["lang", "key"])
    offset = F.pmod(F.xxhash64("key"), F.greatest(F.lit(1), F.length("text") - (chars - 1)))
    window = text.substr((offset + 1).cast("int"), F.lit(chars))
    part = F.when(window.rlike(r"\p{L}"), window).otherwise(F.regexp_extract("text", rf"(?s)\p{{L}}.{{0,{chars - 1}}}", 0))
    found: dict[str, list[bytes]] = {}
    for r in met.groupBy("lang", "k").agg(F.min(part).alias("part")).orderBy("lang", "k").collect():
        found.setdefault(r.lang, []).append(normalised(r.part))
    return {k: joined for k, v in found.items() if (joined := b" ".join(x for x in v if x))}


_PARSERS: dict[int, Parser] = {}


def identify(docs: DataFrame, learned: dict[str, bytes]) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row."""
    held = docs.sparkSession.sparkContext.broadcast(learned)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(tuple(sorted(held.value.items())))
        if key not in _PARSERS:
            _PARSERS.clear()
            _PARSERS[key] = Parser(held.value)
        for batch in batches:
            for part in chunks(batch, "text"):
                names, scores = _PARSERS[key].predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out(F.col("doc_id"), 3, 1))


def keep_identified(docs: DataFrame) -> DataFrame:
    """Documents with a language; those that are ``und`` go.  The texts pass through Python once and are not shuffled.

    Where no language could be learned, as no training row has a label, texts that hold a letter stay.
    """
    names = docs.columns
    held = docs.sparkSession.sparkContext.broadcast(samples(training_rows(docs)))
    text = names.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(tuple(sorted(held.value.items())))
        if key not in _PARSERS:
            _PARSERS.clear()
            _PARSERS[key] = Parser(held.value)
        for batch in batches:
            for part in chunks(batch, "text"):
                texts = part.column(text).to_pylist()
                if held.value:
                    found = [x != UNKNOWN for x in _PARSERS[key].predict(texts)[0]]
                else:
                    found = [bool(t and _LETTER(t)) for t in texts]
                yield part.filter(pa.array(found, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = identify(docs, samples(training_rows(docs)))
    return found.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")


QUERIES = {"op8_language_id": op8_language_id}
ORACLE_SQL: dict[str, str] = {}
