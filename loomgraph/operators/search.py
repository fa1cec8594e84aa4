"""Lexical and vector search over nodes.

A few nodes are searched by a scan; many by an index of postings: which nodes hold a word, and which words hold a
pair of characters, and where.  A query then reads the postings of its own pairs alone.  Two words that are k edits apart share at least
``longer + 1 - 2 k`` pairs (with their margins) at places no more than k apart, and differ in length by k at most; so a word that
does not is left out, and edit distance is computed for the others only.  What a token is contained in holds all of
its pairs.  The scores are those of the scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the searched fields.
FIELDS = {"name": 0.4, "tags": 0.3, "summary": 0.2, "language_notes": 0.1}
THRESHOLD = 0.4


def word_distance(words: Column, token: str, within: int) -> Column:
    """The least edit distance of a word to the token, null beyond within."""
    best = F.array_min(F.transform(words, lambda w: F.when(F.levenshtein(w, F.lit(token), within) >= 0, F.levenshtein(w, F.lit(token), within))))
    return best


def _within(token: str) -> int:
    """Edits that a token may be away."""
    return max(1, int(len(token) * THRESHOLD))


def field_score(field: Column, token: str) -> Column:
    """0 for an equal field, up to 1: contained, then near in edits; null where neither."""
    low = F.lower(field)
    within = _within(token)
    near = word_distance(F.filter(F.split(low, "[^a-z0-9#_]+"), lambda w: w != ""), token, within)
    return F.when(low == token, 0.0).when(low.contains(token), F.lit(0.1)).when(near.isNotNull(), 0.2 + near / float(max(1, len(token))) * 0.8)


def fuzzy(nodes: DataFrame, query: str, types: list[str] = (), k: int = 50) -> DataFrame:
    """``id, score``: each word of the query counts for itself; a node's score is the best over words of its weighted fields, 0 is best.

    A blank query finds nothing; the type filter comes after the search.
    """
    tokens = query.lower().split()
    if not tokens:
        return nodes.sparkSession.createDataFrame([], "id string, score double")
    best = None
    for token in tokens:
        parts = [(w, field_score(F.col(c) if c != "tags" else F.array_join("tags", " "), token)) for c, w in FIELDS.items() if c in nodes.columns]
        hit = parts[0][1].isNotNull()
        total = F.lit(0.0)
        for w, s in parts:
            total = total + w * F.coalesce(s, F.lit(1.0))
            hit = hit | s.isNotNull()
        one = F.when(hit, F.round(total / sum(w for w, _ in parts), 6))
        best = one if best is None else F.least(best, one)
    found = nodes.select("id", "type", "ord", best.alias("score")).where("score is not null")
    if types:
        found = found.where(F.col("type").isin(list(types)))
    return found.orderBy("score", "ord").limit(k).select("id", "score")


#: What stands before and after a word when its pairs are cut.
_BEGIN, _END = "\x02", "\x03"


def _pairs(text: str) -> list[str]:
    return [text[k : k + 2] for k in range(len(text) - 1)]


def _pairs_of(word: Column) -> Column:
    places = F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1)))
    return F.transform(places, lambda k: F.substr(word, k, F.lit(2)))


@dataclass
class Index:
    """Postings: ``entries`` (id, type, ord, field, chunk, word, alone: the chunk is the whole field), ``words`` (pair, at, word, length) with margins, ``chunks`` (pair, chunk)."""

    entries: DataFrame
    words: DataFrame
    chunks: DataFrame
    weights: dict[str, float]

    def write(self, folder: str) -> Index:
        """Written in order of its pairs and words, so that a query's part of a file is found by its statistics."""
        spark = self.entries.sparkSession
        for name, key in (("entries", "word"), ("words", "pair"), ("chunks", "pair")):
            df = getattr(self, name)
            df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(f"{folder}/{name}")
        read = lambda name: spark.read.schema(getattr(self, name).schema).parquet(f"{folder}/{name}")
        return Index(read("entries"), read("words"), read("chunks"), self.weights)


def index(nodes: DataFrame) -> Index:
    """Postings of the searched fields of nodes (``id, type, ord`` and any of the fields)."""
    present = {c: w for c, w in FIELDS.items() if c in nodes.columns}
    texts = [nodes.select("id", "type", "ord", F.lit(c).alias("field"), F.lower(F.col(c) if c != "tags" else F.array_join("tags", " ")).alias("low")) for c in present]
    low = reduce(DataFrame.unionByName, texts)
    chunks = low.select("id", "type", "ord", "field", "low", F.explode(F.array_distinct(F.split("low", r"\s+"))).alias("chunk")).where("chunk != ''")
    words = F.filter(F.array_distinct(F.split("chunk", "[^a-z0-9#_]+")), lambda w: w != "")
    entries = chunks.select("id", "type", "ord", "field", "chunk", F.explode_outer(words).alias("word"), (F.col("low") == F.col("chunk")).alias("alone"))
    padded = F.concat(F.lit(_BEGIN), "word", F.lit(_END))
    of_words = entries.where("word is not null").select("word").distinct().select("word", F.length("word").alias("length"), F.posexplode(_pairs_of(padded)).alias("at", "pair"))
    of_chunks = entries.select("chunk").distinct().select("chunk", F.explode(F.array_distinct(_pairs_of(F.col("chunk")))).alias("pair"))
    return Index(entries, of_words.select("pair", "at", "word", "length"), of_chunks.select("pair", "chunk"), present)


def near_words(postings: DataFrame, token: str) -> DataFrame:
    """``word, near`` of the words within the token's edits, from the postings of its pairs."""
    within, spark = _within(token), postings.sparkSession
    own = _pairs(_BEGIN + token + _END)
    sized = postings.where(F.col("length").between(len(token) - within, len(token) + within))
    needed = F.greatest("length", F.lit(len(token))) + 1 - 2 * within
    if len(token) + 1 - 2 * within > 0:
        mine = spark.createDataFrame(list(enumerate(own)), "place int, pair string")
        met = sized.where(F.col("pair").isin(sorted(set(own)))).join(F.broadcast(mine), "pair").where(F.abs(F.col("at") - F.col("place")) <= within)  # a token's pairs
        some = met.groupBy("word", "length").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= needed)
    else:  # a token of one letter: no pair need be shared
        some = sized.select("word", "length").distinct()
    near = F.levenshtein("word", F.lit(token), within)
    return some.select("word", near.alias("near")).where("near >= 0")


def holding_chunks(postings: DataFrame, token: str) -> DataFrame:
    """``chunk`` of those that contain the token, from the postings of its pairs."""
    own = sorted(set(_pairs(token)))
    if own:
        some = postings.where(F.col("pair").isin(own)).groupBy("chunk").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(own))
    else:
        some = postings.select("chunk").distinct()
    return some.select("chunk").where(F.col("chunk").contains(token))


def indexed(found: Index, query: str, types: list[str] = (), k: int = 50) -> DataFrame:
    """What ``fuzzy`` finds, by the index."""
    spark = found.entries.sparkSession
    tokens = sorted(set(query.lower().split()))
    if not tokens:
        return spark.createDataFrame([], "id string, score double")
    weights, total = F.create_map(*[F.lit(x) for pair in found.weights.items() for x in pair]), sum(found.weights.values())
    scored = []
    for token in tokens:
        by_word = found.entries.join(near_words(found.words, token), "word").select("id", "type", "ord", "field", (0.2 + F.col("near") / float(len(token)) * 0.8).alias("s"))
        whole = F.when(F.col("alone") & (F.col("chunk") == token), 0.0).otherwise(0.1)
        by_chunk = found.entries.join(holding_chunks(found.chunks, token), "chunk").select("id", "type", "ord", "field", whole.alias("s"))
        best = by_word.unionByName(by_chunk).groupBy("id", "type", "ord", "field").agg(F.min("s").alias("s"))
        # a field that holds nothing near counts as 1
        scored.append(best.groupBy("id", "type", "ord").agg(F.round(1 - F.sum(weights[F.col("field")] * (1 - F.col("s"))) / total, 6).alias("score")))
    rows = reduce(DataFrame.unionByName, scored).groupBy("id", "type", "ord").agg(F.min("score").alias("score"))
    if types:
        rows = rows.where(F.col("type").isin(list(types)))
    return rows.orderBy("score", "ord").limit(k).select("id", "score")


def chat_context(found: Index, nodes: DataFrame, edges: DataFrame, members: DataFrame, query: str, k: int = 15) -> dict[str, DataFrame]:
    """What a question is about: ``hits`` (id, score), ``nodes`` (the hits and what is an edge away), ``edges`` among them and their ``layers``."""
    from .graph import induced, neighbours, touched_layers

    hits = indexed(found, query, k=k)
    around = neighbours(edges, F.broadcast(hits.select("id")))  # k rows at most
    return {"hits": hits, "nodes": nodes.join(around, "id", "left_semi"), "edges": induced(edges, around, few=True), "layers": touched_layers(members, around)}


def cosine(a: Column, b: list[float]) -> Column:
    """Cosine with a constant vector; 0 where either has no length."""
    q = F.array(*[F.lit(float(x)) for x in b])
    norm = sum(x * x for x in b) ** 0.5
    v = F.transform(a, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(v, q, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when((length == 0) | F.lit(norm == 0), 0.0).otherwise(dot / (length * norm))


def semantic(vectors: DataFrame, query: list[float], threshold: float = 0.0, k: int = 10) -> DataFrame:
    """``id, score`` (1 - cosine) of the k nearest, those without a vector left out; a top-k, not a sort of all."""
    found = vectors.where("vec is not null").select("id", F.round(cosine(F.col("vec"), query), 6).alias("similarity"))
    return found.where(F.col("similarity") >= threshold).select("id", (1 - F.col("similarity")).alias("score")).orderBy("score", "id").limit(k)
