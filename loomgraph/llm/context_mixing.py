"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is its words and one end (see ``op2``).  It is coded as binary decisions:

* the place of each token in a Huffman tree over the LEXICON most frequent training
  tokens, the end, and an escape for all others;
* for each escaped word whether training held it, by its share of the escaped tokens
  if so, else by its bytes and a blank, bit by bit.

Every decision has several predictors, counts of ones under a hashed context: for the
tree no context, the last of the most frequent words, and the hashed token before; for
bytes the one, two and four bytes before.  Their log-odds are added with weights that
a gate picks (depth in the tree, or bit of the byte), the weights follow the error
online, and an adaptive map refines the mixed probability.  The sum of -log2 is the
text's bits.

What is counted comes from all training rows: token counts (shuffled), and tables of
fixed size that tasks sum and a tree merges.  Weights and maps of both mixers are learned
over all training rows (of bytes, over all their words outside the lexicon), each
decision's own count left out: the mean of what tasks reach, so they vary a little with
how rows are dealt to tasks.  Each text starts from them, and both mixers follow it block
by block: short texts too, as the first block has FIRST decisions.  Many texts' mixers run in step, as lanes.

Defined cases: a null text is an empty one, that is its end alone; rows with a null
doc_id are training rows with a null id in the result; repeated rows train and are
scored row by row; an empty training set leaves N = 0 and even odds; an empty table
gives an empty result; other columns play no part.
"""

from __future__ import annotations

import heapq
import math
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, chunks, cut, held_out, lower_words, merged, read
from .hashing import word_hashes

LEXICON = 1 << 16
#: Contexts of the tree: classes of the last frequent word (one more for none), and hashed tokens before.
FREQUENT, BEFORE = 63, 32
#: Slots of the byte predictors' tables.
SLOTS = (1 << 16, 1 << 17, 1 << 18)
DEPTHS, MAP = 24, 64
#: Counts below which a training decision's own is left out.
FEW = 256
#: How fast weights follow: tree and bytes, while training and inside a text; and the decisions between two steps.
RATES_TRAINING, RATES, BLOCK = (2e-5, 2e-4), (2e-2, 1e-3), 1024
#: A text's first block in the tree; each is twice the one before, up to BLOCK.
FIRST = 128
#: Tokens of one text whose decisions are held at a time.
TOKENS = 1 << 16
#: Words that are spelled at a time.
SPELLED = 4096
#: Words outside the lexicon whose counts are broadcast too; those of all others are joined.
COUNTED = 1 << 17
HELD = 1 << 19
#: Bytes of text that train the mixers at a time.
TRAINED = 1 << 19
_END = b"\n"  # no word holds it


def token_counts(docs: DataFrame) -> DataFrame:
    """``word, c`` over all rows, ends included; tasks sum before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        held: Counter[bytes] = Counter()
        for batch in batches:
            for part in chunks(batch, "text"):
                for text in bytes_of(part.column(0)):
                    held.update(lower_words(text))
                held[_END] += len(part)
                if len(held) > HELD:
                    yield out()
                    held = Counter()
        yield out()

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


class Tree:
    """Huffman tree over symbols: the lexicon by falling count, then end, then escape."""

    def __init__(self, words: list[bytes], counts: np.ndarray) -> None:
        self.words, self.size = words, len(counts)
        heap = [(max(1, int(c)), k) for k, c in enumerate(counts)]
        heapq.heapify(heap)
        self.parts: list[tuple[int, int]] = []  # inner node k: its two parts; parts from size on are inner nodes
        while len(heap) > 1:
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (a + b, self.size + len(self.parts)))
            self.parts.append((x, y))
        n = len(self.parts)
        up, bit, depth = np.full(self.size + n, -1), np.zeros(self.size + n, np.int8), np.zeros(self.size + n, np.int64)
        for k in range(n - 1, -1, -1):
            for b, x in enumerate(self.parts[k]):
                up[x], bit[x], depth[x] = k, b, depth[self.size + k] + 1
        self.lengths = depth[: self.size]
        self.starts = np.cumsum(self.lengths) - self.lengths
        total = int(self.lengths.sum())
        self.nodes, self.bits = np.zeros(total, np.intp), np.zeros(total, np.int8)
        at, x = self.starts + self.lengths - 1, np.arange(self.size)
        while len(x):  # all symbols climb together
            inside = up[x] >= 0
            at, x = at[inside], x[inside]
            self.nodes[at], self.bits[at] = up[x], bit[x]
            at, x = at - 1, self.size + up[x]
        self.gates = np.minimum(np.arange(total) - np.repeat(self.starts, self.lengths), DEPTHS - 1)

    def sums(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of counts (contexts, symbols): how often each inner node was met and its second part taken; a few contexts at a time."""
        n = len(self.parts)
        met, ones = np.zeros((len(counts), n), np.float32), np.zeros((len(counts), n), np.float32)
        second = np.array([y for _, y in self.parts], np.int64)
        for at in range(0, len(counts), 8):
            part = counts[at : at + 8]
            every = np.zeros((self.size + n, len(part)), np.float64)
            every[: self.size] = part.T
            for k, (x, y) in enumerate(self.parts):
                every[self.size + k] = every[x] + every[y]
            met[at : at + 8] = every[self.size :].T
            ones[at : at + 8] = every[second].T
        return met, ones


def word_at(data: bytes, starts: np.ndarray) -> list[bytes]:
    """The lower-case words that start at these places."""
    out = []
    for s in starts.tolist():
        size = 64
        while len(part := data[s : s + size].split(None, 1)) == 1 and s + size < len(data):
            size *= 8
        out.append(part[0].lower())
    return out


def log_odds(ones: np.ndarray, met: np.ndarray, prior: np.ndarray | float, strength: float) -> np.ndarray:
    p = (ones + strength * prior) / (met + strength)
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p)).astype(np.float32)


def byte_contexts(words: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Slots in each table, the bit, and its place in the byte, of all bits of the words with a blank after each."""
    flat = np.frombuffer(b" ".join(words) + b" ", np.uint8).astype(np.uint32) if words else np.zeros(0, np.uint32)
    n = len(flat)
    fresh = np.concatenate([[True], flat[:-1] == 32]) if n else np.zeros(0, bool)
    begin = np.maximum.accumulate(np.where(fresh, np.arange(n), 0)) if n else np.zeros(0, int)
    inside = np.arange(n) - begin
    before = []
    for j in range(1, 5):
        prior = np.concatenate([np.zeros(min(j, n), np.uint32), flat[: max(0, n - j)]])
        before.append(np.where(inside >= j, prior, 0))
    one = before[0]
    two = one | before[1] << 8
    four = two | before[2] << 16 | before[3] << 24
    shift = np.arange(8, dtype=np.uint32)
    partial = ((flat[:, None] | 256) >> (8 - shift)).astype(np.uint32)  # the bits before, under a leading one
    bits = (flat[:, None] >> (7 - shift) & 1).astype(np.int8)
    slots = [
        (one[:, None] << 8 | partial) & (SLOTS[0] - 1),
        (((two[:, None] << 8 | partial) * np.uint32(0x9E3779B1)) >> 13) & (SLOTS[1] - 1),
        (((four[:, None] * np.uint32(0x85EBCA6B) ^ partial) * np.uint32(0xC2B2AE35)) >> 11) & (SLOTS[2] - 1),
    ]
    return [s.ravel().astype(np.int64) for s in slots], bits.ravel(), np.tile(shift, n).astype(np.int64)


#: The middles of the adaptive map's bins, as probabilities, and the decisions that they stand for at first.
_MIDDLES = 1 / (1 + np.exp(-((np.arange(MAP) + 0.5) * 16 / MAP - 8)))
PRIOR = 64.0


def _map_bins(t: np.ndarray) -> np.ndarray:
    return np.maximum(np.minimum((t + 8) * (MAP / 16), MAP - 1), 0).astype(np.int64)


class Mixer:
    """Gated weights, and the adaptive map behind them; both follow a text as it is coded."""

    def __init__(self, weights: tuple[float, ...], gates: int) -> None:
        self.weights = [np.full(gates, w, np.float32) for w in weights]  # of each predictor, by gate
        self.met = np.full(MAP, PRIOR)
        self.ones = PRIOR * _MIDDLES

    def begun(self) -> Mixer:
        """A copy that follows a text."""
        own = object.__new__(Mixer)
        own.weights, own.met, own.ones = [w.copy() for w in self.weights], self.met.copy(), self.ones.copy()
        return own

    def learn(self, n: int, weights: list[np.ndarray], met: np.ndarray, ones: np.ndarray) -> None:
        """Starts from weights summed over n rows and from what the map has met; the map still follows a text as fast."""
        self.weights = [(w / n).astype(np.float32) for w in weights]
        self.ones = PRIOR * (ones + PRIOR * _MIDDLES) / (met + PRIOR)
        self.met = np.full(MAP, PRIOR)

    def bits(self, x: list[np.ndarray], y: np.ndarray, gate: np.ndarray, rate: float, block: int, more: bool = False) -> np.ndarray:
        """Bits of each of the decisions y, in order; what a block teaches holds from the next one on (more: there are others after y)."""
        came = np.empty(len(y), np.float32)  # probability of the bit that came
        one = y.astype(np.float32)
        zero = 1 - one
        for s in range(0, len(y), block):
            e = s + block
            gs = gate[s:e]
            t = self.weights[0].take(gs) * x[0][s:e]
            for w, xk in zip(self.weights[1:], x[1:], strict=True):
                own = w.take(gs)
                own *= xk[s:e]
                t += own
            np.maximum(np.minimum(t, 14, out=t), -14, out=t)
            p = np.exp(-t)
            p += 1
            np.reciprocal(p, out=p)
            at = _map_bins(t)
            q = (self.ones / self.met).astype(np.float32).take(at)
            q += p
            q *= np.float32(0.5)
            np.subtract(zero[s:e], q, out=q)
            np.abs(q, out=came[s:e])
            if more or e < len(y):
                wrong = one[s:e] - p
                for w, xk in zip(self.weights, x, strict=True):
                    w += (rate * np.bincount(gs, wrong * xk[s:e], len(w))).astype(np.float32)
                at += MAP * y[s:e]
                zeros, ones = np.bincount(at, minlength=2 * MAP).reshape(2, MAP)
                self.ones += ones
                self.met += zeros + ones
        # 1e-6 off either end
        np.maximum(np.minimum(came, np.float32(1 - 1e-6), out=came), np.float32(1e-6), out=came)
        cost = np.log2(came, out=came)
        np.negative(cost, out=cost)
        return cost


class Lanes:
    """A mixer for each of several texts, all begun alike, that follow their texts in step; one text's results are those of a mixer of its own."""

    def __init__(self, mixer: Mixer, texts: int) -> None:
        self.gates = len(mixer.weights[0])
        self.weights = [np.tile(w, texts) for w in mixer.weights]
        self.met, self.ones = np.tile(mixer.met, texts), np.tile(mixer.ones, texts)
        self.block = FIRST

    def bits(self, x: list[np.ndarray], y: np.ndarray, gate: np.ndarray, counts: np.ndarray, rate: float) -> np.ndarray:
        """Bits of the decisions y, those of each text one after the other (counts of them); a call goes on where the last one ended."""
        came = np.empty(len(y), np.float32)
        start, at = np.cumsum(counts) - counts, 0
        while len(lanes := np.flatnonzero(counts > at)):
            size = np.minimum(counts[lanes] - at, self.block)
            index = np.repeat(start[lanes] + at - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            lane = np.repeat(lanes, size)
            slot = lane * self.gates + gate.take(index)
            xs = [v.take(index) for v in x]
            t = np.zeros(len(index), np.float32)
            for w, v in zip(self.weights, xs, strict=True):
                t += w.take(slot) * v
            np.maximum(np.minimum(t, 14, out=t), -14, out=t)
            p = np.exp(-t)
            p += 1
            np.reciprocal(p, out=p)
            bins = _map_bins(t)
            bins += lane * MAP
            one = y.take(index).astype(np.float32)
            q = (self.ones.take(bins) / self.met.take(bins)).astype(np.float32)
            q += p
            q *= np.float32(0.5)
            came[index] = np.abs(1 - one - q)
            wrong = one - p
            for w, v in zip(self.weights, xs, strict=True):
                w += (rate * np.bincount(slot, wrong * v, len(w))).astype(np.float32)
            self.met += np.bincount(bins, minlength=len(self.met))
            self.ones += np.bincount(bins, one, len(self.ones))
            at += self.block
            self.block = min(2 * self.block, BLOCK)
        np.maximum(np.minimum(came, np.float32(1 - 1e-6), out=came), np.float32(1e-6), out=came)
        return -np.log2(came, out=came)


def tree_mixer() -> Mixer:
    """For the tree, before training."""
    return Mixer((-0.3, 0.8, 0.5), DEPTHS)


def byte_mixer() -> Mixer:
    """For bytes, before training."""
    return Mixer((0.2, 0.4, 0.5), 8)


def fresh_mixers() -> list[Mixer]:
    return [tree_mixer(), byte_mixer()]


class Model:
    """What is broadcast: the lexicon with its counts, and the predictors' tables."""

    def __init__(self, tree: Tree, counts: np.ndarray) -> None:
        self.tree, self.counts = tree, counts
        self.ids = {w: k for k, w in enumerate(tree.words)}
        n = len(tree.words)
        self.end, self.escape = n, n + 1
        self.hashed = np.array([zlib.crc32(w) % BEFORE for w in tree.words] + [zlib.crc32(_END) % BEFORE, 0], np.int64)
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []  # met, ones: (contexts * nodes) of each tree predictor
        self.bytes_met: list[tuple[np.ndarray, np.ndarray]] = []
        self.rare: dict[bytes, int] = {}
        self.mixers = fresh_mixers()
        self._index()

    def _index(self) -> None:
        """Symbols by the words' hashes: a table by the first bits of a hash gives the place where its run of sorted hashes begins."""
        start, h = word_hashes(np.frombuffer(b" ".join(self.tree.words), np.uint8))
        order = np.argsort(h)
        self.hashes, self.places = np.append(h[order], np.uint64(0)), np.append(order, 0)
        self.first = np.searchsorted(h[order], np.arange(1 << 18, dtype=np.uint64) << np.uint64(46))
        self.run = int(np.bincount((h >> np.uint64(46)).astype(np.int64), minlength=1).max()) if len(h) else 0

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("ids", "hashes", "places", "first")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.ids = {w: k for k, w in enumerate(self.tree.words)}
        self._index()

    def known(self, h: np.ndarray) -> np.ndarray:
        """Symbols of words by their hashes; the escape for those outside the lexicon."""
        out = np.full(len(h), self.escape, np.int64)
        at = self.first.take((h >> np.uint64(46)).astype(np.int64))
        for j in range(self.run):
            place = np.minimum(at + j, len(self.hashes) - 1)
            hit = (self.hashes.take(place) == h) & (place < len(self.hashes) - 1)
            out[hit] = self.places[place[hit]]
        return out

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray]:
        """Symbols of all texts, each with its end; where each text's begin; the texts joined, and where in them each symbol's word starts (-1 for ends)."""
        data = b"\n".join(t or b"" for t in texts)
        start, h = word_hashes(np.frombuffer(data, np.uint8))
        upto = np.searchsorted(start, np.cumsum([len(t or b"") + 1 for t in texts]))
        ends = upto + np.arange(len(texts))  # places of the ends among all symbols
        symbols, places = np.full(len(h) + len(texts), self.end, np.int64), np.full(len(h) + len(texts), -1, np.int64)
        inner = np.ones(len(symbols), bool)
        inner[ends] = False
        symbols[inner], places[inner] = self.known(h), start
        return symbols, np.concatenate([[0], ends[:-1] + 1]).astype(np.int64), data, places

    def contexts(self, symbols: np.ndarray) -> list[np.ndarray]:
        n = len(symbols)
        frequent = np.where((symbols < FREQUENT) & (symbols < self.end), np.arange(n), -1)
        last = np.concatenate([[-1], np.maximum.accumulate(frequent)[:-1]])
        first = np.where(last >= 0, symbols[last] + 1, 0)
        before = np.concatenate([[self.hashed[self.end]], self.hashed[symbols[:-1]]])
        return [np.zeros(n, np.int64), first, before]

    def finish(self) -> None:
        """Log-odds of all tables, for scoring."""
        p0 = None
        self.odds = []
        for met, ones in self.tables:
            if p0 is None:
                p0 = ((ones + 0.4) / (met + 0.8)).ravel()
                self.odds.append(log_odds(ones, met, 0.5, 0.8).ravel())
            else:
                self.odds.append(log_odds(ones, met, p0, 2.0).ravel())
        self.byte_odds = [log_odds(ones, met, 0.5, 0.5) for met, ones in self.bytes_met]

    def all_contexts(self, symbols: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """Contexts of all texts' symbols; those of a text know nothing of the text before."""
        n = len(symbols)
        begin = np.repeat(first, np.diff(np.append(first, n)))
        frequent = np.where((symbols < FREQUENT) & (symbols < self.end), np.arange(n), -1)
        last = np.concatenate([[-1], np.maximum.accumulate(frequent)[:-1]]) if n else frequent
        one = np.where(last >= begin, symbols[last] + 1, 0)
        before = np.concatenate([[self.hashed[self.end]], self.hashed[symbols[:-1]]]) if n else frequent
        before[first] = self.hashed[self.end]
        return [np.zeros(n, np.int64), one, before]

    def tree_bits(self, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Bits of each text in the tree; the mixers follow all texts in step, and of very long ones some tokens at a time."""
        counts = np.diff(np.append(first, len(symbols)))
        contexts, out = self.all_contexts(symbols, first), np.zeros(len(first))
        lanes = Lanes(self.mixers[0], len(first))
        for at in range(0, int(counts.max()) if len(counts) else 0, TOKENS):
            size = np.clip(counts - at, 0, TOKENS)
            whole = size.sum() == len(symbols)
            index = slice(None) if whole else np.repeat(first + at - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            part = symbols[index]
            x, bit, gate = self.decisions(part, contexts=[c[index] for c in contexts])
            owner = np.repeat(np.arange(len(first)), size)
            made = np.bincount(owner, self.tree.lengths[part], len(first)).astype(np.int64)
            cost = lanes.bits(x, bit, gate, made, RATES[0])
            out += np.bincount(np.repeat(np.arange(len(first)), made), cost, len(first))
        return out

    def decisions(self, symbols: np.ndarray, own: bool = False, contexts: list[np.ndarray] | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Log-odds of each predictor, bits and gates of the tree's decisions; own: a training text's, each token's own count left out."""
        tree = self.tree
        lengths = tree.lengths[symbols]
        total = int(lengths.sum())
        at = np.repeat(tree.starts[symbols] - (np.cumsum(lengths) - lengths), lengths)
        at += np.arange(total)
        node = tree.nodes.take(at)
        inner = len(tree.parts)
        slots = [node]
        for c in (self.contexts(symbols) if contexts is None else contexts)[1:]:
            slot = np.repeat(c * inner, lengths)
            slot += node
            slots.append(slot)
        bit = tree.bits.take(at)
        if not own:
            x = [odds.take(slot) for odds, slot in zip(self.odds, slots, strict=True)]
        else:
            # a decision's own count matters where there are few: there the log-odds are made anew
            x = [odds.take(slot) for odds, slot in zip(self.odds, slots, strict=True)]
            for k, ((met, ones), slot) in enumerate(zip(self.tables, slots, strict=True)):
                met, ones = met.ravel(), ones.ravel()
                few = np.flatnonzero(met.take(slot) < FEW)
                there, mine = slot[few], bit[few]
                m, o = np.maximum(met.take(there) - 1, 0), np.maximum(ones.take(there) - mine, 0)
                if k == 0:
                    x[k][few] = log_odds(o, m, 0.5, 0.8)
                else:
                    m0, o0 = self.tables[0][0].ravel().take(node[few]) - 1, self.tables[0][1].ravel().take(node[few]) - mine
                    x[k][few] = log_odds(o, m, (np.maximum(o0, 0) + np.float32(0.4)) / (np.maximum(m0, 0) + np.float32(0.8)), 2.0)
        return x, bit, tree.gates.take(at)

    def spelled(self, words: list[bytes]) -> np.ndarray:
        """Bits of each word's bytes and blank; the words are those of one text, in order, which the mixer follows."""
        mixer, out = self.mixers[1].begun(), [np.zeros(0)]
        for k in range(0, len(words), SPELLED):
            part = words[k : k + SPELLED]
            slots, bit, place = byte_contexts(part)
            x = [o.take(s) for o, s in zip(self.byte_odds, slots, strict=True)]
            cost = mixer.bits(x, bit, place, RATES[1], BLOCK, k + SPELLED < len(words))
            out.append(np.add.reduceat(cost, np.cumsum([0, *(8 * len(w) + 8 for w in part[:-1])])))
        return np.concatenate(out)

    def spell_training(self, words: list[bytes], mixer: Mixer) -> None:
        """The mixer follows words that training has held; each was counted once, which is left out."""
        slots, bit, place = byte_contexts(words)
        x = [log_odds(np.maximum(ones.take(s) - bit, 0), np.maximum(met.take(s) - 1, 0), 0.5, 0.5) for (met, ones), s in zip(self.bytes_met, slots, strict=True)]
        mixer.bits(x, bit, place, RATES_TRAINING[1], 4 * BLOCK, True)


def _sparse(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(x)
    return at.astype(np.uint32), x[at].astype(np.int64)


def _pack(sizes: list[int], arrays: list[np.ndarray]) -> bytes:
    return zlib.compress(pickle.dumps((sizes, [_sparse(x) for x in arrays])), 1)


def _unpack(blob: bytes) -> list[np.ndarray]:
    sizes, parts = pickle.loads(zlib.decompress(blob))
    out = []
    for size, (at, n) in zip(sizes, parts, strict=True):
        x = np.zeros(size, np.int64)
        x[at] = n
        out.append(x)
    return out


def _add(blobs: list[bytes]) -> bytes:
    a, b = map(_unpack, blobs)
    return _pack([len(x) for x in a], [x + y for x, y in zip(a, b, strict=True)])


def _emit(blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"blob": pa.array([blob], pa.binary())})


def train(docs: DataFrame, vocabulary: DataFrame) -> Model:
    """Symbols under their contexts, spellings of the words outside the lexicon, and the mixers over both again."""
    sc = docs.sparkSession.sparkContext
    # words met once stand for those yet unseen: they are escaped, and their spellings are learned
    top = vocabulary.where((F.col("word") != F.lit(_END)) & (F.col("c") > 1)).orderBy(F.desc("c"), "word").limit(LEXICON + COUNTED).toArrow()
    names, counted = top.column("word").to_pylist(), np.asarray(top.column("c"), np.int64)
    del top
    total = vocabulary.agg(F.sum("c"), F.sum(F.when(F.col("word") == F.lit(_END), F.col("c")))).first()
    words, counts = names[:LEXICON], counted[:LEXICON]
    ends = int(total[1] or 0)
    escapes = int(total[0] or 0) - ends - int(counts.sum())
    model = Model(Tree(words, np.append(counts, [ends, escapes])), np.append(counts, [ends, 0]))
    size = model.tree.size
    shapes = (FREQUENT + 1, BEFORE)
    held = sc.broadcast(model)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        tables = [np.zeros(k * size, np.int64) for k in shapes]
        for batch in batches:
            for part in chunks(batch, "text"):
                s, first, _, _ = m.encode(bytes_of(part.column(0)))
                for table, c in zip(tables, m.all_contexts(s, first)[1:], strict=True):
                    table += np.bincount(c * size + s, minlength=len(table))
        yield _emit(_pack([len(t) for t in tables], tables))

    blob = merged(docs.select("text").mapInArrow(gather, "blob binary"), _add)
    symbols = [x.reshape(k, size) for x, k in zip(_unpack(blob), shapes, strict=True)] if blob else [np.zeros((k, size), np.int64) for k in shapes]
    model.tables = [model.tree.sums(x) for x in (symbols[0].sum(axis=0, keepdims=True), *symbols)]
    del blob, symbols

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        tables = [np.zeros(k, np.int64) for k in (*SLOTS, *SLOTS)]
        for batch in batches:
            every = [w for w in batch.column(0).to_pylist() if w not in m.ids and w != _END]
            for at in range(0, len(every), 20_000):
                slots, bit, _ = byte_contexts(every[at : at + 20_000])
                for k, s in enumerate(slots):
                    tables[k] += np.bincount(s, minlength=SLOTS[k])
                    tables[k + len(SLOTS)] += np.bincount(s, bit, SLOTS[k]).astype(np.int64)
        yield _emit(_pack([len(t) for t in tables], tables))

    blob = merged(vocabulary.select("word").mapInArrow(spell, "blob binary"), _add)
    tables = _unpack(blob) if blob else [np.zeros(k, np.int64) for k in (*SLOTS, *SLOTS)]
    model.bytes_met = [(tables[k].astype(np.float32), tables[k + len(SLOTS)].astype(np.float32)) for k in range(len(SLOTS))]
    held.destroy()
    model.finish()
    learned = sc.broadcast(model)

    def reached(n: int, mixer: Mixer) -> pa.RecordBatch:
        return _emit(pickle.dumps((n, [n * w.astype(np.float64) for w in mixer.weights], mixer.met - PRIOR, mixer.ones - PRIOR * _MIDDLES)))

    def mix_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, mixer, n = learned.value, tree_mixer(), 0
        for batch in batches:
            for part in chunks(batch, "text", TRAINED):
                s, first, _, _ = m.encode(bytes_of(part.column(0)))
                contexts = m.all_contexts(s, first)
                for k in range(0, len(s), TOKENS):
                    some = slice(k, k + TOKENS)
                    mixer.bits(*m.decisions(s[some], True, [c[some] for c in contexts]), RATES_TRAINING[0], 4 * BLOCK, True)
                n += len(s)
        if n:
            yield reached(n, mixer)

    def mix_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, mixer, n = learned.value, byte_mixer(), 0
        for batch in batches:
            every = [w for w in batch.column(0).to_pylist() if w not in m.ids and w != _END]
            for k in range(0, len(every), SPELLED):
                m.spell_training(every[k : k + SPELLED], mixer)
            n += len(every)
        if n:
            yield reached(n, mixer)

    def both(blobs: list[bytes]) -> bytes:
        (n, w, *s), (k, v, *t) = map(pickle.loads, blobs)
        return pickle.dumps((n + k, [a + b for a, b in zip(w, v, strict=True)], *(a + b for a, b in zip(s, t, strict=True))))

    for mixer, rows in zip(model.mixers, (docs.select("text").mapInArrow(mix_trees, "blob binary"), vocabulary.select("word").mapInArrow(mix_bytes, "blob binary")), strict=True):
        if blob := merged(rows, both):
            mixer.learn(*pickle.loads(blob))
    learned.destroy()
    model.bytes_met = []
    model.tables = []
    model.rare = dict(zip(names[LEXICON:], counted[LEXICON:].tolist(), strict=True))
    return model


_FLAT = "word binary, row long, tf long, spelt double, doc_id long, n_tokens long, n_known long, base double, bits double, n_bytes long"


def scored(docs: DataFrame, training: DataFrame, trained: Column | None = None) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` of every row of docs.

    ``trained`` tells rows of docs that are training rows too: all of their words are known, so none needs to be spelled.
    """
    vocabulary = cut(token_counts(training))
    n, v, once = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.count(F.when(F.col("c") == 1, 1))).first()
    model = train(training, vocabulary)
    # of escaped words, how many training has held (Good and Turing's estimate); each of those by its share
    escaped = max(1, int(n) - int(model.counts.sum()))
    share = float(np.clip(1 - (once + 1) / (escaped + 2), 0.01, 0.99))
    held = docs.sparkSession.sparkContext.broadcast(model)
    per = float(n + v + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        row = TaskContext.get().partitionId() << 40
        logs = np.append(np.log10((m.counts[:-1] + 1) / per), 0.0)
        known = np.append(m.counts[:-1] > 0, False)
        own = {w: (math.log10((c + 1) / per), -math.log2(share * c / escaped)) for w, c in m.rare.items()}
        for batch in batches:
            for part in chunks(batch, "text", TRAINED):
                word, key, tf, spelt, rows = [], [], [], [], []
                texts, told = bytes_of(part.column(1)), part.column(2).to_pylist()
                s, first, data, places = m.encode(texts)
                bases, tree, met = np.add.reduceat(logs[s], first).tolist(), m.tree_bits(s, first).tolist(), np.add.reduceat(known[s].astype(np.int64), first).tolist()
                escapes = np.flatnonzero(s == m.escape)
                outside, parted = word_at(data, places[escapes]), np.searchsorted(escapes, np.append(first, len(s))).tolist()
                sizes = np.diff(np.append(first, len(s))).tolist()
                for j, (doc_id, text) in enumerate(zip(part.column(0).to_pylist(), texts, strict=True)):
                    base, bits, seen = bases[j], tree[j], met[j]
                    rare: list[bytes] = []
                    for w in outside[parted[j] : parted[j + 1]]:
                        if (got := own.get(w)) is not None:
                            base, bits, seen = base + got[0], bits + got[1], seen + 1
                        else:
                            rare.append(w)
                    # spelled in the text's order; the join tells which of them training has held
                    others: dict[bytes, list[float]] = {}
                    for w, x in zip(rare, [0.0] * len(rare) if told[j] else m.spelled(rare).tolist(), strict=True):
                        k = others.setdefault(w, [0, 0.0])
                        k[0] += 1
                        k[1] += x
                    word += others
                    key += [row] * len(others)
                    tf += [x[0] for x in others.values()]
                    spelt += [x[1] for x in others.values()]
                    rows.append((row, doc_id, sizes[j], seen, base, bits, len(text or b"")))
                    row += 1
                k, r = len(word), len(rows)
                # a row's own figures come under a key that no word has, so they are spread over all tasks
                word += [_END + x[0].to_bytes(8, "big") for x in rows]
                cols = list(zip(*rows, strict=True))
                pad = [None] * k
                yield pa.RecordBatch.from_arrays(
                    [pa.array(word, pa.binary()), pa.array(key + list(cols[0]), pa.int64()), pa.array(tf + [0] * r, pa.int64()), pa.array(spelt + [0.0] * r, pa.float64())]
                    + [pa.array(pad + list(c), t) for c, t in zip(cols[1:], (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()), strict=True)],
                    names=[x.split()[0] for x in _FLAT.split(", ")],
                )

    flat = docs.select("doc_id", "text", F.coalesce(F.lit(False) if trained is None else trained, F.lit(False)).alias("trained")).mapInArrow(score, _FLAT)
    met = flat.join(vocabulary, "word", "left")
    c, tf = F.coalesce(F.col("c"), F.lit(0)), F.col("tf")
    base = F.coalesce("base", tf * F.log10((c + 1) / F.lit(per)))
    bits = F.coalesce("bits", F.when(c > 0, tf * -F.log2(c * F.lit(share / escaped))).otherwise(F.col("spelt") - tf * F.lit(math.log2(1 - share))))
    known = F.coalesce("n_known", F.when(c > 0, tf).otherwise(0))
    summed = met.groupBy("row").agg(
        F.sum("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum(known).alias("n_known"), F.sum(base).alias("base_score"), F.sum(bits).alias("bits"), F.sum("n_bytes").alias("n_bytes")
    )
    return summed.select(
        "doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", (-F.col("bits") * math.log10(2)).alias("score"),
        (F.col("bits") / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )


def op2_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    learned = ~held_out(F.col("doc_id"), 7, 2)
    found = scored(docs, docs.where(learned), learned)
    return found.withColumn("held_out", held_out(F.col("doc_id"), 7, 2))


QUERIES = {"op2_context_mixing": op2_context_mixing}
ORACLE_SQL: dict[str, str] = {}
