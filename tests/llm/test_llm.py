"""The training-data operators against plain versions, on tables with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm import benchmark_decontamination as bench
from loomgraph.llm import common, context_mixing, embedding_dedup, hashing, hilbert_sharding, language_id, line_dedup, ngram_join, quality_classifier, source_mixing, token_counts

DOC = "doc_id long, text string, lang string, source string, n_chars long, shard string, size string, line string, vec string"
rng = random.Random(11)
WORDS = ["".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 7))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def rows():
    base = prose(120, 1)
    edited = base.split()
    edited[60] = "changed"
    out = [
        (0, base, "en", "a"),
        (1, base, "en", "b"),
        (2, " ".join(edited), "de", "a"),
        (3, base.upper(), None, "c"),
        (4, None, "en", None),
        (5, "", None, "a"),
        (6, "  \n\t ", "en", "a"),
        (7, "one two", "en", "b"),
        (8, "One  TWO", "en", "b"),
        (9, prose(30_000, 2), "de", "a"),
        (10, "123 !! ...", "en", "c"),
        (11, "ÄÖ é 　 x <|endoftext|> y", "fr", "a"),
        (12, prose(40, 3) + "\n" + prose(60, 4) + "\n\n" + prose(40, 3), "en", "a"),
        (13, prose(60, 4) + "\n" + prose(20, 5), "en", "a"),
        (None, base, "en", "a"),
        (14, prose(50, 6), "en", "a"),
        (14, prose(50, 6), "en", "a"),
        (15, prose(50, 7), "de", "b"),
        (15, prose(50, 8), "de", "b"),
    ]
    out += [(100 + i, prose(30 + i, 100 + i), "en" if i % 2 else "de", "abc"[i % 3]) for i in range(20)]
    return [(i, t, lang, s, 1, "x", "y", "z", "w") for i, t, lang, s in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOC).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def words(t):
    return (t or "").encode().lower().split()


# sharding


def test_curve_visits_each_cell_once_by_single_steps():
    for bits, dims in ((3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        place = hilbert_sharding.hilbert_index(grid, bits)
        assert sorted(place) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(place)], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_shards(docs, law):
    got = hilbert_sharding.runs(docs, 4, law).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows())
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    if law == "rows":
        assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    sizes = {(r[0], zlib.crc32((r[1] or "").encode())): len((r[1] or "").encode()) + 1 for r in rows()}
    assert all(sizes[r.doc_id, r.text_crc32] == r.size for r in got)
    shards = [r.shard for r in sorted(got, key=lambda r: r.pos)]
    assert shards == sorted(shards)


def test_names_cells_follow_their_order(spark, monkeypatch):
    names = [f"s{i:03d}" for i in range(300)]
    df = spark.createDataFrame([(n,) for n in names * 2] + [(None,)], "source string").repartition(3)
    for most in (1 << 16, 100):
        monkeypatch.setattr(hilbert_sharding, "NAMES", most)
        bounds = [b.encode() for b in hilbert_sharding.cell_bounds(df, "source", 6)]
        assert 20 <= len(bounds) <= 63 and bounds == sorted(bounds)
        cells = hilbert_sharding.category_cells(pd.Series([None, *names]), bounds, 6).tolist()
        assert cells[0] == 0 and cells[1:] == sorted(cells[1:]) and len(set(cells)) > 20


def test_runs_prune_in_every_dimension(spark):
    """The share of 64 runs that a filter on one value must read: along the curve, and sorted by source alone."""
    r = random.Random(12)
    data = [(i, "x" * int(2 ** r.uniform(0, 12)), "abcdefgh"[r.randrange(8)], f"s{r.randrange(8)}") for i in range(6000)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string").repartition(3)
    place = {x.doc_id: x.pos for x in hilbert_sharding.runs(df, 64, "rows").collect()}
    plain = {i: k for k, (i, *_) in enumerate(sorted(data, key=lambda x: (x[3], x[0])))}

    def read(order):
        shares = []
        for value in (lambda x: x[2], lambda x: x[3], lambda x: len(x[1]).bit_length()):
            runs = {}
            for x in data:
                runs.setdefault(order[x[0]] * 64 // len(data), []).append(value(x))
            ends = [(min(v), max(v)) for v in runs.values()]
            values = sorted({value(x) for x in data})
            shares.append(sum(a <= v <= b for v in values for a, b in ends) / len(ends) / len(values))
        return shares

    curve, one = read(place), read(plain)
    assert all(s < 0.6 for s in curve) and sum(curve) < sum(one)


def test_sharded_documents(docs, empty):
    got = hilbert_sharding.shard_documents(docs, 4)
    assert got.count() == len(rows()) and len(set(got.columns)) == len(got.columns)
    assert hilbert_sharding.runs(empty).count() == 0 and hilbert_sharding.shard_documents(empty).count() == 0


# language model


def test_scores(docs, empty):
    held = common.held_out(F.col("doc_id"), 7, 2)
    got = {(r.doc_id, r.n_tokens): r for r in context_mixing.scored(docs, docs.where(~held)).collect()}
    again = {(r.doc_id, r.n_tokens): r for r in context_mixing.scored(docs, docs.where(~held), ~held).collect()}
    assert all(math.isclose(again[k].score, r.score, rel_tol=1e-3) for k, r in got.items())
    count = Counter()
    for i, t, *_ in rows():
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            count.update([*words(t), b"\n"])
    n, v = sum(count.values()), len(count)
    for i, t, *_ in rows():
        w = [*words(t), b"\n"]
        r = got[i, len(w)]
        assert (r.train_tokens, r.n_known) == (n, sum(count[x] > 0 for x in w))
        if i != 15:
            assert math.isclose(r.base_score, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert r.score < 0 and math.isfinite(r.score)
    assert context_mixing.scored(empty, empty).count() == 0


def test_mixers_learn_from_training_and_follow_a_text(spark):
    df = spark.createDataFrame([(i, prose(200, i) + f" u{i} x{i * i}y") for i in range(60)], "doc_id long, text string").repartition(3)
    model = context_mixing.train(df, common.cut(context_mixing.token_counts(df.union(spark.createDataFrame([(i, f"z{i} k{i}") for i in range(3000)], df.schema)))))
    spelt = model.spelled([b"qjxz"] * 9000)
    assert spelt[-1] < 0.9 * spelt[0]
    # the second part of SPELLED words goes on where the first has ended
    assert len(spelt) == 9000 and abs(spelt[context_mixing.SPELLED] - spelt[context_mixing.SPELLED - 1]) < 0.1 * spelt[0]
    for learned, fresh in zip(model.mixers, context_mixing.fresh_mixers(), strict=True):
        assert any((a != b).any() for a, b in zip(learned.weights, fresh.weights, strict=True))
        assert (learned.ones != fresh.ones).any() and (learned.met == fresh.met).all()


def plain_mixing(model, symbols):
    """One text's bits by a loop over its decisions: what a block has taught holds from the next one on."""
    mixer, tree = model.mixers[0], model.tree
    weights = [w.astype(float).copy() for w in mixer.weights]
    met, ones = mixer.met.copy(), mixer.ones.copy()
    last, before, todo = 0, model.hashed[model.end], []
    for s in symbols.tolist():
        for j in range(tree.lengths[s]):
            node, bit, gate = (x[tree.starts[s] + j] for x in (tree.nodes, tree.bits, tree.gates))
            todo.append(([model.odds[0][node], model.odds[1][last * len(tree.parts) + node], model.odds[2][before * len(tree.parts) + node]], bit, gate))
        last, before = s + 1 if s < min(context_mixing.FREQUENT, model.end) else last, model.hashed[s]
    total, at, size = 0.0, 0, context_mixing.FIRST
    while at < len(todo):
        steps, learned = [np.zeros_like(w) for w in weights], []
        for x, bit, gate in todo[at : at + size]:
            t = min(max(sum(w[gate] * v for w, v in zip(weights, x)), -14), 14)
            p = 1 / (1 + math.exp(-t))
            bin_ = min(max(int((t + 8) * context_mixing.MAP / 16), 0), context_mixing.MAP - 1)
            q = (p + ones[bin_] / met[bin_]) / 2
            total -= math.log2(min(max(q if bit else 1 - q, 1e-6), 1 - 1e-6))
            for step, v in zip(steps, x):
                step[gate] += context_mixing.RATES[0] * (bit - p) * v
            learned.append((bin_, bit))
        weights = [w + s for w, s in zip(weights, steps)]
        for bin_, bit in learned:
            met[bin_] += 1
            ones[bin_] += bit
        at, size = at + size, min(2 * size, context_mixing.BLOCK)
    return total


def test_lanes_are_plain_loops(monkeypatch):
    """Texts that are mixed in step against one loop a text, short ones and one of several pieces."""
    texts = [prose(n, n).encode() for n in (3, 40, 700, 90)] + [None, b"", b"unseen words only"]
    count = Counter(w for t in texts[:4] for w in words(t.decode())).most_common(200)
    counts = np.array([n for _, n in count])
    model = context_mixing.Model(context_mixing.Tree([w for w, _ in count], np.append(counts, [9, 30])), np.append(counts, [9, 0]))
    size, r = model.tree.size, np.random.default_rng(2)
    model.tables = [model.tree.sums(r.integers(0, 9, (n, size))) for n in (1, context_mixing.FREQUENT + 1, context_mixing.BEFORE)]
    model.bytes_met = [(np.ones(k, np.float32), np.zeros(k, np.float32)) for k in context_mixing.SLOTS]
    model.finish()
    s, first, data, places = model.encode(texts)
    parts = np.split(s, first[1:])
    for t, part in zip(texts, parts):
        assert part.tolist() == [model.ids.get(w, model.escape) for w in common.lower_words(t)] + [model.end]
    at = np.flatnonzero(s == model.escape)
    assert context_mixing.word_at(data, places[at]) == [w for t in texts for w in common.lower_words(t) if w not in model.ids]
    want = [plain_mixing(model, part) for part in parts]
    assert np.allclose(model.tree_bits(s, first), want, rtol=2e-4)
    monkeypatch.setattr(context_mixing, "TOKENS", 256)
    assert np.allclose(model.tree_bits(s, first), [plain_mixing(model, p) for p in parts], rtol=0.02)
    # a text of a single block keeps its weights, one of several does not
    assert model.tree_bits(parts[2], np.array([0]))[0] != sum(context_mixing.fresh_mixers()[0].bits(*model.decisions(parts[2]), 0.0, 1 << 30))


def test_bits_are_those_of_a_distribution():
    """Over all symbols of the tree the probabilities sum to one, whatever the context."""
    counts = np.array([50, 20, 7, 3, 1, 4])
    model = context_mixing.Model(context_mixing.Tree([b"a", b"b", b"c", b"d"], counts), np.append(counts[:5], 0))
    tables = [np.random.default_rng(k).integers(0, 9, (n, 6)) for k, n in enumerate((1, context_mixing.FREQUENT + 1, context_mixing.BEFORE))]
    model.tables = [model.tree.sums(t) for t in tables]
    model.bytes_met = [(np.ones(k, np.float32), np.zeros(k, np.float32)) for k in context_mixing.SLOTS]
    model.finish()
    total = sum(2.0 ** -context_mixing.fresh_mixers()[0].bits(*model.decisions(np.array([0, s])), 0, 999)[len(model.tree.nodes[model.tree.starts[0] : model.tree.starts[0] + model.tree.lengths[0]]) :].sum() for s in range(6))
    assert math.isclose(total, 1, rel_tol=1e-6)


# n-gram join


def shingles(t):
    w = words(t)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def reach(ids, linked):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def jaccard_components(data):
    sets = {}
    for i, t in data:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t))

    def linked(a, b):
        return any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b])

    return reach(sorted(sets), linked)


def test_ngram_components(docs, empty):
    want = jaccard_components([(r[0], r[1]) for r in rows()])
    got = ngram_join.ngram_components(docs).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted((str(i), len(shingles(t)), str(want.get(i))) for i, t, *_ in rows())
    assert ngram_join.ngram_components(empty).count() == 0


def test_ngram_groups_of_near_copies(spark):
    """A hundred edits of one text, some of them chained only through others, and short sets at the edge of 0.8."""
    r = random.Random(3)
    base = prose(90, 50).split()
    data = []
    for i in range(100):
        w = list(base)
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(90)] = f"e{r.randrange(40)}"
        data.append((i, " ".join(w)))
    data += [(200 + i, " ".join(WORDS[i : i + n])) for n in (5, 6, 7, 8, 9, 10, 13, 14) for i in range(8)]
    data = list(dict(data).items())
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    want = jaccard_components(data)
    assert {x.doc_id: x.component_id for x in ngram_join.ngram_components(df).collect()} == want


@pytest.mark.parametrize("block", [8, 4096])
def test_trees_join_parts(spark, block):
    sets = [(0, i, np.unique(np.random.default_rng(i // 3).integers(0, 1 << 40, 40) + (np.arange(40) == i % 3) * i).astype(np.uint64)) for i in range(40)]
    df = spark.createDataFrame([(b, i, s.tobytes()) for b, i, s in sets], "block long, doc_id long, hashes binary")
    edges = {(r.a, r.b) for r in ngram_join.tree_links(df, block).collect()}
    by = {i: set(s.tolist()) for _, i, s in sets}
    want = reach(range(40), lambda a, b: 100 * len(by[a] & by[b]) >= 80 * len(by[a] | by[b]))
    assert reach(range(40), lambda a, b: (a, b) in edges or (b, a) in edges) == want


# quality


def test_quality(spark, empty):
    data = [(i, prose(80, i) if i % 2 else "BUY!! NOW!! " * 30 + str(i), "en", "a", 1, "", "", "", "") for i in range(400)] + [(400, None, None, None, 1, "", "", "", ""), (401, "", None, None, 1, "", "", "", ""), (None, "x", None, None, 1, "", "", "", "")]
    docs = spark.createDataFrame(data, DOC)
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(3, None), (None, 1)], "doc_id long, quality int")
    got = quality_classifier.quality_scores(docs, labels).collect()
    assert len(got) == len(data) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum((r.score >= 0.5) == bool(r.doc_id % 2) for r in held) >= 0.98 * len(held)
    assert quality_classifier.quality_scores(empty, labels).count() == 0
    none = quality_classifier.quality_scores(docs, labels.limit(0)).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]


def test_scores_are_those_of_one_system(spark):
    """The fit against all rows in one matrix, and the calibration against the greatest least mean of later bins."""
    r = np.random.default_rng(4)
    x = r.normal(size=(300, quality_classifier.STATISTICS))
    y = (x[:, 0] + 0.3 * r.normal(size=300) > 0).astype(float)
    df = spark.createDataFrame([(i, a.tolist(), b) for i, (a, b) in enumerate(zip(x, y.tolist()))], "id long, x array<double>, y double").repartition(3)
    fold = {q.id: q.f == 0 for q in df.select("id", F.pmod(F.xxhash64("id"), F.lit(quality_classifier.FOLDS)).alias("f")).collect()}
    late = np.array([fold[i] for i in range(300)])
    scorer = quality_classifier.fit(df)
    fourier = quality_classifier.Fourier(x.mean(0), x.std(0))
    z, target = fourier(x[~late]), y[~late]
    w = np.linalg.solve(z.T @ z + quality_classifier.RIDGE * len(z) * np.eye(z.shape[1]) / quality_classifier.FEATURES, z.T @ target)
    assert np.allclose(scorer.weights, w)
    bins = quality_classifier.BINS
    at = np.minimum(((np.clip(fourier(x[late]) @ w, -0.5, 1.5) + 0.5) / 2 * bins).astype(int), bins - 1)
    seen = np.unique(at)
    ones, rows_of = np.array([y[late][at == b].sum() for b in seen]), np.array([(at == b).sum() for b in seen])
    mean = lambda i, j: ones[i : j + 1].sum() / rows_of[i : j + 1].sum()
    plain = [max(min(mean(i, j) for j in range(k, len(seen))) for i in range(k + 1)) for k in range(len(seen))]
    assert np.allclose(scorer.curve[seen], plain)
    order = np.argsort(scorer.raw(x))
    assert (np.diff(scorer(x)[order]) >= -1e-12).all()


def test_isotonic():
    got = quality_classifier.isotonic(np.array([1.0, 0, 3, 1]), np.array([2.0, 2, 4, 1]))
    assert got.tolist() == [0.25, 0.25, 0.75, 1.0]


# decontamination


def plain_hits(text, items):
    w = bench.item_words((text or "").encode())
    hit, found = set(), set()
    for item, t in items:
        b = bench.item_words((t or "").encode())
        n = min(10, len(b))
        for k in range(max(1, len(b) - 9) if b else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == b[k : k + n]:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [3, 200_000])
def test_hits(spark, docs, empty, block):
    items = [(0, prose(120, 1)), (1, "ONE, two!"), (2, None), (3, ""), (4, prose(12, 3)), (10, " ".join(prose(60, 4).split()[5:17])), (11, " ".join(prose(60, 4).split()[5:17])), (5, "äö É")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = Counter(tuple(r) for r in bench.digest(bench.hits(docs, table, block=block)).collect())
    assert got == Counter((r[0], *plain_hits(r[1], items)) for r in rows())
    assert bench.hits(empty, table).count() == 0
    assert not any(r.contaminated for r in bench.digest(bench.hits(docs, table.limit(0))).collect())


# lines


def cleaned(data):
    lines = []
    for i, t in data:
        for k, x in enumerate((t or "").split("\n") if t is not None else []):
            if words(x):
                lines.append((i, k, shingles(x)))
    lines.sort(key=lambda x: x[:2])
    gone = set()
    for j, (i, k, s) in enumerate(lines):
        if any(100 * len(s & o) >= 80 * len(s | o) for _, _, o in lines[:j]):
            gone.add((i, k))
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in data}


def test_lines(spark, empty):
    r = random.Random(8)
    base = prose(60, 70).split()
    data = [(0, None), (1, ""), (2, "a b c d\na b c d"), (3, "\n\n"), (4, prose(7, 1) + "\n" + prose(7, 1).upper() + "\n" + prose(7, 2))]
    for i in range(5, 60):
        w = list(base)
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(60)] = f"q{r.randrange(9)}"
        data.append((i, " ".join(w) + "\n" + prose(20, i) + "\n" + prose(9, 1)))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert {x.doc_id: x.text for x in line_dedup.clean_lines(df).collect()} == cleaned(data)
    assert line_dedup.clean_lines(empty).count() == 0


def test_lines_of_repeated_rows(docs):
    assert line_dedup.clean_lines(docs).count() == len(rows())


def test_lines_in_small_batches(spark, monkeypatch):
    r = random.Random(14)
    data = [(i, "\n".join(prose(r.randrange(0, 30), r.randrange(40)) for _ in range(r.randrange(1, 30)))) for i in range(60)]
    monkeypatch.setattr(line_dedup, "BATCH", 600)
    held = list(line_dedup.pieces(iter([pa.RecordBatch.from_pydict({"d": [i for i, _ in data], "text": [t for _, t in data]})])))
    back = {i: [] for i, _ in data}
    for (i,), line, part in (x for h in held for x in h):
        assert len(back[i]) == line
        back[i] += part.decode().split("\n")
    assert {i: "\n".join(x) for i, x in back.items()} == {i: t for i, t in data}
    monkeypatch.setattr(line_dedup, "BUCKET", 1 << 12)
    monkeypatch.setattr(line_dedup, "PART", 2)
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert {x.doc_id: x.text for x in line_dedup.clean_lines(df).collect()} == cleaned(data)


def test_prefixes_of_lines(spark):
    """Frequent tokens alone come last in the order, not those near them."""
    df = spark.createDataFrame([([1, 2, 3, 4, 5, 6],), ([7, 8, 9],), (None,)], "tokens array<long>")
    for frequent, want in (([1, 3, *range(100, 120)], [[2, 4, 5, 6], [7, 8, 9], None]), ([2, -(1 << 63)], [[1, 3, 4, 5], [7, 8, 9], None]), ([], [[1, 2, 3, 4], [7, 8, 9], None])):
        assert sorted((r.prefix for r in line_dedup.with_prefixes(df, frequent).collect()), key=str) == sorted(want, key=str)


def test_lower_case_of_lines(spark):
    """A-Z alone in lower case, whatever else a text holds, by way of JSON."""
    texts = ["\u00c0\u00c9 \x00\x01 A\"B\\C\\U00DC \\N x/Y\tZ\r\n\u2028\u03a9\U0001f600 \u0130I \u017fK \x7f\x85\u00a0Q\ufeff\uffffE", "{\"T\": 1}\u00c4", "\u1e9eS'\b\f", "\u00dc", "", "ABC", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    want = [t and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in texts]
    assert [r.low for r in df.select(line_dedup._lower("text").alias("low")).collect()] == want


def test_bins_of_lines(spark):
    """Bins never part lines that match, and part nearly all others before their sets are met."""
    r = random.Random(21)
    sets = []
    for n in [r.randrange(1, 120) for _ in range(60)]:
        own = {r.getrandbits(64) - (1 << 63) for _ in range(n)}
        for k in range(n // 4 + 2):
            fewer = set(r.sample(sorted(own), max(1, n - k)))
            sets.append((own, fewer | {r.getrandbits(64) - (1 << 63) for _ in range(r.randrange(2))}))
        sets.append((own, {r.getrandbits(64) - (1 << 63) for _ in range(n)}))
    rows = [(i, 9 * len(a & b) >= 4 * (len(a) + len(b)), sorted(a), sorted(b)) for i, (a, b) in enumerate(sets)]
    df = spark.createDataFrame(rows, "i long, same boolean, a array<long>, b array<long>")
    both = [df.select("i", "same", F.col(x).alias("tokens")).select("i", "same", F.size("tokens").alias(f"n{x}"), *(c.alias(f"{x}{k}") for k, c in enumerate(line_dedup._odd_bins()))) for x in "ab"]
    met = both[0].join(both[1].drop("same"), "i").withColumn("near", line_dedup._near(F.col("na"), F.col("nb"), ("a0", "b0"), ("a1", "b1"))).collect()
    assert len(met) == len(rows) and all(x.near for x in met if x.same) and sum(x.same for x in met) > 400
    assert sum(x.near and not set(sets[x.i][0]) & set(sets[x.i][1]) for x in met) <= 3


def test_lines_of_rows_whose_short_hashes_are_equal(spark):
    texts = [f"alpha beta gamma delta number {n} zeta eta theta" for n in (125493, 158551)]
    df = spark.createDataFrame([(0, texts[0]), (None, texts[0]), (None, texts[1])], "doc_id long, text string")
    assert len({r.h for r in df.select(F.hash("text").alias("h")).collect()}) <= 2
    got = Counter((r.doc_id, r.text) for r in line_dedup.clean_lines(df).collect())
    assert got == Counter([(0, texts[0]), (None, ""), (None, texts[1])])


def test_lines_run_no_python(docs):
    plan = line_dedup.clean_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_lines_with_frequent_tokens(spark, monkeypatch):
    r = random.Random(31)
    passage = prose(12, 5)
    data = [(i, "\n".join([passage + " " + prose(r.randrange(0, 40), 100 + i % 23), "\t" + passage.upper() + "  " + prose(3, i % 7) + " ", "a a a a a a a" + " a" * (i % 3), "b c"])) for i in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert line_dedup.frequent_tokens(df, 1)
    monkeypatch.setattr(line_dedup, "PART", 2)
    assert {x.doc_id: x.text for x in line_dedup.clean_lines(df).collect()} == cleaned(data)


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    r = random.Random(3)
    text = "".join(r.choice("abAB é\n\t  ") for _ in range(5000)).encode()
    start, h = hashing.word_hashes(np.frombuffer(text, np.uint8))
    found = [text[s:].split(None, 1)[0].lower() for s in start.tolist()]
    assert found == text.lower().split()
    assert len(set(h.tolist())) == len(set(found)) == len(set(zip(found, h.tolist())))
    monkeypatch.setattr(hashing, "PIECE", 7)
    again = hashing.word_hashes(np.frombuffer(text, np.uint8))
    assert (again[0] == start).all() and (again[1] == h).all()


def test_near_lines_of_null_ids_and_repeated_rows(spark):
    first = prose(40, 21)
    near = first.split()
    near[-1] = "changed"
    other = prose(40, 22)
    data = [(None, " ".join(near)), (None, " ".join(near)), (0, first), (7, first + "\n" + other), (7, first + "\n" + other), (None, None)]
    got = line_dedup.clean_lines(spark.createDataFrame(data, "doc_id long, text string")).collect()
    # null ids are last, so the near line goes; rows that repeat are cleaned alike
    want = [(None, 1, 1, "")] * 2 + [(0, 1, 0, first)] + [(7, 2, 1, other)] * 2 + [(None, 0, 0, None)]
    assert Counter(map(tuple, got)) == Counter(want)


# tokens


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_counts.default_vocabulary())
    got = Counter(tuple(r) for r in token_counts.token_counts(docs).collect())
    assert got == Counter((r[0], len((r[1] or "").encode()), len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows())
    assert token_counts.token_counts(empty).count() == 0


def test_token_counts_of_long_pre_tokens(spark, monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_counts.default_vocabulary())
    monkeypatch.setattr(token_counts, "CACHED", 500)
    data = [(i, ("ab" * 400 if i % 3 else "xyz ") * (i % 5) + f" tail{i} " + "q" * 300) for i in range(60)]
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(spark.createDataFrame(data, "doc_id long, text string").repartition(2)).collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in data}
    with pytest.raises(ValueError):
        token_counts.checked(b'{"pre_tokenizer": {"type": "Whitespace"}}')


# languages


def test_suffix_automaton_holds_all_substrings():
    text = b"abracadabra"
    go = language_id.suffix_automaton(text)
    for word in {text[i:j] for i in range(len(text)) for j in range(i, len(text) + 1)} | {b"ac ", b"abb", b"raa"}:
        state = 0
        for c in word:
            state = go[state].get(c, -1) if state >= 0 else -1
        assert (state >= 0) == (word in text)


def test_phrases_are_the_longest_matches():
    samples = {"x": b"the cat sat on the mat", "y": b"le chat est assis"}
    texts = [b"the chat sat", b"", b"zz the", b"mat on cat " * 300]

    def count(t, s):
        n = 0
        for at in range(0, len(t), language_id.SEGMENT):
            part, i = t[at : at + language_id.SEGMENT], 0
            while i < len(part):
                j = i + 1
                while j < len(part) and part[i : j + 1] in s:
                    j += 1
                n, i = n + 1, j
        return n

    got = language_id.Parser(samples).phrases(texts)
    assert got.tolist() == [[count(t, samples[k]) for k in sorted(samples)] for t in texts]


def test_languages(spark, docs, empty):
    def text(lang, i):
        r = random.Random(f"{lang}{i}")
        return " ".join(r.choice({"p": ["kalo", "mira", "tonu"], "q": ["strch", "vlnk", "prst"]}[lang]) for _ in range(20))

    data = [(i, text("pq"[i % 2], i), "pq"[i % 2], "a", 1, "", "", "", "") for i in range(200)]
    df = spark.createDataFrame(data, DOC)
    got = language_id.identify(df, language_id.samples(language_id.training_rows(df))).collect()
    assert all(r.lang_pred == "pq"[r.doc_id % 2] and 0.5 <= r.score <= 1 for r in got)
    found = Counter((r.doc_id, r.lang_pred == "und") for r in language_id.identify(docs, {"en": b"one two three", "de": b"eins zwei"}).collect())
    assert found == Counter((r[0], not any(c.isalpha() for c in r[1] or "")) for r in rows())
    assert language_id.identify(empty, {}).count() == 0
    assert {r.lang_pred for r in language_id.identify(df, {}).collect()} == {"und"}


def test_languages_of_unequal_samples():
    r = random.Random(5)
    stems = {"p": ["kalo", "mira", "tonu", "sela", "ravi"], "q": ["strch", "vlnk", "prst", "zmrz", "chrt"]}
    text = lambda lang, n: " ".join(r.choice(stems[lang]) + r.choice("aeiou") for _ in range(n))
    samples = {"p": text("p", 9000).encode(), "q": text("q", 60).encode()}
    # a long sample in which one of the small language's words in ten is met too
    samples["p"] += b" ".join(text("q", 1).encode() for _ in range(900))
    parser = language_id.Parser(samples)
    texts = [text("pq"[i % 2], 40) for i in range(60)]
    names, scores = parser.predict(texts)
    plain = parser.phrases([t.encode() for t in texts])
    want = [min(zip(row * (1 + np.log2([len(samples[k]) + 1 for k in "pq"])), "pq"))[1] for row in plain]
    assert names == want and names[1::2].count("q") >= 15 and names[::2].count("p") == 30
    assert all(0.5 <= s <= 1 for s in scores)


def test_samples_pass_over_headers_copies_and_texts_without_letters(spark):
    header, own = "licence terms apply " * 60, {"p": "kalo mira tonu ", "q": "strch vlnk prst "}
    data = [(i, header + own["pq"[i % 2]] * 400, "pq"[i % 2]) for i in range(10)]
    got = language_id.samples(spark.createDataFrame(data, "doc_id long, text string, lang string"), 1)
    assert b"kalo" in got["p"] and b"vlnk" in got["q"]
    data = [(i, "kalo mira", "p") for i in range(300)] + [(i, "1 2", "p") for i in range(300, 600)] + [(i, None, "p") for i in range(600, 700)]
    data += [(700, "tonu", "p"), (701, "9 " * 3000 + "vlnk", "q")]
    got = language_id.samples(spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3), 2)
    assert sorted(got["p"].split()) == [b"kalo", b"mira", b"tonu"] and got["q"] == b"vlnk"


def test_texts_with_letters_stay_where_no_language_is_known(spark):
    df = spark.createDataFrame([(1, "kalo mira", None), (2, "12 !", None), (3, None, None), (None, "ü", None)], "doc_id long, text string, lang string")
    assert {r.doc_id for r in language_id.keep_identified(df).collect()} == {1, None}


# mixing


def test_mixing(docs, empty):
    got = source_mixing.taken_words(docs).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((r[0], r[3], len(words(r[1]))) for r in rows())
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    total = sum(size.values())
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    want, free = dict.fromkeys(size, 0.0), set(size)
    while True:
        left = total - sum(want[s] for s in size if s not in free)
        for s in free:
            want[s] = left * weights[s] / sum(weights[x] for x in free)
        over = {s for s in free if want[s] > 3 * size[s]}
        if not over:
            break
        for s in over:
            want[s] = 3.0 * size[s]
        free -= over
    for s in size:
        assert math.isclose(target[s], want[s], rel_tol=1e-9, abs_tol=1e-9)
        assert abs(taken[s] - want[s]) <= 0.5 + 1e-6
    assert source_mixing.taken_words(empty).count() == 0


def test_rare_sources_take_their_targets(spark):
    big = [(i, "w " * 100_000, "abc"[i % 3]) for i in range(90)]
    small = [(100 * k + i, "v " * (n // 10), f"r{k}") for k, n in enumerate((10, 100, 300, 1000, 3000), 1) for i in range(10)]
    df = spark.createDataFrame(big + small, "doc_id long, text string, source string").repartition(4)
    per = source_mixing.taken_words(df).groupBy("source", "source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert len(per) == 8
    for r in per:
        assert abs(r.taken - r.target) <= 0.5 and r.taken > 0
    copies = Counter(r.source for r in source_mixing.mix_documents(df).collect())
    assert all(copies[r.source] == 10 * r.target / r.source_size for r in per if r.source not in "abc")


def test_mixed_documents(docs, empty):
    got = source_mixing.mix_documents(docs)
    assert got.columns == docs.columns and got.count() > 0
    assert source_mixing.mix_documents(empty).count() == 0


def test_tiny_sources_beside_huge_ones(spark):
    sized = spark.createDataFrame([("a", 16_000_000, 9), ("b", 9, 3), ("c", 1, 1), (None, 70, 7)], "source string, size long, n int")
    targets = source_mixing.source_targets(sized)
    per = {r.source: r for r in targets.collect()}
    words = {r.source: r.words for r in source_mixing.schedule(spark, targets).groupBy("source").agg(F.sum("words").alias("words")).collect()}
    assert words == {s: r.goal for s, r in per.items()} and words["b"] > 0


def test_repeated_rows_share_copies(spark):
    data = [(1, "x " * 50, "r", i) for i in range(300)] + [(2, "y " * 30_000, "q", 0), (3, "z " * 30_000, "p", 0)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, n int").repartition(4)
    taken = sum(r.taken // r.size + (2 * (r.taken % r.size) >= r.size) for r in source_mixing.taken_words(df).where("doc_id = 1").collect())
    copies = Counter(r.n for r in source_mixing.mix_documents(df).where("doc_id = 1").collect())
    assert sum(copies.values()) == taken and max(copies.values()) - min(copies.values() if len(copies) == 300 else [0]) <= 1


# embeddings


def test_embeddings(spark):
    r = np.random.default_rng(5)
    centres = r.normal(size=(6, 16))
    data = [(i, [float(x) for x in np.float32(centres[i % 6] + r.normal(size=16) * 0.08 * (i % 4))], i % 2) for i in range(120)]
    data += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, [float("inf")] * 16, 1), (204, [None] + [1.0] * 15, 1), (205, data[0][1], None), (206, data[0][1], 0), (207, data[0][1][:8], 0), (208, [], 0)]
    df = spark.createDataFrame([(*x, "extra") for x in data], "vec_id long, embedding array<float>, label int, copies string").repartition(3)

    def sound(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    by = {i: (np.array(v, float), k) for i, v, k in data if sound(v) and k is not None}

    def linked(a, b):
        (x, k), (y, m) = by.get(a, (None, None)), by.get(b, (None, None))
        return x is not None and y is not None and k == m and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98

    ids = [x[0] for x in data]
    want = reach(ids, linked)
    for block in (1024, 7):
        got = embedding_dedup.near_duplicates(df, block=block).collect()
        assert {x.vec_id: (x.n_links, x.component_id, x.kept) for x in got} == {i: (sum(linked(min(i, j), max(i, j)) for j in ids if j != i), want[i], want[i] == i) for i in ids}
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


# shared


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    got = {x.node: x.component for x in common.components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    forest = common.Forest()
    for a, b in pairs:
        forest.join(a, b)
    assert got == dict(forest.links())


def test_pipeline_stages(spark, tmp_path):
    """Each stage against what it should keep of its own input."""
    data = [r[:5] for r in rows()]
    path = str(tmp_path)
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    item = prose(120, 1)
    spark.createDataFrame([(1, " ".join(prose(60, 4).split()[10:30]))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = [r for r in corpus_pipeline.language_id(spark, docs, path).collect()]
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(i) for i, t, *_ in data if any(c.isalpha() for c in t or ""))
    one = sorted(str(r.doc_id) for r in corpus_pipeline.ngram_join(spark, docs, path).collect())
    want = jaccard_components([(r[0], r[1]) for r in data])
    assert one == sorted([str(i) for i, c in want.items() if i == c] + ["None"])
    clean = {r.doc_id for r in corpus_pipeline.decontamination(spark, docs, path).collect()}
    assert {r[0] for r in data} - clean == {12, 13}
    assert item
    done = corpus_pipeline.run(spark, path)
    assert {"shard", "curve_index", "text"} <= set(done.columns) and done.count() > 0
