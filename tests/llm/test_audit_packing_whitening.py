"""Filter audit, packing and whitening against plain versions; context mixing beyond its lexicon."""

import json
import math
import random
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from loomgraph.llm import best_fit_packing as packing
from loomgraph.llm import common, context_mixing, embedding_whitening, filter_audit
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, part string, n long, mask string, words string, digest string, length string, sequence_id string"
rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdefgß") for _ in range(rng.randrange(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def rows():
    long = prose(260, 1)
    out = [
        (1, long, "en"), (2, long, "en"), (3, long + " #", "de"), (4, None, "en"), (5, "", None), (6, " \n\t ", ""), (7, "A b", "de"), (8, "A b", "fr"),
        (9, "Ab " * 300, "en"), (10, long.upper(), "en"), (11, prose(9000, 3), "de"), (None, long, "en"), (None, long, None), (12, prose(230, 4), "en"), (12, prose(230, 4), "en"),
        (13, prose(230, 5) + "|", None), (0, prose(230, 5) + "|", "de"), (14, "é 　x <|endoftext|> y\x1c z  ", "fr"), (15, "x" * 30_000, "de"),
    ]
    out += [(20 + k, prose(150 + 10 * k, 50 + k), "en" if k % 2 else "de") for k in range(12)] + [(40 + k, prose(230, 4), "en") for k in range(5)]
    return [(i, t, lang, "p", 1, "m", "w", "d", "l", "s") for i, t, lang in out]


LABELS = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 1, 0), (9, 1, 1), (9, 0, None), (12, 1, 0), (13, None, 1), (21, 1, 0), (23, 1, None), (40, 1, 1), (None, 1, 1), (99, 1, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOC).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


# filter audit


def failures(data):
    out = []
    for r in data:
        doc_id, text = r[0], r[1] or ""
        w = text.encode().split()
        copy = doc_id is not None and any(o[0] is not None and o[0] < doc_id and (o[1] or "") == text for o in data)
        upper = sum("A" <= c <= "Z" for c in text)
        out.append({"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * upper > 3 * len(text), "D": any(c in "#$%&*|" for c in text), "E": copy})
    return out


def plain_audit(data, labels):
    fails, good, toxic = failures(data), set(), set()
    for i, q, t in labels:
        if i is not None:
            good |= {i} if q == 1 else set()
            toxic |= {i} if t == 1 else set()
    want = {}
    for part in {r[2] or "" for r in data}:
        own = [k for k, r in enumerate(data) if (r[2] or "") == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            alive = own
            for step, f in enumerate(order, 1):
                gone = [k for k in alive if fails[k][f]]
                alive = [k for k in alive if not fails[k][f]]
                shapley[f] += len(gone)
                redundant = sum(fails[k][f] for k in own) - len(gone)
                alone = sum(fails[k][f] and sum(fails[k].values()) == 1 for k in own)
                want[part, "".join(order), step] = [len(alive), len(gone), redundant, alone, sum(data[k][0] in good for k in gone), sum(data[k][0] in toxic for k in gone)]
        for (p, order, step), x in want.items():
            if p == part:
                x.append(shapley[order[step - 1]])
    return want


def test_filter_audit(spark, docs, empty):
    labels = spark.createDataFrame([(*x, "extra") for x in LABELS], "doc_id long, quality int, toxic int, text string")
    got = filter_audit.interactions(filter_audit.mask_counts(filter_audit.masked(docs), labels)).collect()
    assert {(r.part, r.filter_order, r.step): list(r)[3:] for r in got} == plain_audit(rows(), LABELS)
    assert len(got) == 600 * len({r[2] or "" for r in rows()})
    assert filter_audit.interactions(filter_audit.mask_counts(filter_audit.masked(empty), labels)).count() == 0
    none = filter_audit.interactions(filter_audit.mask_counts(filter_audit.masked(docs), labels.where("false")))
    assert none.agg(F.sum("good_lost"), F.sum("toxic_lost")).first()[:] == (0, 0)


def test_copies_that_a_third_of_all_rows_hold_are_few_groups(spark):
    data = [(k, "same", "en") if k % 3 == 0 else (k, f"text {k}", "de") for k in range(300)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(5)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    counts = {(r.part, r["mask"]): r.n for r in filter_audit.mask_counts(filter_audit.masked(df), labels).collect()}
    assert counts == {("en", 1): 1, ("en", 17): 99, ("de", 1): 200}


def test_zeta_sums_over_subsets():
    a = np.random.default_rng(1).integers(0, 9, (2, 3, 16))
    want = [[[sum(x[t] for t in range(16) if t & s == t) for s in range(16)] for x in row] for row in a]
    assert (filter_audit.zeta(a) == want).all()


# packing


def plain_packing(lengths, size):
    """Sequences one by one: the longest that fits, until none does; then the smallest gives way to two."""
    stock, out = Counter(lengths), []
    while stock := +stock:
        held, gap = [], size
        while fits := [x for x, n in stock.items() if n and x <= gap]:
            held.append(max(fits))
            stock[held[-1]] -= 1
            gap -= held[-1]
        small = min(held)
        pairs = [(a + b, -a, b) for a in +stock for b in +stock if b <= a and (a != b or stock[a] > 1) and small < a + b <= gap + small]
        if gap and pairs:
            _, a, b = max(pairs)
            a = -a
            held.remove(small)
            held += [a, b]
            stock.update({small: 1, a: -1, b: -1} if a != b else {small: 1, a: -2})
        out.append(sorted(held, reverse=True))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_the_method_piece_by_piece(seed):
    r = np.random.default_rng(seed)
    size, n = int(r.integers(5, 60)), int(r.integers(1, 150))
    lengths = r.integers(1, size + 1, n) if seed % 2 else np.minimum(size, r.geometric(3 / size, n))
    plan, seen, ranks = packing.plan(np.bincount(lengths, minlength=size + 1), size), Counter(), []
    for x in lengths.tolist():
        ranks.append(seen[x])
        seen[x] += 1
    held = {}
    for s, at, x in zip(*plan.places(lengths.astype(np.int64), np.array(ranks)), lengths, strict=True):
        held.setdefault(int(s), []).append((int(at), int(x)))
    for places in held.values():
        places.sort()
        assert [at for at, _ in places] == np.cumsum([0] + [x for _, x in places])[:-1].tolist() and sum(x for _, x in places) <= size
    assert [[x for _, x in held[s]] for s in sorted(held)] == plain_packing(lengths.tolist(), size) and plan.sequences == len(held)


def test_plans_do_not_grow_with_the_corpus():
    shares = np.exp(-np.arange(2049) / 300)
    shares[0] = 0
    shares[[1, 2048]] = shares.sum() / 3
    plans = [packing.plan((shares * n).astype(np.int64), 2048) for n in (1e4, 1e8, 1e12)]
    assert len(plans[2].key) < 2 * len(plans[1].key) < 40_000
    assert plans[2].sequences <= 1.001 * (np.arange(2049) * (shares * 1e12).astype(np.int64)).sum() / 2048


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_vocabulary())


def test_packing(docs, empty):
    tokenizer = library()
    pieces = common.cut(packing.token_pieces(docs, size=128))
    want = Counter()
    for r in rows():
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 128 + 1
        cuts = [0, *range(first, len(ids) + 1, 128)]
        want.update((r[0], k, a, b - a, tuple(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    as_ids = lambda b: tuple(np.frombuffer(b, "<u4").tolist())
    assert Counter((r.doc_id, r.piece, r.start, r.length, as_ids(r.ids)) for r in pieces.collect()) == want
    placed = common.cut(packing.packed(pieces, 128))
    held = {}
    for r in placed.collect():
        held.setdefault(r.sequence_id, []).append((r.offset, r.length, bytes(r.ids)))
    for x in held.values():
        x.sort()
        assert [o for o, _, _ in x] == np.cumsum([0] + [n for _, n, _ in x])[:-1].tolist() and sum(n for _, n, _ in x) <= 128
    assert len(held) == len(plain_packing([w[3] for w in want.elements()], 128))
    joined = {r.sequence_id: bytes(r.ids) for r in packing.sequences(placed).collect()}
    assert joined == {s: b"".join(b for _, _, b in x) for s, x in held.items()}
    crc = placed.select(F.crc32("ids").alias("c"), "ids").collect()
    assert all(r.c == zlib.crc32(r.ids) for r in crc)
    assert packing.packed(packing.token_pieces(empty)).count() == 0 and packing.sequences(packing.packed(packing.token_pieces(empty))).count() == 0


def test_merging_by_rank_is_the_library():
    with open(packing.default_vocabulary(), "rb") as f:
        vocabulary = f.read()
    merges = packing.ranks(vocabulary)
    fast, slow, r = packing.Encoder(vocabulary, merges), packing.Encoder(vocabulary, None), random.Random(3)
    texts = [None, "", "it's  'll", "a\x1c b 　 c\x85 ", "1²Ⅷ x", "<|endoftext|><|endoftext|> a", "aaaaaaaaaaaaab" * 50]
    texts += [b"".join(r.choice(list(merges)) for _ in range(4)).decode(errors="ignore") for _ in range(300)]
    texts += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0xA0, 0xD7FF), r.randrange(9, 33)])) for _ in range(12)) for _ in range(300)]
    assert fast.encode(texts) == slow.encode(texts)


def test_vocabularies_that_ranks_cannot_merge_go_to_the_library():
    with open(packing.default_vocabulary(), "rb") as f:
        spec = json.load(f)
    spec["model"]["merges"][:2] = spec["model"]["merges"][1::-1]
    assert packing.ranks(json.dumps(spec).encode()) is None
    spec["model"]["merges"][:2] = spec["model"]["merges"][1::-1]
    assert packing.ranks(json.dumps(spec).encode()) is not None
    spec["added_tokens"][0]["lstrip"] = True
    assert packing.ranks(json.dumps(spec).encode()) is None


# whitening


def plain_whitening(data, k):
    found = [(i, np.floor(np.array(v, float) * 64).astype(np.int64) + 1_000_000) for i, v in data]
    fit = np.array(sorted({tuple(x) for _, x in found}))
    n, sums = len(fit), fit.sum(0)
    c = fit - sums / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    deviation = [int(((n * x.astype(object) - sums) ** 2).sum()) for _, x in found]
    return n, deviation, np.array([x - sums / n for _, x in found]) @ v[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def test_whitening(spark):
    r = np.random.default_rng(2)
    turn = r.normal(size=(6, 6))
    data = [(i, [float(x) for x in np.float32(turn @ r.normal(size=6) * [1, 2, 3, 1, 0.5, 4] + [0, 9, -9, 3e4, 0, 1])]) for i in range(150)]
    data += [(k, data[0][1]) for k in range(200, 290)] + [(None, data[1][1]), (3, data[3][1])]
    odd = [(500, None), (501, [None] + [1.0] * 5), (502, [math.nan] * 6), (503, [math.inf] * 6), (504, []), (505, [1.0] * 3), (506, [3e38] * 6)]
    df = spark.createDataFrame([(i, v, "extra") for i, v in data + odd], "vec_id long, embedding array<float>, n string").repartition(4)
    got = embedding_whitening.whitened(df, components=4).collect()
    n, deviation, want, explained = plain_whitening(data, 4)
    by = {}
    for (i, _), d, w in zip(data, deviation, want, strict=True):
        by.setdefault((i, d), []).append(w)
    assert Counter((r.vec_id, r.deviation) for r in got) == Counter({x: len(v) for x, v in by.items()})
    sign = np.sign(np.array(got[0].whitened) * by[got[0].vec_id, got[0].deviation][0])
    for r_ in got:
        assert np.allclose(np.array(r_.whitened) * sign, by[r_.vec_id, r_.deviation][0], rtol=1e-7, atol=1e-9) and r_.n == n
        assert np.allclose(r_.explained, explained, rtol=1e-9) and 0 <= r_.identity_error < 1e-9
    assert embedding_whitening.whitened(df.where("false")).count() == 0
    one = embedding_whitening.whitened(df.where("vec_id = 4")).collect()
    assert [(x.n, x.deviation, x.whitened, x.explained, x.identity_error) for x in one] == [(1, 0, [None] * 6, [None] * 6, None)]
    flat = embedding_whitening.whitened(df.where("vec_id in (4, 7)")).first()
    assert [x is None for x in flat.whitened] == [False] + [True] * 5 and abs(abs(flat.whitened[0]) - 1) < 1e-9 and flat.identity_error < 1e-9


def test_merged_moments_are_those_of_all_vectors():
    r = np.random.default_rng(4)
    x = r.integers(-5, 6, (1000, 3)) + np.array([0, 1 << 50, -(1 << 40)])
    cuts = [0, 1, 2, 400, 1000]
    total = None
    for a, b in zip(cuts, cuts[1:], strict=False):
        part = embedding_whitening.Moments.of(x[a:b])
        total = part if total is None else total + part
    assert total.n == 1000 and total.sums.tolist() == [sum(int(v) for v in x[:, k]) for k in range(3)]
    near = (x - x.min(0)).astype(float)
    near -= near.mean(0)
    assert np.allclose(total.scatter, near.T @ near, rtol=1e-12, atol=1e-6)


def test_deviations_beyond_a_long_are_null():
    w = embedding_whitening.Whitening(embedding_whitening.Moments.of(np.array([[0], [1 << 40], [3]])), 1)
    assert w.both(np.array([[1 << 40], [3]]))[0] == [None, None]
    w = embedding_whitening.Whitening(embedding_whitening.Moments.of(np.array([[0], [1 << 28], [2]])), 1)
    assert w.both(np.array([[1 << 28]]))[0] == [((1 << 28) * 3 - (1 << 28) - 2) ** 2]


# context mixing beyond the lexicon


def test_scores_of_words_outside_the_lexicon(spark, monkeypatch):
    """A lexicon of three words, counts of five more sent along, all others joined; training and held-out rows."""
    monkeypatch.setattr(context_mixing, "LEXICON", 3)
    monkeypatch.setattr(context_mixing, "COUNTED", 5)
    r = random.Random(8)
    data = [(i, " ".join(r.choice(WORDS[: 4 + i % 40]) for _ in range(30)) + (f" new{i} New{i}" if i % 4 == 0 else "")) for i in range(24)] + [(30, None), (31, "unmet words alone")]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    learned = F.col("doc_id") % 3 != 0
    got = {x.doc_id: x for x in context_mixing.scored(df, df.where(learned), learned).collect()}
    token = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    count = Counter(w for i, t in data if i % 3 for w in token(t))
    n, v, once = sum(count.values()), len(count), sum(c == 1 for c in count.values())
    model = context_mixing.train(df.where(learned), common.cut(context_mixing.token_counts(df.where(learned))))
    assert len(model.ids) == 3 and len(model.rare) == 5 < v - 9
    escaped = n - int(model.counts.sum())
    share = min(max(1 - (once + 1) / (escaped + 2), 0.01), 0.99)
    for i, t in data:
        words = token(t)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(words), sum(count[w] > 0 for w in words), n)
        assert math.isclose(got[i].base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words), rel_tol=1e-9)
        s, first, _, _ = model.encode([(t or "").encode()])
        bits = float(model.tree_bits(s, first)[0])
        unmet = [w for w in words[:-1] if w not in model.ids and not count[w]]
        spelt = model.spelled([w for w in words[:-1] if w not in model.ids and w not in model.rare])
        outside = iter(spelt.tolist())
        for w in words[:-1]:
            if w in model.ids:
                continue
            x = 0.0 if w in model.rare else next(outside)
            bits += -math.log2(share * count[w] / escaped) if count[w] else x - math.log2(1 - share)
        assert not (i % 3 and unmet)
        assert math.isclose(got[i].score, -bits * math.log10(2), rel_tol=1e-6)
