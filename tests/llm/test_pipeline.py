"""The corpus pipeline from end to end against plain versions of its stages, on a table whose other columns have clashing names."""

from collections import Counter

import corpus_pipeline
import xxhash
from pyspark.sql import functions as F
from test_llm import DOC, jaccard_components, plain_hits, prose, rows, words


def plain_targets(size):
    """Words that each source should have: shares by weight, none above three times what it has."""
    total = sum(size.values())
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    want, free = dict.fromkeys(size, 0.0), set(size)
    while True:
        left = total - sum(want[s] for s in size if s not in free)
        for s in free:
            want[s] = left * weights[s] / sum(weights[x] for x in free)
        over = {s for s in free if want[s] > 3 * size[s]}
        if not over:
            return want
        for s in over:
            want[s] = 3.0 * size[s]
        free -= over


def test_whole_run(spark, tmp_path):
    data = rows() + [(200 + i, prose(80 + i, 900 + i), "en", "abc"[i % 3], 1, "x", "y", "z", "w") for i in range(40)]
    path = str(tmp_path)
    spark.createDataFrame(data, DOC).repartition(3).write.parquet(f"{path}/documents.parquet")
    items = [(1, " ".join(prose(60, 4).split()[10:30])), (None, " ".join(prose(95, 915).split()[5:20])), (3, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    done = corpus_pipeline.run(spark, path)
    assert set(DOC.split(", ")[0].split()[:1]) <= set(done.columns)
    got = done.collect()

    lettered = [r for r in data if any(c.isalpha() for c in r[1] or "")]
    component = jaccard_components([(r[0], r[1]) for r in lettered])
    # of rows that repeat an id the one whose text has the least hash stays
    least = {}
    for r in lettered:
        h = int.from_bytes(xxhash.xxh64(r[1].encode(), seed=42).digest(), "big", signed=True)
        if r[0] is not None and component[r[0]] == r[0]:
            least[r[0]] = min(least.get(r[0], (h, r)), (h, r))
    single = [r for r in lettered if r[0] is None] + [r for _, r in least.values()]
    held = {repr(r) for r in single if not plain_hits(r[1], items)[1]}
    clean = [r for r in single if repr(r) in held]
    by_id = Counter(r[0] for r in clean)
    assert {r.doc_id for r in got} <= set(by_id)
    for r in got:
        assert r.text in {x[1] for x in clean if x[0] == r.doc_id} and r.source in {x[3] for x in clean if x[0] == r.doc_id}
    size, taken, longest = Counter(), Counter(), Counter()
    for r in clean:
        n = len(words(r[1]))
        size[r[3]] += n
        longest[r[3]] = max(longest[r[3]], n)
    for r in got:
        taken[r.source] += len(words(r.text))
    want = plain_targets(size)
    for s in size:
        assert abs(taken[s] - want[s]) <= longest[s], s
    shards = Counter()
    for r in got:
        shards[r.shard] += len((r.text or "").encode()) + 1
    assert max(shards) <= 15 and sum(shards.values()) == sum(len((r.text or "").encode()) + 1 for r in got)
    slots = {}
    for r in done.select("shard", "slot").collect() if "slot" in done.columns else []:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert corpus_pipeline.run(spark, path).agg(F.count(F.lit(1))).first()[0] == len(got)
