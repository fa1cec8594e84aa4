"""Graph documents by blocks: any cut of the bytes gives the same elements."""

import json
import pickle
import random
from types import SimpleNamespace

import pytest

from loomgraph.sources import documents


def document(n, seed=1):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(['a', '"', "\\", "{", "}", "[", "]", "é", "\n", ":", ",", "nodes"]) for _ in range(rng.randrange(12)))
    nodes = [{"id": f"n{i}", "name": text(), "tags": [text(), {"deep": [text()]}], "type": "file"} for i in range(n)]
    edges = [{"source": f"n{i}", "target": f"n{(i * 7) % n}", "type": text()} for i in range(2 * n)]
    return {"version": "1.0 \"x\" {", "n": -1.5e3, "ok": True, "none": None, "project": {"name": text(), "languages": ["a"]}, "nodes": nodes, "edges": edges, "layers": [{"id": "l", "nodeIds": ["n0"]}], "tour": [], "empty": {}, "last": "]"}


def wanted(doc):
    out = []
    for part, value in doc.items():
        out += [(part, x) for x in value] if isinstance(value, list) else [(part, value)]
    return out


@pytest.mark.parametrize("indent", [None, 2])
def test_elements_do_not_depend_on_blocks(indent):
    doc = document(9)
    data = json.dumps(doc, indent=indent, ensure_ascii=False).encode()
    for block in (1, 2, 3, 7, 50, 333, len(data), 10**6):
        state, depth, got, key = 0, 0, [], None
        for start in range(0, len(data), block):
            piece = data[start : start + block]
            rest = iter([data[k : k + 5] for k in range(start + block, len(data), 5)])
            for part, raw in documents.cut_elements(piece, len(piece), state, depth, lambda r=rest: next(r, b"")):
                key = part or key
                if raw:
                    got.append((key, json.loads(raw)))
            end, opened = documents.transition(piece, state)
            state, depth = end, depth + opened
        assert (state, depth) == (0, 0) and got == wanted(doc), block


def test_documents_are_read_and_written_by_parts(spark, tmp_path):
    doc = document(40)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.json").write_text(json.dumps(doc, indent=1))
    found = documents.read_document(spark, str(tmp_path / "a"), block=300)
    assert found.rdd.getNumPartitions() > 10 or len((tmp_path / "a" / "one.json").read_bytes()) < 3000
    assert [(r.part, json.loads(r.raw)) for r in found.orderBy("ord").collect()] == wanted(doc)
    only = documents.read_document(spark, str(tmp_path / "a"), "edges", block=300)
    assert [json.loads(r.raw) for r in only.orderBy("ord").collect()] == doc["edges"]
    documents.write_document(found, str(tmp_path / "b"))
    again = documents.read_document(spark, str(tmp_path / "b"), block=500)
    assert sorted((r.part, r.raw) for r in again.collect()) == sorted((r.part, r.raw) for r in found.collect())
    for part in ("nodes", "edges"):
        assert [json.loads(r.raw) for r in again.where(f"part = '{part}'").orderBy("ord").collect()] == doc[part]


def test_batches_are_reported(spark, tmp_path):
    for name, text in (("batch-1.json", json.dumps({"nodes": [{"id": "a"}], "edges": []})), ("batch-3-part-2.json", "{}"), ("other.json", "{}"), ("batch-5.json", ""), ("batch-existing.json", json.dumps({"edges": [{"source": "a"}]}))):
        (tmp_path / name).write_text(text)
    got = {(r.file.rsplit("/", 1)[-1], r.issue) for r in documents.batch_report(spark, str(tmp_path)).collect()}
    assert got == {("other.json", "unknown name"), ("batch-3-part-2.json", "empty batch"), ("batch-5.json", "empty batch"), ("batch-2.json", "missing number"), ("batch-4.json", "missing number")}


def test_small_blocks_share_tasks(tmp_path):
    (tmp_path / "a.json").write_text('{"nodes":[' + ",".join('{"id":"%d"}' % i for i in range(8000)) + "]}")
    reader = documents.BlockReader({"path": str(tmp_path), "block": "100"})
    dealt = reader.partitions()
    blocks = [b for run in dealt for b in run.blocks]
    assert len(dealt) <= 2 * documents.LEAST < len(blocks) / 4 and [b.k for b in blocks] == list(range(len(blocks)))
    told = [SimpleNamespace(**dict(zip(("file", "k", "start", "length", "s0", "d0", "s1", "d1", "s2", "d2"), x))) for run in dealt for x in reader.read(run)]
    elements = documents.ElementReader({"blocks": json.dumps(documents.composed(told))})
    assert len(pickle.dumps(elements)) < 1000  # what each task is sent does not hold all blocks
    assert sum(x[4] is not None for run in elements.partitions() for x in elements.read(run)) == 8000
