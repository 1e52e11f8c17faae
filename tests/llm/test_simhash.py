import random

import numpy as np
import pytest
import xxhash

from eventlens.llm import simhash as S
from tests.llm.helpers import SF, awkward, documents, frame, lower, words


def brute_fingerprint(text, n=3):
    w = words(lower(text))
    shingles = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, bits=3):
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if bin(a ^ fps[j]).count("1") <= bits:
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fps))]


def test_whole_table_against_brute_force(spark):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in S.op8(spark, SF).collect()}
    docs = documents()
    fps = [brute_fingerprint(d[1]) for d in docs]
    roots = brute_components(fps)
    assert got == {d[0]: (f"{f:016x}", docs[r][0]) for d, f, r in zip(docs, fps, roots)}


def test_awkward_rows(spark):
    docs = frame(spark, awkward(), fp="1", root="'x'", id="0", size="2", first="3")
    rows = S.near_duplicates(docs).collect()
    assert len(rows) == len(awkward())
    assert all(r["fingerprint"] == 0 and r["component_id"] == 3 for r in rows if r["doc_id"] in (3, 4, 5))
    copies = [r for r in rows if r["doc_id"] == 1 or (r["doc_id"] == 2 and r["fingerprint"] == rows[0]["fingerprint"])]
    assert {r["component_id"] for r in copies} == {1}
    kept = S.keep_representatives(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) or ids.count(2) <= 1
    assert 1 in ids and 3 in ids and 4 not in ids and {6, 7, 8, 9} <= set(ids)
    assert S.near_duplicates(docs.limit(0)).count() == 0 and S.keep_representatives(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [0, 2, 3, 5])
def test_dense_lists_lose_no_link(spark, bits):
    rng = random.Random(bits)
    centre = rng.getrandbits(64)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for _ in range(260):
        x = centre
        for b in rng.sample(range(64), rng.randint(0, 4)):
            x ^= 1 << b
        fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    roots = {r["node"]: r["root"] for r in S.components(S.near_links(df, bits, dense=8)).collect()}
    groups = {}
    for f, r in zip(fps, brute_components(fps, bits)):
        groups.setdefault(r, set()).add(int(np.uint64(f).astype(np.int64)))
    want = {frozenset(g) for g in groups.values() if len(g) > 1}
    got = {}
    for node, root in roots.items():
        got.setdefault(root, set()).add(node)
    assert {frozenset(g) for g in got.values()} == want


def test_cells_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 16)
    test_dense_lists_lose_no_link(spark, 3)
