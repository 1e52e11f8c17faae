import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np

from eventlens.llm import collocations as C
from tests.llm.helpers import SF, awkward, documents, frame, lower


def brute(rows, least, longest=5, top=2000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            counts.update((lang, tuple(w[i:i + n])) for n in range(1, longest + 1) for i in range(len(w) - n + 1))
    often = {k: v for k, v in counts.items() if v >= least}
    candidates = {k: v for k, v in often.items() if len(k[1]) > 1}
    covered = defaultdict(int)
    for (lang, w), a in candidates.items():
        for n in range(2, len(w)):
            for i in range(len(w) - n + 1):
                covered[lang, w[i:i + n]] = max(covered[lang, w[i:i + n]], a)
    scored = defaultdict(list)
    for (lang, w), a in candidates.items():
        if 100 * covered[lang, w] >= 100 * a:
            continue
        n = totals[lang]
        score, k = min((1000 * a * n // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w)))
        scored[lang].append((-score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]], n))
    return sorted((lang, rank, p.decode(), -a, x, y, n, -s) for lang, of in scored.items()
                  for rank, (s, a, p, x, y, n) in enumerate(sorted(of)[:top], 1))


def result(df):
    return sorted(tuple(r) for r in df.collect())


def test_small_thresholds_against_brute_force(spark):
    rows = documents()
    docs = frame(spark, rows).repartition(6)
    for least, longest, top in ((4, 5, 2000), (30, 3, 50)):
        want = brute([(r[2], r[1]) for r in rows], least, longest, top)
        assert len(want) > 60 and result(C.collocations(docs, least, longest, top)) == want


def test_registered_query_against_brute_force(spark):
    got = result(C.op12(spark, SF))
    assert got == brute([(r[2], r[1]) for r in documents()], 100)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(con.execute(C._SQL).fetchall()) == got


def test_full_filters_change_nothing(spark, monkeypatch):
    """Bitmaps in which every bit is set let all phrases through, and the result stays."""
    rows = documents()[:60]
    docs = frame(spark, rows)
    monkeypatch.setattr(C.Filter, "collect", staticmethod(lambda hashes, bits: (hashes.count(), b"\xff" * (1 << (bits - 3)))[1]))
    assert result(C.collocations(docs, 6)) == brute([(r[2], r[1]) for r in rows], 6)


def test_filters_of_any_size_hold_what_went_in(spark):
    hashes = np.random.default_rng(1).integers(-(1 << 63), (1 << 63) - 1, 5000)
    df = spark.createDataFrame([(int(h),) for h in hashes], "hash long")
    for bits in (8, 14, 22):
        known = C.Filter(C.Filter.collect(df, bits))
        assert known.holds(hashes.view(np.uint64)).all()
    other = np.random.default_rng(2).integers(0, 1 << 63, 20_000).astype(np.uint64)
    assert known.holds(other).mean() < 0.01


def test_no_frequent_key_is_lost_in_any_merge_order():
    rng = random.Random(3)
    for _ in range(60):
        least = rng.choice([2, 5, 20])
        stream = [rng.randrange(200) if rng.random() < 0.7 else rng.randrange(5) for _ in range(3000)]
        capacity = len(stream) // least + 1 if rng.random() < 0.5 else len(stream) // least // 2 + 1
        parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), 0)]
        for i in range(0, len(stream), 150):
            keys, counts = np.unique(np.array(stream[i:i + 150], np.uint64), return_counts=True)
            parts.append((keys, counts.astype(np.int64), 0))
        while len(parts) > 1:
            some = [parts.pop(rng.randrange(len(parts))) for _ in range(min(len(parts), rng.randrange(2, 5)))]
            parts.append(C.merge(some, capacity))
        keys, counters, lost = parts[0]
        held, exact = dict(zip(keys.tolist(), counters.tolist())), Counter(stream)
        assert len(held) <= capacity and lost * (capacity + 1) <= len(stream)
        for k, n in exact.items():
            assert n - lost <= held.get(k, 0) <= n
        if capacity > len(stream) / least:
            assert all(k in held for k, n in exact.items() if n >= least)


def test_awkward_rows(spark):
    rows = awkward() + [(20, "A b.C d\x0bE f\tg  h\x0ci", None, None, 0), (21, "a B;c D", "und", None, 0), (22, "...\n!?", "", "", 0), (23, "É b c É b c", "fr", "", 0)]
    docs = frame(spark, rows, w="1", phrase="'p'", rank="2", n="3").repartition(4)
    got = result(C.collocations(docs, 2))
    assert got == brute([(r[2], r[1]) for r in rows], 2) and any(r[0] == "und" and r[2] == "a b" for r in got)
    assert C.collocations(docs.limit(0), 2).collect() == []
    assert C.collocations(docs.where("doc_id in (3, 4, 5, 22)"), 2).collect() == []
