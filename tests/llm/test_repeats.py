import hashlib
import random

import numpy as np
import pytest

from eventlens.llm import repeats as R
from eventlens.llm.common import SpanHasher
from eventlens.llm.runindex import RunLengthIndex
from tests.llm.helpers import SF, awkward, documents, frame


def brute(rows, length):
    """rows: (key, bytes) in order."""
    seen, out = set(), {}
    for key, t in rows:
        covered = bytearray(len(t))
        for i in range(len(t) - length + 1):
            s = t[i : i + length]
            if s in seen:
                covered[i : i + length] = b"\1" * length
            seen.add(s)
        kept = bytes(b for b, c in zip(t, covered) if not c)
        out[key] = (len(t), sum(covered), sum(1 for x in bytes(covered).split(b"\0") if x), hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


def test_index_against_plain_search():
    rng = random.Random(3)
    for _ in range(150):
        alphabet = rng.choice([b"ab", b"abc\0", b"\0\xff"])
        texts = [bytes(rng.choice(alphabet) for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(1, 6))]
        texts += texts[:2] if rng.random() < 0.4 else []
        queries = [bytes(rng.choice(alphabet + b"z") for _ in range(rng.randint(0, 12))) for _ in range(5)]
        got = RunLengthIndex(texts).matching_statistics(queries)
        for row, q in zip(got, queries):
            want = [max([k for k in range(1, len(q) - i + 1) if any(q[i : i + k] in t for t in texts)], default=0) for i in range(len(q))]
            assert row[: len(q)].tolist() == want


def test_whole_table_against_brute_force(spark):
    assert result(R.op9(spark, SF)) == brute([(d[0], d[1].encode()) for d in documents()], 100)


@pytest.mark.parametrize("hot", [1, 3, 64])
def test_passages_in_many_surroundings(spark, monkeypatch, hot):
    monkeypatch.setattr(R, "HOT", hot)
    monkeypatch.setattr(R, "SPREAD", 5)
    rng = random.Random(hot)
    noise = lambda n: "".join(rng.choice("abcdefghij klmno") for _ in range(n))
    passages = [noise(n) for n in (70, 110, 260)]
    rows = []
    for i in range(120):
        t = noise(rng.randint(0, 130)) + rng.choice(passages)[rng.randint(0, 12) :] + noise(rng.randint(0, 90))
        rows.append((i, (t + rng.choice(passages) + "é") * rng.choice([1, 1, 2]), "en", "a", 1))
    rows += [(200 + i, "a" * rng.randint(90, 400), "en", "a", 1) for i in range(4)] + [(300, "ab" * 300, "en", "a", 1)]
    rng.shuffle(rows)
    want = brute([(r[0], r[1].encode()) for r in sorted(rows)], 100)
    out = R.remove_repeats(frame(spark, rows).repartition(4), with_kept=True)
    assert result(out) == want
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and r["n_removed"] == sum(s["end"] - s["start"] for s in r["spans"]) for r in out.collect())


def test_long_texts_are_cut_into_segments(spark, monkeypatch):
    monkeypatch.setattr(R, "_SEGMENT", 1 << 10)
    rng = random.Random(8)
    parts = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (150, 900, 2500)]
    rows = [(i, "".join(rng.choice(parts) + str(i * k) for k in range(6)), "en", "a", 1) for i in range(5)]
    assert result(R.remove_repeats(frame(spark, rows))) == brute([(r[0], r[1].encode()) for r in rows], 100)


def test_texts_that_collide_in_the_rolling_hash_stay(spark):
    """Two different texts of 100 bytes whose rolling hashes, and those of their least grams, are the same."""
    tail = "jstexzwhgtqalrtuvnnjcolywyhzyxnu"
    one = "OQRMRQKTOLURMNQOUSFQQPZILWKPROORNH\\RJSIRYLKPSRQOKUNOSLRQLQUNNQOPSONQ" + tail
    two = "P" * 68 + tail
    hashes = []
    for t in (one, two):
        buf = np.frombuffer(t.encode(), dtype=np.uint8)
        assert len(buf) == 100
        hashes.append(SpanHasher(buf).spans(np.array([0]), np.array([100]))[0])
    assert hashes[0] == hashes[1]
    rows = [(1, one, "en", "a", 1), (2, two, "en", "a", 1), (3, two + one, "en", "a", 1)]
    assert result(R.remove_repeats(frame(spark, rows))) == brute([(r[0], r[1].encode()) for r in rows], 100)


def test_awkward_rows(spark):
    docs = frame(spark, awkward(), ordinal="1", part="2", id="3", n_bytes="4")
    rows = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in R.remove_repeats(docs).collect())
    assert len(rows) == len(awkward())
    by_id = [(i, n, removed) for unknown, i, n, removed in rows if not unknown]
    size = len(awkward()[0][1])
    assert [x[2] for x in by_id if x[0] == 2 and x[1] == size] == [size, size]  # both repeated rows are copies of 1
    assert (3, 0, 0) in by_id and (4, 0, 0) in by_id
    assert sum(r[3] for r in rows if r[0]) == len(awkward()[7][1])  # a null id comes last
    assert R.remove_repeats(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        R.remove_repeats(docs, length=10)
