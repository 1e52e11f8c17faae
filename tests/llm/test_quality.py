import re
from collections import Counter

from pyspark.sql import functions as F

from eventlens.llm import quality as Q
from tests.llm.helpers import SF, awkward, documents, frame, labels, words


def brute(text):
    text = text or ""
    w = words(text)
    times = Counter(zip(w, w[1:], w[2:]))
    inside = {p for i in range(len(w) - 2) if times[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_counts_against_brute_force(spark):
    rows = {r["doc_id"]: r for r in Q.op3(spark, SF).collect()}
    for i, text, *_ in documents():
        r, want = rows[i], brute(text)
        assert tuple(r[c] for c in Q._COUNTS) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r["kept"] == (not r["base_failed"] and r["probability"] >= 0.5)


def test_unseen_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, marks = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = Q.fit_quality(docs, marks, keep=F.crc32(F.col("id").cast("string").cast("binary")) % 4 != 0)
    unseen = marks.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0)
    rows = Q.assess(docs, model).join(unseen, "doc_id").select("quality", *Q.verdict()).where("NOT base_failed").collect()
    assert len(rows) > 40 and sum(r["kept"] == bool(r["quality"]) for r in rows) / len(rows) > 0.95


def test_awkward_rows(spark):
    docs = frame(spark, awkward(), n_words="'x'", assessed="1", label="2")
    marks = labels(spark, [(1, 1, 0), (2, 0, 1), (6, None, None), (7, 1, 1), (None, 1, 1), (9, 0, 0), (10, 1, 1), (3, 0, 0)])
    for given in (marks, marks.limit(0)):
        rows = Q.assess(docs, Q.fit_quality(docs, given)).select("text", *Q.verdict()).collect()
        assert [tuple(r[c] for c in Q._COUNTS) for r in rows] == [brute(r["text"]) for r in rows]
        assert not any(r["kept"] for r in rows if not r["text"])
    assert Q.assess(docs.limit(0), Q.fit_quality(docs.limit(0), marks)).count() == 0
