import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from eventlens.llm import katz as K
from tests.llm.helpers import SF, awkward, documents, frame, lower, words


class Brute:
    def __init__(self, texts):
        self.words, self.pairs = Counter(), Counter()
        for t in texts:
            w = words(lower(t)) + [None]
            self.words.update(w)
            self.pairs.update(zip([0, *w], w))
        self.n, self.v = sum(self.words.values()), len(self.words)
        self.dw, self.dp = self.discount(self.words), self.discount(self.pairs)
        left = self.n - sum(self.dw(c) for c in self.words.values())
        self.scale = self.n / (self.n + 1) if self.n and left < 1e-12 * self.n else 1
        self.p = {w: self.scale * self.dw(c) / self.n for w, c in self.words.items()}
        self.unknown = 1 - sum(self.p.values())
        after = defaultdict(dict)
        for (h, w), c in self.pairs.items():
            after[h][w] = c
        self.after, self.count, self.keep, self.alpha = after, {}, {}, {}
        for h, m in after.items():
            n, d = sum(m.values()), sum(self.dp(c) for c in m.values())
            self.count[h], self.keep[h] = n, n / (n + 1) if n - d < 1e-9 * n else 1
            self.alpha[h] = (1 - self.keep[h] * d / n) / (1 - sum(self.p[w] for w in m))

    @staticmethod
    def discount(counts):
        n = Counter(counts.values())
        for k in range(5, 0, -1):
            if all(n[r] for r in range(1, k + 2)) and (a := (k + 1) * n[k + 1] / n[1]) < 1:
                d = {r: ((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a) for r in range(1, k + 1)}
                if all(0 < x < 1 for x in d.values()):
                    return lambda c: c * d.get(c, 1)
        less = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        return lambda c: c - less if c <= 5 else c

    def pair(self, h, w):
        if w in self.after.get(h, {}):
            return self.keep[h] * self.dp(self.after[h][w]) / self.count[h]
        return self.alpha.get(h, 1) * self.p.get(w, self.unknown)

    def row(self, text):
        w = words(lower(text)) + [None]
        base = sum(math.log10((self.words[x] + 1) / (self.n + self.v + 1)) for x in w)
        return len(w), sum(self.words[x] > 0 for x in w), self.n, base, sum(math.log10(self.pair(h, x)) for h, x in zip([0, *w], w))


def check(rows, brute, texts):
    for r in rows:
        want = brute.row(texts[r["doc_id"]])
        got = (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"])
        assert got[:3] == want[:3] and got[3:] == pytest.approx(want[3:], rel=1e-9)


@pytest.mark.parametrize("head", [0, 200, 1 << 20])
def test_whole_table_against_brute_force(spark, head):
    texts = {d[0]: d[1] for d in documents()}
    kept = {i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = K.score_katz(docs, K.fit_katz(docs.where(~K.held_out()), head_words=head), K.held_out()).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts) and all(r["held_out"] == (r["doc_id"] not in kept) for r in rows)
    brute = Brute([t for i, t in texts.items() if i in kept])
    check(rows, brute, texts)
    assert sum(r["score"] for r in rows if r["held_out"]) > sum(r["base_score"] for r in rows if r["held_out"])
    # probabilities after every history add up to one
    vocabulary = list(brute.words)
    for h in [0, None, *list(brute.after)[:40]]:
        if h in brute.after:
            assert sum(brute.pair(h, w) for w in vocabulary) + brute.alpha[h] * brute.unknown == pytest.approx(1)


def test_small_flushes_agree(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    one = sorted(map(tuple, K.score_katz(docs, K.fit_katz(docs.where(~K.held_out())), K.held_out()).collect()))
    rows = docs.repartition(5)
    two = sorted(map(tuple, K.score_katz(rows, K.fit_katz(rows.where(~K.held_out())), K.held_out()).collect()))
    assert [r[:5] for r in one] == [r[:5] for r in two] and [r[6] for r in one] == pytest.approx([r[6] for r in two], rel=1e-12)


def test_awkward_rows(spark):
    docs = frame(spark, awkward(), held_out="1", part="2", n="3", word="4")
    rows = K.score_katz(docs, K.fit_katz(docs), F.lit(False)).collect()
    assert len(rows) == len(awkward())
    brute = Brute([r[1] for r in awkward()])
    check([r for r in rows if r["doc_id"] not in (2, None)], brute, {r[0]: r[1] for r in awkward()})
    assert all(r["n_tokens"] == 1 for r in rows if r["doc_id"] in (3, 4, 5))
    nothing = K.fit_katz(docs.limit(0))
    assert all(r["score"] == 0 and r["n_known"] == 0 for r in K.score_katz(docs, nothing, F.lit(True)).collect())
    assert K.score_katz(docs.limit(0), K.fit_katz(docs), F.lit(True)).count() == 0
    assert re.fullmatch("long|bigint", dict(K.score_katz(docs, nothing, F.lit(True)).dtypes)["doc_id"])
