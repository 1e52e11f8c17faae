import hashlib
import random

from pyspark.sql import functions as F

from eventlens.llm import decontaminate as D
from tests.llm.helpers import SF, awkward, frame


def naive(text, items, window=10):
    w = D.words_of(text)
    hit, found = set(), set()
    for name, t in items:
        p = D.words_of(t)
        n = min(window, len(p))
        for s in range(max(1, len(p) - window + 1)) if p else ():
            for i in range(len(w) - n + 1):
                if w[i : i + n] == p[s : s + n]:
                    hit.update(range(i, i + n))
                    found.add(str(name))
    return len(w), len(hit), sorted(found)


def test_search_against_naive():
    rng = random.Random(4)
    for _ in range(150):
        vocabulary = rng.choice(["ab", "abcdef"])
        items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 14)))) for i in range(rng.randint(0, 5))]
        patterns = {}
        for name, t in items:
            p = D.words_of(t)
            for s in range(max(1, len(p) - 9)) if p else ():
                patterns.setdefault(tuple(p[s : s + 10]), set()).add(str(name))
        rows = [{"words": list(k), "ids": sorted(v)} for k, v in patterns.items()]
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40)))
        got = D._search(text, None, D._tables(rows))
        assert (got["n_words"], sum(s["end"] - s["start"] for s in got["spans"]), got["items"]) == naive(text, items)


def test_blocks_of_patterns_agree(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    docs = docs.select("doc_id", "text")
    one = D.find_contamination(docs, items).select("doc_id", *D.summary())
    many = D.find_contamination(docs, items, block_patterns=100).select("doc_id", *D.summary())
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_awkward_rows(spark):
    docs = frame(spark, awkward(), found="1", n_words="2", items="3")
    items = spark.createDataFrame([(1, "One two THREE, four five six seven eight nine ten eleven"), (2, None), (3, ""), (4, "Solo!"), (None, "é"), (6, "solo")],
                                  "item_id long, text string")
    rows = D.find_contamination(docs, items).select("doc_id", *D.summary()).collect()
    assert len(rows) == len(awkward())
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by_id[1]["n_hit"] == 33 and by_id[1]["n_items"] == 1
    assert by_id[9]["n_items"] == 2 and by_id[9]["items_sha256"] == hashlib.sha256(b"4,6").hexdigest()
    assert by_id[3]["n_words"] == 0 and not by_id[4]["contaminated"]
    kept = D.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and not {1, 9, 10} & {r["doc_id"] for r in kept.collect()} and kept.count() == len(awkward()) - 7
    assert D.drop_contaminated(docs.limit(0), items).count() == 0
    assert D.drop_contaminated(docs, items.limit(0)).count() == len(awkward())
    assert D.find_contamination(docs, items.where(F.lit(False))).select(*D.summary()).agg(F.sum("n_hit")).first()[0] == 0
