import numpy as np
from pyspark.sql import functions as F

from eventlens.llm import toxicity as T
from tests.llm.helpers import awkward, frame, labels

# the smaller tables have some thirty positive labels, too few to learn four languages from
SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    rows = T.op10(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 600 and sum(r["predicted"] == r["toxic"] for r in rows) / len(rows) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def identity_corpus(spark):
    """Insults that mention one group far more often than others."""
    rng = np.random.default_rng(1)
    plain = "the a of and to in that it was for on are with as river table window paper garden music".split()
    rows, marks = [], []
    for i in range(400):
        toxic = i % 2
        w = list(rng.choice(plain, 12))
        if toxic:
            w[3] = str(rng.choice(["idiot", "scum", "moron"]))
        if rng.random() < (0.8 if toxic else 0.05):
            w[7] = "muslims"
        rows.append((i, " ".join(w), "en", "a", 1))
        marks.append((i, 1, toxic))
    return frame(spark, rows), labels(spark, marks)


def test_swapped_mentions_change_scores_less(spark):
    docs, marks = identity_corpus(spark)
    sentences = ["the muslims in the garden with music"], ["the christians in the garden with music"]
    gap = {}
    for penalty in (0.0, 5.0):
        model = T.fit_toxicity(docs, marks, penalty=penalty)
        gap[penalty] = abs(float(model.score(sentences[0])[0] - model.score(sentences[1])[0]))
        assert model.score(["you are scum and an idiot of a moron"])[0] > 0.5
        swapped = [r["text"] for r in docs.collect() if "muslims" in r["text"]]
        assert model.pairs == len(swapped) > 100
    assert gap[5.0] < 0.25 * gap[0.0]


def test_signs_and_capitals_do_not_hide_words():
    one, *others = (T.features([t]) for t in ("such an idiot", "SUCH!! AN!! IDIOT!!", "such*** an | idiot,"))
    assert all(np.array_equal(one[1], o[1]) for o in others)


def test_swap():
    swap = T.swapper()
    assert swap("Muslims and men.") == "christians and women." and swap("mental") is None and swap(None) is None and swap("") is None


def test_scores_do_not_depend_on_neighbours():
    model = T.ToxicityModel(np.random.default_rng(0).normal(size=T.DIMS).astype(np.float32), 0.1, 1.0, 0.0)
    texts = [t for _, t, *_ in awkward()]
    together = model.score(texts)
    assert np.array_equal(together, [model.score([t])[0] for t in texts])
    assert together[4] == together[5]  # null and empty


def test_awkward_rows(spark):
    docs = frame(spark, awkward(), score="'x'", label="7", id="1")
    marks = labels(spark, [(1, 1, 0), (1, 1, 0), (2, 0, 1), (6, None, None), (7, 1, 1), (7, 1, 0), (None, 1, 1), (9, 1, 0), (10, 1, 1), (99, 1, 1), (3, 1, 0)])
    for given in (marks, marks.limit(0), marks.where("toxic = 0")):
        model = T.fit_toxicity(docs, given)
        scores = [r[0] for r in docs.select(T.score_column(docs, model)).collect()]
        assert len(scores) == len(awkward()) and all(0 <= s <= 1 for s in scores)
        assert T.drop_toxic(docs, docs, given).columns == docs.columns
    assert T.drop_toxic(docs.limit(0), docs.limit(0), marks).count() == 0
    assert docs.select(T.held_out(F.col("doc_id")).alias("h")).where("h IS NULL").count() == 0
