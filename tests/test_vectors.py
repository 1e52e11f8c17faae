"""Vectors, splits and classifier scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlens.operators import vectors as V
from eventlens.operators.ranking import sample_rows

RNG = np.random.default_rng(3)


def test_split_is_exact_per_label(spark):
    df = spark.range(1003).withColumn("y", F.when(F.col("id") % 3 == 0, 1).otherwise(0))
    got = {(r.y, r.is_train): r["count"] for r in V.stratified_split(df, "id", "y").groupBy("y", "is_train").count().collect()}
    assert got == {(1, True): 268, (1, False): 67, (0, True): 534, (0, False): 134}


def test_split_edges(spark):
    df = spark.range(10).withColumn("y", F.lit(0))
    assert V.stratified_split(df, "id", "y", 1.0).where("is_train").count() == 10
    assert V.stratified_split(df, "id", "y", 0.0).where("is_train").count() == 0


@pytest.mark.parametrize("ranges", [None, 40])
def test_auc_matches_pairs(spark, ranges):
    s = np.round(RNG.random(120), 2)
    y = RNG.random(120) < 0.4
    df = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(s, y)], "s double, y boolean")
    p, n = s[y], s[~y]
    want = ((p[:, None] > n).sum() + 0.5 * (p[:, None] == n).sum()) / (len(p) * len(n))
    assert V.auc(df, "s", F.col("y"), ranges=ranges).first().auc_roc == pytest.approx(want)


def test_classifier_separates_shifted_vectors(spark):
    rows = [(i, [float(v) for v in RNG.normal(1.5 * (i % 2), 1, 4)], i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y int")
    r = V.era_classifier(df, "id", "v", "y").first()
    assert r.auc_roc > 0.8 and r.accuracy > 0.8 and r.interpretation.startswith("HIGH")
    assert r.tp + r.fp + r.fn + r.tn == 60


def test_confusion_on_empty_prediction(spark):
    df = spark.createDataFrame([(0.1, True), (0.2, False)], "s double, y boolean")
    r = V.confusion_metrics(df, "s", F.col("y")).first()
    assert (r.precision, r.recall, r.f1, r.accuracy) == (0.0, 0.0, 0.0, 0.5)


def test_vectors_are_unit_length_and_pluggable(spark):
    df = spark.createDataFrame([("fix the bug",), ("add a test",), (None,), ("fix fix",)], "m string")
    v = [np.array(r.vector) for r in V.vectorise(df, "m", dims=64).collect()]
    lengths = sorted(round(float(np.linalg.norm(x)), 9) for x in v)
    assert lengths[-1] == 1.0 and all(x in (0.0, 1.0) for x in lengths)
    own = V.vectorise(df, "m", encoder=lambda d, t, o: d.withColumn(o, F.array(F.lit(1.0))))
    assert own.first().vector == [1.0]


def test_separability_labels(spark):
    df = spark.createDataFrame([(0.9,), (0.7,), (0.6,)], "a double")
    assert [r[0].split(":")[0] for r in df.select(V.separability(F.col("a"))).collect()] == ["HIGH", "MODERATE", "LOW"]


def test_hash_sample_is_reproducible_and_capped(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    a = {r.k for r in sample_rows(df.repartition(7), ["k"], 0.1, era="x").collect()}
    b = {r.k for r in sample_rows(df.repartition(3), ["k"], 0.1).collect()}
    assert a == b and 400 < len(a) < 600
    capped = {r.k for r in sample_rows(df, ["k"], 0.1, cap=50).collect()}
    assert len(capped) == 50 and capped <= a


def test_capped_sample_is_the_least_hashes(spark):
    from eventlens.operators.ranking import hash_fraction

    df = spark.range(3000).selectExpr("id % 700 AS k")  # hashes tie
    rows = [(r[0], r[1]) for r in df.select(hash_fraction("k"), "k").collect()]
    for cap in (1, 7, 500, 2999, 3000, 9000):
        got = sorted(r.k for r in sample_rows(df, ["k"], 1.0, cap=cap).collect())
        assert got == sorted(k for _, k in sorted(rows)[:cap])
    with pytest.raises(ValueError):
        sample_rows(df, ["k"], 1e-10)
