"""Vectors per row: text to unit vectors, centroids and drift, splits, a linear classifier and its scores."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, CountVectorizerModel, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens import config
from eventlens.operators.ranking import top_k
from eventlens.operators.ranks import join_on, pair_counts
from eventlens.session import materialise


def vectorise(df: DataFrame, text: str, out: str = "vector", dims: int = 1024,
              encoder: Callable[[DataFrame, str, str], DataFrame] | None = None) -> DataFrame:
    """Adds a unit-length vector per message.

    ``encoder(df, text, out)`` may supply any other embedding (``model_encoder`` makes
    one of a model).  The default hashes terms and weighs them by inverse document
    frequency; its vectors stay sparse.
    """
    if encoder is not None:
        return encoder(df, text, out)
    terms = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    # the first 32 bits of the MD5 of a term, a hash that any engine repeats
    number = lambda t: (F.conv(F.substring(F.md5(t.cast("binary")), 1, 8), 16, 10).cast("bigint") % dims).cast("string")
    rows = df.withColumn("_words", F.transform(terms, number))
    stages = [CountVectorizerModel.from_vocabulary([str(i) for i in range(dims)], inputCol="_words", outputCol="_tf"),
              IDF(inputCol="_tf", outputCol="_idf"),
              Normalizer(inputCol="_idf", outputCol="_unit", p=2.0)]
    fitted = Pipeline(stages=stages).fit(rows).transform(rows)
    return fitted.withColumnRenamed("_unit", out).drop("_words", "_tf", "_idf")


# Models by the name under which an encoder was made; a worker process serves many tasks.
_MODELS: dict[str, Callable] = {}


def model_encoder(name: str, load: Callable[[], Callable[[list[str]], np.ndarray]], rows: int = 256, normalise: bool = True):
    """An encoder for ``vectorise`` around any model that turns a list of texts into an array of one vector each.

    ``load`` runs once per worker process, not per task or batch, and the model sees at most ``rows`` texts at a time,
    whatever the size of the batches that arrive.  ``name`` names the model and its settings.  A null text is empty; with
    ``normalise`` vectors have unit length, or are zero.
    """

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if name not in _MODELS:
            _MODELS[name] = load()
        for batch in batches:
            texts, out = batch.fillna("").tolist(), []
            for at in range(0, len(texts), rows):
                v = np.asarray(_MODELS[name](texts[at:at + rows]), dtype=np.float64)
                if normalise:
                    length = np.sqrt((v * v).sum(axis=1, keepdims=True))
                    v = np.divide(v, length, out=np.zeros_like(v), where=length > 0)
                out.extend(v.astype(np.float32))
            yield pd.Series(out, dtype=object)

    return lambda df, text, out: df.withColumn(out, encode(F.col(text)))


def hashed_terms(dims: int) -> Callable[[list[str]], np.ndarray]:
    """A model that needs no training: counts of terms by the first 32 bits of their MD5."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims))
        for row, text in zip(out, texts):
            for term in re.findall(r"[^\x20\x09-\x0D]+", text):
                row[int.from_bytes(hashlib.md5(term.encode()).digest()[:4], "big") % dims] += 1
        return out

    return encode


def _vector(df: DataFrame, column: str) -> Column:
    """A column of arrays or of vectors, as vectors."""
    return F.col(column) if isinstance(df.schema[column].dataType, VectorUDT) else array_to_vector(F.col(column).cast("array<double>"))


def centroids(df: DataFrame, vector: str, group: Column) -> DataFrame:
    """group, centroid, n.  Vectors are summed whole on the map side, never exploded per dimension."""
    rows = df.select(group.alias("group"), _vector(df, vector).alias("_v"))
    g = rows.groupBy("group").agg(Summarizer.metrics("mean", "count").summary(F.col("_v")).alias("s"))
    return g.select("group", vector_to_array("s.mean").alias("centroid"), F.col("s.count").alias("n"))


def centroid_coordinates(cents: DataFrame) -> DataFrame:
    return cents.select("group", F.posexplode("centroid").alias("dim", "value"))


def _paired(df: DataFrame, vector: str, in_pre: Column) -> DataFrame:
    """One row with both centroids (pre, post)."""
    c = centroids(df, vector, in_pre)
    side = lambda flag: F.max_by("centroid", F.when(F.col("group") == flag, 1))
    return c.agg(side(True).alias("pre"), side(False).alias("post"))


def centroid_drift(df: DataFrame, vector: str, in_pre: Column) -> DataFrame:
    """Distance between the mean vectors of two groups.

    ``cosine_similarity`` is the dot product of the unnormalised centroids, as
    in the published figure; ``true_cosine`` divides by their lengths.
    """
    p = _paired(df, vector, in_pre)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    diff = F.zip_with("post", "pre", lambda x, y: x - y)
    p = p.select(F.sqrt(dot(diff, diff)).alias("l2_distance"), dot("pre", "post").alias("cosine_similarity"),
                 F.sqrt(dot("pre", "pre") * dot("post", "post")).alias("_len"))
    return p.select("l2_distance", (1 - F.col("cosine_similarity")).alias("cosine_distance"), "cosine_similarity",
                    F.try_divide("cosine_similarity", "_len").alias("true_cosine"))


def drift_dimensions(df: DataFrame, vector: str, in_pre: Column, top: int = 10) -> DataFrame:
    """The dimensions that moved most, with their signed move."""
    diff = F.zip_with("post", "pre", lambda x, y: x - y)
    dims = _paired(df, vector, in_pre).select(F.posexplode(diff).alias("dim", "drift"))
    return top_k(dims, [F.desc(F.abs("drift")), F.asc("dim")], top)


# ---- train / test ----------------------------------------------------------
def stratified_split(df: DataFrame, key: str, label: str, train_fraction: float = 0.8, seed: int = 42) -> DataFrame:
    """Adds ``is_train``: exactly floor(fraction * n) rows of every label, chosen by a hash of the key.

    The hash decides by itself for all rows but those of the one hash bucket
    per label that holds the cut; only these are ranked.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    rows = df.withColumns({"_h": digest, "_b": F.conv(F.substring(digest, 1, 4), 16, 10).cast("int")})
    w = Window.partitionBy(label)
    upto = F.sum("_c").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counts = rows.groupBy(label, "_b").agg(F.count("*").alias("_c")).select(
        label, "_b", "_c", upto.alias("_upto"), F.floor(F.sum("_c").over(w) * F.lit(train_fraction)).alias("_cut"))
    # one row per label: the bucket at which the cut is reached, and how many of its rows are before the cut
    at = counts.where(F.col("_upto") >= F.col("_cut")).groupBy(label).agg(
        F.min(F.struct(F.col("_b").alias("b"), (F.col("_cut") - F.col("_upto") + F.col("_c")).alias("room"))).alias("_at")).select(
        label, F.col("_at.b").alias("_cut_b"), F.col("_at.room").alias("_room"))
    placed = join_on(rows, at, [label])
    clear = placed.where(F.col("_b") != F.col("_cut_b")).withColumn("is_train", F.col("_b") < F.col("_cut_b"))
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_h", key))
    edge = placed.where(F.col("_b") == F.col("_cut_b")).withColumn("is_train", rank <= F.col("_room"))
    return clear.unionByName(edge).drop("_h", "_b", "_cut_b", "_room")


def standardise(train: DataFrame, rows: DataFrame, vector: str, out: str = "scaled") -> DataFrame:
    """Centres and scales by the training mean and population deviation; a constant dimension becomes 0.

    One pass over the training rows gives all three moments, a number per dimension each.
    """
    s = train.select(_vector(train, vector).alias("_v")).agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("_v")).alias("s")).select(
        vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("variance"), F.col("s.count").alias("n")).first()
    shrink = (s.n - 1) / s.n if s.n > 1 else 1.0
    factor = [1 / (v * shrink) ** 0.5 if v > 0 else 0.0 for v in s.variance]
    values = F.col(vector).cast("array<double>") if not isinstance(rows.schema[vector].dataType, VectorUDT) else vector_to_array(vector)
    centred = F.zip_with(values, F.lit([float(m) for m in s["mean"]]), lambda x, m: x - m)
    return rows.withColumn(out, F.zip_with(centred, F.lit(factor), lambda x, f: x * f))


def fit_classifier(train: DataFrame, vector: str, label: str, c: float = 1.0, max_iter: int = 1000) -> LogisticRegressionModel:
    """L2-regularised logistic regression, intercept not penalised."""
    rows = train.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"))
    n = rows.count()
    return LogisticRegression(regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False,
                              maxIter=max_iter, tol=1e-8).fit(rows)


def loss_gradient(model: LogisticRegressionModel, train: DataFrame, vector: str, label: str) -> DataFrame:
    """dim, gradient of the penalised mean log loss; zero everywhere at the optimum.  The intercept is dimension -1."""
    features = array_to_vector(F.col(vector).cast("array<double>"))
    p = model.transform(train.withColumn("features", features)).select(
        vector_to_array("features").alias("x"), (vector_to_array("probability")[1] - F.col(label)).alias("e"))
    pulled = p.select(array_to_vector(F.transform(F.concat(F.array(F.lit(1.0)), "x"), lambda v: v * F.col("e"))).alias("g"))
    mean = pulled.agg(Summarizer.mean(F.col("g")).alias("g")).select(F.posexplode(vector_to_array("g")).alias("at", "pull"))
    weights = F.lit([0.0, *[float(w) * model.getRegParam() for w in model.coefficients]])
    return mean.select((F.col("at") - 1).alias("dim"), (F.col("pull") + F.element_at(weights, F.col("at") + 1)).alias("gradient"))


def score(model: LogisticRegressionModel, rows: DataFrame, vector: str) -> DataFrame:
    """Adds ``score``, the probability of class 1."""
    v = rows.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    return model.transform(v).withColumn("score", vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", "prediction")


def auc(df: DataFrame, score_col: str, positive: Column, keys: list[str] = (), ranges: int | None = None) -> DataFrame:
    """Exact area under the ROC curve: the share of (positive, negative) pairs in the right order."""
    keyed = df if keys else df.withColumn("_all", F.lit(1))
    ks = list(keys) or ["_all"]
    c = pair_counts(keyed, ks, score_col, positive, ranges)
    out = c.select(*ks, F.try_divide(F.col("wins") + F.col("draws") / 2, F.col("n1").cast("double") * F.col("n2")).alias("auc_roc"))
    return out if keys else out.drop("_all")


def confusion_metrics(df: DataFrame, score_col: str, positive: Column, threshold: float = 0.5) -> DataFrame:
    """Accuracy, and precision, recall and F1 of the positive class; empty denominators give 0."""
    said = F.col(score_col) > threshold
    g = df.agg(F.count_if(said & positive).alias("tp"), F.count_if(said & ~positive).alias("fp"),
               F.count_if(~said & positive).alias("fn"), F.count_if(~said & ~positive).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return g.withColumns({
        "accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def separability(auc_col: Column) -> Column:
    expr = None
    for bound, label in config.SEPARABILITY:
        expr = F.when(auc_col > bound, label) if expr is None else expr.when(auc_col > bound, label)
    return expr.otherwise(config.SEPARABILITY_DEFAULT)


def era_classifier(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """Split, standardise, fit, and judge on the held-out rows: one row of metrics."""
    # split and scaled vectors feed several passes of the optimiser: store them once
    rows = materialise(stratified_split(df, key, label))
    rows = standardise(rows.where("is_train"), rows, vector)
    model = fit_classifier(rows.where("is_train"), "scaled", label)
    held = score(model, rows.where("NOT is_train"), "scaled")
    positive = F.col(label) == 1
    area = auc(held, "score", positive).scalar()
    out = confusion_metrics(held, "score", positive).withColumn("auc_roc", area).where("auc_roc IS NOT NULL")
    return out.withColumn("interpretation", separability(F.col("auc_roc")))
