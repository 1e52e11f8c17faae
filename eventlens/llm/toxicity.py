"""Toxicity: a logistic classifier with counterfactual regularisation.

Features are hashed words and word beginnings (signs are left out), each with the logarithm of its count up to a limit.  In labelled texts that mention a
group, the mention is swapped for another of its kind; the fit penalises the squared change of the score, so that the
mention itself carries no weight and neutral mentions aren't taken for insults.  Probabilities are calibrated on a part
of the sample that the fit hasn't seen.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import encode, packed, query, slices, span_hashes, table, word_spans
from eventlens.llm.linear import class_weights, fit_calibrated, labelled_sample, sigmoid, unpack

#: Terms of one tuple can take each other's place in a sentence.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("gay", "straight", "lesbian", "bisexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist"), ("muslims", "christians", "jews", "hindus", "buddhists"),
    ("black", "white", "asian", "latino"), ("african", "european", "american", "mexican"),
    ("immigrants", "natives"), ("old", "young"), ("blind", "deaf"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("frauen", "männer"), ("muslime", "christen", "juden"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
DIMS = 1 << 18
PREFIXES = (6, 7)
SAMPLE_PER_CLASS = 4000
L2 = 2e-5
#: Further occurrences of a word say nothing new.
MOST_COUNTED = 8
PENALTY = 1.0
THRESHOLD = 0.5


#: Signs become spaces: letters, digits and everything beyond ASCII make words.
_LETTERS = np.full(256, 32, dtype=np.uint8)
_LETTERS[48:58], _LETTERS[97:123], _LETTERS[128:] = range(48, 58), range(97, 123), range(128, 256)


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of hashed words and word beginnings, sorted by row and feature."""
    data = [encode(t) for t in texts]
    rows, index, value = [], [], []
    for begin, end in slices(data):
        buf, offsets = packed(data[begin:end])
        buf = _LETTERS[buf]
        starts, ends = word_spans(buf)
        owner = np.searchsorted(offsets, starts, side="right") - 1 + begin
        keys = [(owner.astype(np.uint64) << np.uint64(20)) | (span_hashes(buf, starts, ends) & np.uint64(DIMS - 1))]
        for n in PREFIXES:
            long = ends - starts > n
            h = span_hashes(buf, starts[long], starts[long] + n) + np.uint64(n)
            keys.append((owner[long].astype(np.uint64) << np.uint64(20)) | (h & np.uint64(DIMS - 1)))
        key, count = np.unique(np.concatenate(keys), return_counts=True)
        rows.append((key >> np.uint64(20)).astype(np.int64))
        index.append((key & np.uint64(DIMS - 1)).astype(np.int32))
        value.append(np.log1p(np.minimum(count, MOST_COUNTED)).astype(np.float32))
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate(rows or [none]), np.concatenate(index or [none]).astype(np.int32), np.concatenate(value or [none]).astype(np.float32)


def swapper(terms=IDENTITY_TERMS):
    """Function that gives a text with each identity term replaced by the next of its kind, or None if it has none."""
    successor = {t: group[(i + 1) % len(group)] for group in terms for i, t in enumerate(group)}
    pattern = re.compile(r"(?<!\w)(" + "|".join(sorted(map(re.escape, successor), key=len, reverse=True)) + r")(?!\w)", re.IGNORECASE)

    def swap(text: str | None) -> str | None:
        if not text or not pattern.search(text):
            return None
        return pattern.sub(lambda m: successor[m.group().lower()], text)

    return swap


def _split(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    row, index, value = features(texts)
    cut = np.searchsorted(row, np.arange(len(texts) + 1))
    return [(index[a:b], value[a:b]) for a, b in zip(cut[:-1], cut[1:])]


def _difference(a, b) -> tuple[np.ndarray, np.ndarray]:
    index, inverse = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    change = np.bincount(inverse, weights=np.concatenate([a[1], -b[1]]), minlength=len(index))
    return index[change != 0].astype(np.int32), change[change != 0].astype(np.float32)


@dataclass
class ToxicityModel:
    weights: np.ndarray
    intercept: float
    slope: float
    shift: float
    #: Labelled texts whose mentions were swapped for the penalty.
    pairs: int = 0

    def score(self, texts: list[str | None]) -> np.ndarray:
        row, index, value = features(texts)
        z = np.bincount(row, weights=self.weights[index] * value, minlength=len(texts)) + self.intercept
        return sigmoid(self.slope * z + self.shift)


def fit_toxicity(docs: DataFrame, labels: DataFrame, keep: Column | None = None, per_class: int = SAMPLE_PER_CLASS, l2: float = L2,
                 penalty: float = PENALTY, terms=IDENTITY_TERMS, id_col: str = "doc_id", text_col: str = "text",
                 label: str = "toxic") -> ToxicityModel:
    """Fits on at most ``per_class`` labelled documents of each class (``keep`` selects labels by the column id).

    Without labels of both classes the model gives every text the share of label 1 (one half without any label).
    """
    sample, counts = labelled_sample(docs, labels, label, per_class, keep, id_col, text_col)

    def extract(batches):
        swap = swapper(terms)
        for pdf in batches:
            texts = pdf["text"].tolist()
            own = _split(texts)
            changed = [swap(t) for t in texts]
            other = _split([c if c is not None else "" for c in changed])
            pairs = [_difference(a, b) if c is not None else (a[0][:0], a[1][:0]) for a, b, c in zip(own, other, changed)]
            yield pd.DataFrame({
                "id": pdf["id"], "label": pdf["label"], "index": [i.tobytes() for i, _ in own], "value": [v.tobytes() for _, v in own],
                "pair_index": [i.tobytes() for i, _ in pairs], "pair_value": [v.tobytes() for _, v in pairs]})

    schema = f"id {dict(sample.dtypes)['id']}, label int, index binary, value binary, pair_index binary, pair_value binary"
    rows = sample.mapInPandas(extract, schema).toArrow().to_pandas().sort_values("id", ignore_index=True)
    y = rows["label"].to_numpy(dtype=float)
    if len(set(y)) < 2:
        share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
        share = min(max(share, 1e-3), 1 - 1e-3)
        return ToxicityModel(np.zeros(DIMS), 0.0, 1.0, float(np.log(share / (1 - share))))
    x = unpack(rows, "index", "value", DIMS)
    paired = rows["pair_index"].str.len() > 0
    pairs = unpack(rows[paired], "pair_index", "pair_value", DIMS)
    del rows
    fitted, slope, shift = fit_calibrated(x, y, class_weights(y, counts), l2, pairs, penalty)
    return ToxicityModel(fitted[:-1].astype(np.float32), float(fitted[-1]), slope, shift, int(paired.sum()))


def score_column(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> Column:
    """Probability of label 1; a null or empty text gets the score of no words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(texts.tolist()))

    return score(F.col(text_col))


def held_out(column: Column) -> Column:
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def drop_toxic(docs: DataFrame, labelled: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score under the threshold; learns from ``labelled`` and ``labels``."""
    return docs.where(score_column(docs, fit_toxicity(labelled, labels, ~held_out(F.col("id")))) < threshold)


@query("op10_toxicity")
def op10(spark, d):
    """Toxicity of every document, learnt without the held-out fifth of the labels; n_pairs: texts with swapped mentions in the fit."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, d, "labels"), ~held_out(F.col("id")))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(docs, model).alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")).withColumn("n_pairs", F.lit(model.pairs).cast("long"))
