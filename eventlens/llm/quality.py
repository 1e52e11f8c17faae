"""Quality rules: counted rules, and a calibrated logistic regression on hashed n-grams against a fixed threshold.

Features are the relative frequencies of hashed words, pairs of words and runs of three bytes (as written, so that
capitals and symbols count).  A score is then a mean of weights per kind, computed over whole texts in Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import encode, mix64, packed, query, slices, span_hashes, table, word_spans
from eventlens.llm.linear import class_weights, fit_calibrated, labelled_sample, sigmoid, unpack

DIMS = 1 << 18
SCALE = 20.0
SAMPLE_PER_CLASS = 4000
L2 = 1e-5
THRESHOLD = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_MASK = np.uint64(DIMS - 1)


@dataclass
class _Slice:
    """Words of some texts: buffer, offsets of texts, spans of words, text of each word, hash of each word."""

    buf: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    owner: np.ndarray
    words: np.ndarray

    @staticmethod
    def of(texts: list[bytes]) -> _Slice:
        buf, offsets = packed(texts, lower=False)
        starts, ends = word_spans(buf)
        owner = np.searchsorted(offsets, starts, side="right") - 1
        return _Slice(buf, offsets, starts, ends, owner, span_hashes(buf, starts, ends))

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def grams(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(text, feature) of each occurrence, per kind of feature."""
        pair = self.owner[1:] == self.owner[:-1]
        pairs = mix64(self.words[:-1] * np.uint64(3) + self.words[1:])[pair]
        b = self.buf.astype(np.uint64)
        runs = mix64((b[:-2] << np.uint64(16)) | (b[1:-1] << np.uint64(8)) | b[2:])
        at = np.arange(len(runs))
        of = np.repeat(np.arange(len(self)), np.diff(self.offsets))[: len(runs)]
        inside = at + 3 <= self.offsets[of + 1]
        return [
            (self.owner, (self.words & _MASK).astype(np.int32)),
            (self.owner[1:][pair], (pairs & _MASK).astype(np.int32)),
            (of[inside], (runs[inside] & _MASK).astype(np.int32)),
        ]

    def counts(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        n = len(self)
        first = self.offsets[:-1]
        in_word = ~_SPACE[self.buf] & ((self.buf & 0xC0) != 0x80)
        windows = (self.owner[2:] == self.owner[:-2]) if len(self.owner) > 2 else np.zeros(0, dtype=bool)
        at = np.flatnonzero(windows)
        key = mix64(self.words[at] * np.uint64(5) + mix64(self.words[at + 1] * np.uint64(3) + self.words[at + 2]))
        key = mix64(key + self.owner[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
        repeated = np.zeros(len(self.owner), dtype=bool)
        again = at[times[inverse] > 1] if len(at) else at
        for shift in range(3):
            repeated[again + shift] = True
        return {
            "n_words": np.bincount(self.owner, minlength=n),
            "word_chars": np.add.reduceat(in_word.astype(np.int64), first),
            "n_symbols": np.add.reduceat(_SYMBOL[self.buf].astype(np.int64), first),
            "n_dup_lines": np.array([repeated_lines(t) for t in texts], dtype=np.int64),
            "n_repeat_words": np.bincount(self.owner, weights=repeated, minlength=n).astype(np.int64),
        }


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    return len(lines) - len(set(lines))


@dataclass
class QualityModel:
    weights: np.ndarray
    intercept: float
    slope: float
    shift: float

    def margin(self, s: _Slice) -> np.ndarray:
        z = np.full(len(s), self.intercept)
        for owner, feature in s.grams():
            total = np.bincount(owner, weights=self.weights[feature], minlength=len(s))
            z += SCALE * total / np.maximum(np.bincount(owner, minlength=len(s)), 1)
        return z


def features(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, values) of each text."""
    out = []
    for begin, end in slices(texts):
        s = _Slice.of(texts[begin:end])
        keys, values = [], []
        for owner, feature in s.grams():
            keys.append((owner.astype(np.int64) << 20) | feature)
            values.append(SCALE / np.maximum(np.bincount(owner, minlength=len(s)), 1)[owner])
        key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        value = np.bincount(inverse, weights=np.concatenate(values), minlength=len(key)).astype(np.float32)
        cut = np.searchsorted(key >> 20, np.arange(len(s) + 1))
        index = (key & (DIMS - 1)).astype(np.int32)
        out += [(index[a:b], value[a:b]) for a, b in zip(cut[:-1], cut[1:])]
    return out


def fit_quality(docs: DataFrame, labels: DataFrame, keep: Column | None = None, per_class: int = SAMPLE_PER_CLASS, l2: float = L2,
                id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> QualityModel:
    """Fits on at most ``per_class`` labelled documents of each class; calibrates on a fifth that the fit hasn't seen.

    Without labels of both classes every text gets probability 1, so that only the counted rules decide.
    """
    sample, counts = labelled_sample(docs, labels, label, per_class, keep, id_col, text_col)

    def extract(batches):
        for pdf in batches:
            own = features([encode(t) for t in pdf["text"]])
            yield pd.DataFrame({"id": pdf["id"], "label": pdf["label"], "index": [i.tobytes() for i, _ in own], "value": [v.tobytes() for _, v in own]})

    rows = sample.mapInPandas(extract, f"id {dict(sample.dtypes)['id']}, label int, index binary, value binary").toArrow().to_pandas()
    rows = rows.sort_values("id", ignore_index=True)
    y = rows["label"].to_numpy(dtype=float)
    if len(set(y)) < 2:
        return QualityModel(np.zeros(DIMS, dtype=np.float32), 0.0, 1.0, 50.0)
    x = unpack(rows, "index", "value", DIMS)
    del rows
    fitted, slope, shift = fit_calibrated(x, y, class_weights(y, counts), l2)
    return QualityModel(fitted[:-1].astype(np.float32), float(fitted[-1]), slope, shift)


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def assess(docs: DataFrame, model: QualityModel, text_col: str = "text", assessed: str = "assessed") -> DataFrame:
    """``docs`` with a struct ``assessed``: the five counts and the calibrated probability of good quality.

    A null or empty text has zero counts and the probability of no features.  A column of that name is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<" + ",".join(f"{c}:bigint" for c in _COUNTS) + ",probability:double>")
    def score(texts: pd.Series) -> pd.DataFrame:
        data, model = [encode(t) for t in texts], shared.value
        parts = []
        for begin, end in slices(data):
            s = _Slice.of(data[begin:end])
            part = pd.DataFrame(s.counts(data[begin:end]), columns=_COUNTS)
            part["probability"] = sigmoid(model.slope * model.margin(s) + model.shift)
            parts.append(part)
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=[*_COUNTS, "probability"])

    return docs.drop(assessed).withColumn(assessed, score(F.col(text_col)))


def verdict(assessed: str = "assessed", threshold: float = THRESHOLD) -> list[Column]:
    """Columns of the counts, base_failed and kept."""
    failed = (F.col(f"{assessed}.n_words") < MIN_WORDS) | (
        100 * F.col(f"{assessed}.n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{assessed}.n_words"))
    counts = [F.col(f"{assessed}.{c}").alias(c) for c in _COUNTS]
    return [*counts, failed.alias("base_failed"), (~failed & (F.col(f"{assessed}.probability") >= threshold)).alias("kept")]


@query("op3_quality_rules")
def op3(spark, d):
    """Counts, rules and verdict of every document."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, d, "labels"))
    return assess(docs, model).select("doc_id", *verdict(), F.col("assessed.probability").alias("probability"))
