"""Logistic regression on hashed sparse features: bounded labelled samples, fitting, calibration.

The rows to learn from are a bounded sample, chosen by a hash of their id; their features are computed in tasks, and
only these (numbers of features and values) reach the driver.  Scores of all documents are computed in tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Sparse:
    """Rows of features: row r has the features index[start[r]:start[r + 1]]."""

    start: np.ndarray
    index: np.ndarray
    value: np.ndarray
    dims: int

    @staticmethod
    def of(rows: list[tuple[np.ndarray, np.ndarray]], dims: int) -> Sparse:
        start = np.zeros(len(rows) + 1, dtype=np.int64)
        np.cumsum([len(i) for i, _ in rows], out=start[1:])
        empty = [np.zeros(0, dtype=np.int32)]
        return Sparse(start, np.concatenate([i for i, _ in rows] or empty),
                      np.concatenate([v for _, v in rows] or empty).astype(np.float32), dims)

    def __len__(self) -> int:
        return len(self.start) - 1

    def _blocks(self):
        """Ranges of rows with about a million features each, so that temporary arrays stay small."""
        row = 0
        while row < len(self):
            upto = max(row + 1, int(np.searchsorted(self.start, self.start[row] + (1 << 20), side="right")) - 1)
            yield row, upto, slice(self.start[row], self.start[upto])
            row = upto

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.empty(len(self))
        for a, b, s in self._blocks():
            owner = np.repeat(np.arange(b - a), np.diff(self.start[a : b + 1]))
            out[a:b] = np.bincount(owner, weights=w[self.index[s]] * self.value[s], minlength=b - a)
        return out

    def transposed_times(self, r: np.ndarray) -> np.ndarray:
        out = np.zeros(self.dims)
        for a, b, s in self._blocks():
            out += np.bincount(self.index[s], weights=np.repeat(r[a:b], np.diff(self.start[a : b + 1])) * self.value[s], minlength=self.dims)
        return out


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def minimise(loss, x: np.ndarray, rounds: int = 80, memory: int = 8, tolerance: float = 1e-5) -> np.ndarray:
    """Limited-memory BFGS with a backtracking step; ``loss`` gives value and gradient."""
    f, g = loss(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, alphas = g.copy(), []
        for s, y in reversed(steps):
            alphas.append((s @ d) / (y @ s))
            d -= alphas[-1] * y
        if steps:
            s, y = steps[-1]
            d *= (s @ y) / (y @ y)
        for (s, y), alpha in zip(steps, reversed(alphas)):
            d += s * (alpha - (y @ d) / (y @ s))
        size, slope = (1.0 if steps else 1 / max(1.0, float(np.linalg.norm(g)))), float(g @ d)
        for _ in range(30):
            nf, ng = loss(x - size * d)
            if nf <= f - 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, y = -size * d, ng - g
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-memory:]
        done = f - nf <= tolerance * max(1.0, abs(f)) * 0.1
        x, f, g = x - size * d, nf, ng
        if done:
            break
    return x


def fit_logistic(x: Sparse, y: np.ndarray, weight: np.ndarray, l2: float, pairs: Sparse | None = None, penalty: float = 0.0) -> np.ndarray:
    """Weights and, last, the intercept.

    Minimises the weighted mean log loss + l2/2 |w|^2 + penalty/2 mean (w.pair)^2, where a row of ``pairs`` is the
    difference of the features of a text and its counterfactual.
    """
    weight = weight / weight.sum()

    def loss(v):
        w = v[:-1]
        z = x.times(w) + v[-1]
        value = float(weight @ (np.logaddexp(0, z) - y * z)) + l2 / 2 * float(w @ w)
        r = weight * (sigmoid(z) - y)
        g = np.append(x.transposed_times(r) + l2 * w, r.sum())
        if pairs is not None and len(pairs):
            d = pairs.times(w)
            value += penalty / 2 * float(d @ d) / len(pairs)
            g[:-1] += penalty * pairs.transposed_times(d) / len(pairs)
        return value, g

    return minimise(loss, np.zeros(x.dims + 1))


def calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift that turn scores into probabilities (by a logistic fit with softened labels)."""
    positive, negative = float(y.sum()), float(len(y) - y.sum())
    if not positive or not negative:
        return 1.0, 0.0
    soft = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    weight = weight / weight.sum()

    def loss(v):
        t = v[0] * z + v[1]
        r = weight * (sigmoid(t) - soft)
        return float(weight @ (np.logaddexp(0, t) - soft * t)), np.array([r @ z, r.sum()])

    slope, shift = minimise(loss, np.array([1.0, 0.0]), tolerance=1e-9)
    return (float(slope), float(shift)) if slope > 0 else (1.0, 0.0)


def fit_calibrated(x: Sparse, y: np.ndarray, weight: np.ndarray, l2: float, pairs: Sparse | None = None,
                   penalty: float = 0.0) -> tuple[np.ndarray, float, float]:
    """Weights with the intercept last, slope and shift; a fifth of the rows is kept from the fit to calibrate on."""
    held = np.random.default_rng(0).random(len(y)) < 0.2
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        return fit_logistic(x, y, weight, l2, pairs, penalty), 1.0, 0.0
    fitted = fit_logistic(x, y, np.where(held, 0, weight), l2, pairs, penalty)
    z = x.times(fitted[:-1]) + fitted[-1]
    return fitted, *calibrate(z[held], y[held], weight[held])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, keep: Column | None = None,
                    id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """(id, text, label) of at most ``per_class`` documents of each class, and the number of labelled ids of each class.

    The sample is the ids of smallest hash.  A null label counts for nothing, a repeated one once, and ids whose
    labels contradict each other are left out.  Of rows that repeat an id one text is taken.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
    if keep is not None:
        known = known.where(keep)
    known = known.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("id", F.lit(5)), "id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most 2 * per_class ids
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    one = rows.groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("first"))
    return one.select("id", "label", F.col("first.text").alias("text")), counts


def class_weights(y: np.ndarray, counts: dict[int, int]) -> np.ndarray:
    """Weights that give each class the share that it has among all labelled rows."""
    size = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    return np.where(y > 0, counts.get(1, 0) / size[1], counts.get(0, 0) / size[0])


def unpack(rows: pd.DataFrame, index: str, value: str, dims: int) -> Sparse:
    return Sparse.of([(np.frombuffer(i, dtype=np.int32), np.frombuffer(v, dtype=np.float32)) for i, v in zip(rows[index], rows[value])], dims)
