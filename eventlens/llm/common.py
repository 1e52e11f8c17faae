"""Helpers shared by the operators: table access, null-safe columns, packed text, small hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SLICE_BYTES = 1 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under a name, with its SQL check."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z only, whatever the locale or script."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def encode(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes each, so that arrays per byte stay small."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def packed(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with a space after each document, A-Z in lower case, and the offset of each (one more at the end)."""
    buf = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    return (_LOWER[buf] if lower else buf), offsets


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words of a buffer that ends in a space."""
    space = _IS_SPACE[buf]
    edge = np.empty(len(buf), dtype=bool)
    edge[0] = not space[0]
    np.not_equal(space[1:], space[:-1], out=edge[1:])
    at = np.flatnonzero(edge)
    return at[0::2], at[1::2]


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (three xor-shifts and two products)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class SpanHasher:
    """Hashes of any span of a buffer from prefix sums; spans of equal bytes have equal hashes."""

    _powers = np.ones(1, dtype=np.uint64)
    _inverses = np.ones(1, dtype=np.uint64)

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        if len(SpanHasher._powers) <= n:
            size = max(n + 1, SLICE_BYTES + 1)
            inverse = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
            SpanHasher._powers = np.cumprod(np.full(size, MULTIPLIER, dtype=np.uint64))
            SpanHasher._inverses = np.cumprod(np.full(size, inverse, dtype=np.uint64))
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        value = buf.astype(np.uint64)
        value += np.uint64(1)
        value *= SpanHasher._powers[:n]
        np.cumsum(value, out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.sums[ends] - self.sums[starts]) * SpanHasher._inverses[starts])


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span."""
    return SpanHasher(buf).spans(starts, ends)
