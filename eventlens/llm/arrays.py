"""Arrays in compressed blobs, and dealing rows of arrays out to partitions."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard

from eventlens.llm.common import mix64

#: Rows that stages exchange: a target, what the blob is, and the blob.
ROW = "part long, kind string, blob binary"
ARROW_ROW = pa.schema([("part", pa.int64()), ("kind", pa.string()), ("blob", pa.binary())])


def dump(*arrays) -> bytes:
    return zstandard.compress(pickle.dumps(arrays, 5), 1)


def load(blob: bytes) -> tuple:
    return pickle.loads(zstandard.decompress(blob))


def planes(values: np.ndarray) -> bytes:
    """64-bit values with their byte planes apart, so that high zeros compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def sorted_planes(values: np.ndarray) -> bytes:
    """The same for sorted values, as differences."""
    return planes(np.diff(values, prepend=np.uint64(0)))


def from_sorted_planes(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data))


def narrow(values: np.ndarray) -> np.ndarray:
    """Non-negative integers in the smallest type that holds them."""
    top = int(values.max()) if len(values) else 0
    return values.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


def frame(rows: list[tuple[int, str, bytes]]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["part", "kind", "blob"])


def record_batch(rows: list[tuple[int, str, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pandas(frame(rows), schema=ARROW_ROW, preserve_index=False)


def heads(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of sorted keys begins."""
    new = np.ones(len(keys[0]), dtype=bool)
    if len(new):
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new


def by_target(target: np.ndarray, *arrays: np.ndarray):
    """(target, arrays) for each target that occurs, in the given order within it."""
    order = np.argsort(target, kind="stable")
    target = target[order]
    cut = np.flatnonzero(heads(target))
    for a, b in zip(cut, np.append(cut[1:], len(target))):
        yield int(target[a]), [x[order[a:b]] for x in arrays]


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def part_of_ids(ids: np.ndarray, parts: int) -> np.ndarray:
    return part_of(mix64(ids.view(np.uint64) + np.uint64(1)), parts)
