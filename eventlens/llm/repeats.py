"""Exact removal of repeated passages through a run-length index.

A byte is removed if a string of ``length`` bytes that covers it also starts earlier (smaller id, or earlier in the
same document).  Two equal strings hold the same least hashed gram of ``GRAM`` bytes at the same offset: their anchor.
So strings are compared only where anchors are equal.

1. Each task finds the anchors of its texts.  An anchor stands for the strings that have it as their least gram; its
   context is the text that these cover.  Of equal contexts one, the first, can stay as it is: the strings of the
   others all start earlier.
2. Anchors are exchanged by hash, and equal contexts compared across tasks.  An anchor with a single context is done.
   Of several contexts of one anchor (the edges of copied passages), the first is the reference of the others.
3. The texts of those contexts are cut out and exchanged by anchor.  A run-length index is built over the references
   of a shard; matching statistics of the other contexts are streamed through it, and strings of ``length`` bytes that
   it holds start earlier.  Strings that the references lack are compared among the rest by their digests.
4. Ranges of removed bytes meet their documents.

Rows between stages are compressed blobs of arrays, one per task and target; there is a partition for every
``PART_BYTES`` of text, and at least four for each of ``spark.sql.shuffle.partitions``.  A passage in very many different surroundings has one anchor with very many contexts:
a task that sees more than ``HOT`` of them for one anchor sends its first to step 2 and the others straight to step 3,
where they are spread over ``SPREAD`` parts, each with a copy of the reference; strings not in the reference are then
compared by an aggregation over all parts.

Grams are found by a rolling hash; that only brings strings together, so a chance or crafted collision costs time and
nothing else.  Contexts and strings count as equal by a digest under a key that each run draws anew (BLAKE2: 64 bits
among the contexts of one gram, 128 bits among strings), which no text can be crafted for.
"""

from __future__ import annotations

import hashlib
import os
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlens.llm.arrays import ROW, by_target, dump, frame, from_sorted_planes, heads, load, part_of, part_of_ids, record_batch, sorted_planes
from eventlens.llm.common import SpanHasher, mix64, query, table
from eventlens.llm.runindex import RunLengthIndex
from eventlens.session import materialise

LENGTH = 100
GRAM = 32
HOT = 64
SPREAD = 64
#: Bytes of text per partition of texts, anchors and contexts.
PART_BYTES = 16 << 20
_SEGMENT = 1 << 18
_BLOCK = 1 << 14
_FLUSH_ANCHORS = 1 << 18
_FLUSH_BYTES = 8 << 20
_LAST = np.iinfo(np.int64).max


def _digests(data: bytes, starts: np.ndarray, ends: np.ndarray, key: bytes, size: int = 8) -> np.ndarray:
    """Keyed digests of spans, as one or two 64-bit numbers each."""
    view, new = memoryview(data), hashlib.blake2b
    out = np.empty(len(starts) * size // 8, dtype=np.uint64)
    for at in range(0, len(starts), _BLOCK):  # a block at a time, so that little of it is Python objects
        some = slice(at, at + _BLOCK)
        found = b"".join([new(view[a:b], digest_size=size, key=key).digest() for a, b in zip(starts[some].tolist(), ends[some].tolist())])
        out[at * size // 8 : at * size // 8 + len(found) // 8] = np.frombuffer(found, dtype=np.uint64)
    return out


def find_anchors(buf: np.ndarray, offsets: np.ndarray, length: int = LENGTH, key: bytes = b""):
    """(gram hash, context digest, text, first string, anchor, last string) of the anchors of concatenated texts.

    Strings and anchors are offsets in the buffer.  Texts shorter than ``length`` have none.
    """
    width = length - GRAM + 1
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.flatnonzero(np.arange(len(buf)) + length <= offsets[1:][owner])
    if not len(starts):
        return None
    hasher = SpanHasher(buf)
    m = len(buf) - GRAM + 1
    at = np.arange(m)
    grams = hasher.spans(at, at + GRAM)
    mask = np.uint64(2 * _SEGMENT - 1)
    order = (grams & ~mask) | at.astype(np.uint64)
    rows = np.concatenate([order, np.full(-m % width, ~np.uint64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(behind[starts], ahead[starts + width - 1]) & mask).astype(np.int64)
    cut = np.flatnonzero(heads(anchor, starts - np.arange(len(starts))))
    first, last, anchor = starts[cut], starts[np.append(cut[1:], len(starts)) - 1], anchor[cut]
    shape = mix64(((anchor - first) * 4096 + (last - first)).astype(np.uint64))
    context = mix64(_digests(buf.tobytes(), first, last + length, key) + shape)
    return grams[anchor], context, owner[first], first, anchor, last


def _segments(texts: list[bytes], length: int):
    """(buffer, offsets, number of each text, start of each part in its text) of about a segment each.

    A long text is cut into parts that overlap by ``length - 1`` bytes: each string lies in exactly one part.
    """
    parts, size = [], 0

    def flush():
        data = [texts[i][a:b] for i, a, b in parts]
        offsets = np.zeros(len(parts) + 1, dtype=np.int64)
        np.cumsum([len(x) for x in data], out=offsets[1:])
        return np.frombuffer(b"".join(data), dtype=np.uint8), offsets, np.array([p[0] for p in parts]), np.array([p[1] for p in parts])

    for i, t in enumerate(texts):
        for a in range(0, max(len(t) - length + 1, 0), _SEGMENT // 2):
            b = min(len(t), a + _SEGMENT // 2 + length - 1)
            if parts and size + b - a > _SEGMENT:
                yield flush()
                parts, size = [], 0
            parts.append((i, a, b))
            size += b - a
    if parts:
        yield flush()


def _ranges(rows: list, ids, ordinals, starts, ends, parts: int) -> None:
    for part, arrays in by_target(part_of_ids(ids, parts), ids, ordinals, starts, ends):
        rows.append((part, "range", dump(*arrays)))


def _requests(rows: list, parts: int, **columns) -> None:
    """Contexts to cut out, by the part of their document."""
    names = ["id", "ordinal", "gram", "reference", "hot", "first", "anchor", "last"]
    for part, arrays in by_target(part_of_ids(columns["id"], parts), *[columns[n] for n in names]):
        rows.append((part, "cut", dump(*arrays)))


def _distinct_contexts(ids, ordinals, grams, contexts, first, anchor, last, length, parts, rows):
    """Sends the contexts of one flush: equal ones once, those of hot anchors straight on."""
    order = np.lexsort((anchor, ordinals, ids, contexts, grams))
    ids, ordinals, grams, contexts, first, anchor, last = (x[order] for x in (ids, ordinals, grams, contexts, first, anchor, last))
    new_gram = heads(grams)
    leads = heads(grams, contexts)
    _ranges(rows, ids[~leads], ordinals[~leads], first[~leads], last[~leads] + length, parts)
    ids, ordinals, grams, contexts, first, anchor, last = (x[leads] for x in (ids, ordinals, grams, contexts, first, anchor, last))
    group = np.cumsum(new_gram[leads]) - 1
    hot = np.bincount(group)[group] > HOT
    earliest = np.zeros(len(ids), dtype=bool)
    order = np.lexsort((anchor, ordinals, ids, group))
    earliest[order[heads(group[order])]] = True
    straight = hot & ~earliest
    n = int(straight.sum())
    if n:
        _requests(rows, parts, id=ids[straight], ordinal=ordinals[straight], gram=grams[straight], reference=np.zeros(n, dtype=bool),
                  hot=np.ones(n, dtype=bool), first=first[straight], anchor=anchor[straight], last=last[straight])
    keep = np.flatnonzero(~straight)
    keep = keep[np.argsort(grams[keep], kind="stable")]
    ids, ordinals, grams, contexts, first, anchor, last, hot = (x[keep] for x in (ids, ordinals, grams, contexts, first, anchor, last, hot))
    part = part_of(grams, parts)
    cut = np.searchsorted(part, np.arange(parts + 1))
    for p in np.unique(part):
        s = slice(cut[p], cut[p + 1])
        docs, index = np.unique(np.stack([ids[s], ordinals[s]], axis=1), axis=0, return_inverse=True)
        rows.append((int(p), "anchor", dump(
            docs, index.ravel().astype(np.uint32), sorted_planes(grams[s]), contexts[s], anchor[s].astype(np.uint32 if anchor[s].max() < 1 << 32 else np.int64),
            (anchor[s] - first[s]).astype(np.uint16), (anchor[s] - last[s]).astype(np.uint16), hot[s])))


def _texts(batches):
    """(ids, ordinals, texts) of a thousand rows at a time."""
    for batch in batches:
        for begin in range(0, len(batch), 1000):
            some = batch.slice(begin, 1000)
            yield (some.column(0).to_numpy(zero_copy_only=False), some.column(1).to_numpy(zero_copy_only=False),
                   [t or b"" for t in some.column(2).cast(pa.binary()).to_pylist()])


def _anchor_rows(length: int, parts: int, key: bytes):
    def run(batches):
        held: list[list[np.ndarray]] = []
        count = 0

        def flush():
            rows: list = []
            _distinct_contexts(*[np.concatenate(x) for x in zip(*held)], length, parts, rows)
            return record_batch(rows)

        for ids, ordinals, texts in _texts(batches):
            for buf, offsets, number, begin in _segments(texts, length):
                found = find_anchors(buf, offsets, length, key)
                if found is None:
                    continue
                grams, contexts, owner, first, anchor, last = found
                shift = begin[owner] - offsets[owner]
                held.append([ids[number[owner]], ordinals[number[owner]], grams, contexts, first + shift, anchor + shift, last + shift])
                count += len(grams)
                if count >= _FLUSH_ANCHORS:
                    yield flush()
                    held, count = [], 0
        if held:
            yield flush()

    return run


def _compare_contexts(length: int, parts: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(p, k, b) for p, k, b in zip(pdf["part"], pdf["kind"], pdf["blob"]) if k != "anchor"]
        blobs = [load(b) for k, b in zip(pdf["kind"], pdf["blob"]) if k == "anchor"]
        if not blobs:
            return frame(rows)
        docs = np.concatenate([b[0][b[1]] for b in blobs])
        ids, ordinals = docs[:, 0], docs[:, 1]
        grams = np.concatenate([from_sorted_planes(b[2]) for b in blobs])
        contexts = np.concatenate([b[3] for b in blobs])
        anchor = np.concatenate([b[4].astype(np.int64) for b in blobs])
        first = anchor - np.concatenate([b[5] for b in blobs])
        last = anchor - np.concatenate([b[6] for b in blobs])
        hot = np.concatenate([b[7] for b in blobs])
        order = np.lexsort((anchor, ordinals, ids, contexts, grams))
        ids, ordinals, grams, contexts, anchor, first, last, hot = (x[order] for x in (ids, ordinals, grams, contexts, anchor, first, last, hot))
        new_gram = heads(grams)
        leads = heads(grams, contexts)
        _ranges(rows, ids[~leads], ordinals[~leads], first[~leads], last[~leads] + length, parts)
        group = np.cumsum(new_gram) - 1
        hot_group = np.bincount(group, weights=hot) > 0
        several = (np.bincount(group, weights=leads) > 1) | hot_group
        s = np.flatnonzero(leads & several[group])
        if len(s):
            by_order = s[np.lexsort((anchor[s], ordinals[s], ids[s], group[s]))]
            reference = heads(group[by_order])
            _requests(rows, parts, id=ids[by_order], ordinal=ordinals[by_order], gram=grams[by_order], reference=reference,
                      hot=hot_group[group[by_order]], first=first[by_order], anchor=anchor[by_order], last=last[by_order])
        return frame(rows)

    return run


def _pack_texts(parts: int):
    """Blobs of texts by the part of their document."""

    def run(batches):
        held, size = defaultdict(list), 0

        def flush():
            rows = [(p, "text", dump(x)) for p, x in held.items()]
            return record_batch(rows)

        for ids, ordinals, texts in _texts(batches):
            for p, i, o, t in zip(part_of_ids(ids, parts).tolist(), ids.tolist(), ordinals.tolist(), texts):
                held[p].append((i, o, t))
                size += len(t)
                if size >= _FLUSH_BYTES:
                    yield flush()
                    held, size = defaultdict(list), 0
        if held:
            yield flush()

    return run


def _cut_contexts(length: int, shards: int):
    """The bytes of the requested contexts, by shard of their anchor."""

    def run(key: tuple, texts: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return frame([])
        blobs = [load(b) for b in asked["blob"]]
        ids, ordinals, grams, reference, hot, first, anchor, last = (np.concatenate(x) for x in zip(*blobs))
        of: dict[tuple[int, int], list[int]] = defaultdict(list)
        for row, k in enumerate(zip(ids.tolist(), ordinals.tolist())):
            of[k].append(row)
        held = defaultdict(list)
        spread = (mix64(ids.view(np.uint64)) % np.uint64(SPREAD))
        shard = part_of(mix64(grams), shards)
        shard_of_part = lambda gram, part: int(part_of(mix64(np.array([gram], dtype=np.uint64) + np.uint64(part + 1)), shards)[0])
        for blob in texts["blob"]:
            for i, o, t in load(blob)[0]:
                for r in of.get((i, o), ()):
                    content = t[first[r] : last[r] + length]
                    row = (int(grams[r]), i, o, int(first[r]), int(anchor[r]), bool(reference[r]), bool(hot[r]), content)
                    if not hot[r]:
                        held[int(shard[r])].append(row)
                    elif reference[r]:
                        for target in {shard_of_part(grams[r], p) for p in range(SPREAD)}:
                            held[target].append(row)
                    else:
                        held[shard_of_part(grams[r], int(spread[r]))].append(row)
        return frame([(p, "context", dump(x)) for p, x in held.items()])

    return run


def _search_shard(length: int, parts: int, key: bytes):
    """Ranges of strings that references hold, or, among the rest, earlier contexts; digests of hot ones left over."""

    def run(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        contexts = sorted({row for b in pdf["blob"] for row in load(b)[0]})
        references = [c for c in contexts if c[5]]
        others = [c for c in contexts if not c[5]]
        if not others:
            return frame([])
        found = []
        step = max(1, (1 << 20) // 160)
        index = RunLengthIndex([c[7] for c in references]) if references else None
        for begin in range(0, len(others), step):
            some = others[begin : begin + step]
            n = np.array([len(c[7]) - length + 1 for c in some])
            if index is None:
                hit = np.zeros((len(some), int(n.max())), dtype=bool)
            else:
                hit = index.matching_statistics([c[7] for c in some])[:, : int(n.max())] >= length
            inside = np.arange(hit.shape[1])[None, :] < n[:, None]
            found.append((some, hit & inside, inside))
        rows: list = []
        hit_at, left_at = [], []
        for some, hit, inside in found:
            ids = np.array([c[1] for c in some], dtype=np.int64)
            ordinals = np.array([c[2] for c in some], dtype=np.int64)
            start = np.array([c[3] for c in some], dtype=np.int64)
            r, i = np.nonzero(hit)
            hit_at.append((ids[r], ordinals[r], start[r] + i))
            r, i = np.nonzero(inside & ~hit)
            if len(r):
                at = np.cumsum([0] + [len(c[7]) for c in some])[r] + i
                digest = _digests(b"".join(c[7] for c in some), at, at + length, key, 16)
                hot = np.array([c[6] for c in some])
                left_at.append((digest[0::2], digest[1::2], ids[r], ordinals[r], start[r] + i, hot[r]))
        ids, ordinals, at = (np.concatenate(x) for x in zip(*hit_at))
        if left_at:
            high, low, i, o, a, hot = (np.concatenate(x) for x in zip(*left_at))
            if hot.any():
                rows.append((0, "digest", dump(*(x[hot] for x in (high, low, i, o, a)))))
                high, low, i, o, a = (x[~hot] for x in (high, low, i, o, a))
            order = np.lexsort((a, o, i, low, high))
            again = order[~heads(high[order], low[order])]
            ids, ordinals, at = np.concatenate([ids, i[again]]), np.concatenate([ordinals, o[again]]), np.concatenate([at, a[again]])
        order = np.lexsort((at, ordinals, ids))
        ids, ordinals, at = ids[order], ordinals[order], at[order]
        if len(ids):
            cut = np.flatnonzero(heads(ids, ordinals, np.cumsum(np.diff(at, prepend=at[0]) > 1)))
            end = at[np.append(cut[1:], len(ids)) - 1] + length
            _ranges(rows, ids[cut], ordinals[cut], at[cut], end, parts)
        return frame(rows)

    return run


def _explode_digests(batches):
    for pdf in batches:
        for blob in pdf["blob"]:
            high, low, i, o, a = load(blob)
            yield pd.DataFrame({"high": high.view(np.int64), "low": low.view(np.int64), "id": i, "ordinal": o, "at": a})


def _pack_ranges(length: int, parts: int):
    def run(batches):
        for pdf in batches:
            rows: list = []
            at = pdf["at"].to_numpy()
            _ranges(rows, pdf["id"].to_numpy(), pdf["ordinal"].to_numpy(), at, at + length, parts)
            yield frame(rows)

    return run


def union_of(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal ranges covered by the given ones (adjacent ones are joined)."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    cut = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]]))
    return starts[cut], reach[np.append(cut[1:], len(starts)) - 1]


_RESULT = "id long, ordinal int, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary"


def _apply_ranges(with_kept: bool):
    def run(key: tuple, texts: pd.DataFrame, ranges: pd.DataFrame) -> pd.DataFrame:
        blobs = [load(b) for b in ranges["blob"]]
        of = {}
        if blobs:
            ids, ordinals, starts, ends = (np.concatenate(x) for x in zip(*blobs))
            order = np.lexsort((ordinals, ids))
            ids, ordinals, starts, ends = ids[order], ordinals[order], starts[order], ends[order]
            cut = np.flatnonzero(heads(ids, ordinals))
            for a, b in zip(cut, np.append(cut[1:], len(ids))):
                of[int(ids[a]), int(ordinals[a])] = union_of(starts[a:b], ends[a:b])
        rows = []
        for blob in texts["blob"]:
            for i, o, t in load(blob)[0]:
                starts, ends = (x.tolist() for x in of.get((i, o), (np.zeros(0, int), np.zeros(0, int))))
                kept = b"".join(t[a:b] for a, b in zip([0, *ends], [*starts, len(t)]))
                rows.append((i, o, len(t), len(t) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(),
                             [{"start": a, "end": b} for a, b in zip(starts, ends)], kept if with_kept else None))
        return pd.DataFrame(rows, columns=["id", "ordinal", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    return run


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, ordinal, text): a null id comes last; rows that repeat an id are numbered by the hash of their text."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST).cast("long")).alias("id"), F.col(text_col).alias("text"))
    if rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() == 0:
        return rows.select("id", F.lit(0).cast("long").alias("ordinal"), "text")
    # number repeated rows within hashes of the text first, so that an id of very many rows isn't one group
    by_text = rows.withColumn("h", F.xxhash64("text"))
    sizes = by_text.groupBy("id", "h").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(
        Window.partitionBy("id").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("id", "h", "before")
    inside = F.row_number().over(Window.partitionBy("id", "h").orderBy("text")) - 1
    return by_text.withColumn("inside", inside).join(before, ["id", "h"]).select("id", (F.col("before") + F.col("inside")).alias("ordinal"), "text")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_kept: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept), one row per row of ``docs``.

    ``spans`` are the maximal removed byte ranges; ``kept`` are the other bytes, given ``with_kept`` (they may end
    within a character).  A null text has no bytes.  Ids are integers; a null id comes after all others, and rows that
    repeat an id come in the order of a hash of their text, so that of rows that repeat both all but one are removed.
    ``length`` is between 64 and 2,000.
    """
    if not 64 <= length <= 2000:
        raise ValueError("length between 64 and 2000")
    spark = docs.sparkSession
    rows = _numbered(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    key = os.urandom(32)
    found = materialise(rows.mapInArrow(_anchor_rows(length, parts, key), ROW).groupBy("part").applyInPandas(_compare_contexts(length, parts), ROW))
    texts = rows.mapInArrow(_pack_texts(parts), ROW)
    cut = (
        texts.groupBy("part").cogroup(found.where("kind = 'cut'").groupBy("part"))
        .applyInPandas(_cut_contexts(length, parts), ROW).groupBy("part").applyInPandas(_search_shard(length, parts, key), ROW)
    )
    searched = materialise(cut)
    left = searched.where("kind = 'digest'").mapInPandas(_explode_digests, "high long, low long, id long, ordinal long, at long")
    left = left.distinct()
    order = F.struct("id", "ordinal", "at")
    first = left.groupBy("high", "low").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select("high", "low", "first")
    later = left.join(first, ["high", "low"]).where(order != F.col("first")).select("id", "ordinal", "at").mapInPandas(_pack_ranges(length, parts), ROW)
    ranges = found.where("kind = 'range'").unionByName(searched.where("kind = 'range'")).unionByName(later)
    out = texts.groupBy("part").cogroup(ranges.groupBy("part")).applyInPandas(_apply_ranges(with_kept), _RESULT)
    own = F.when(F.col("id") < _LAST, F.col("id")).alias(id_col)
    return out.select(own, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")


@query("op9_remove_repeats")
def op9(spark, d):
    """Bytes that stay of every document."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
