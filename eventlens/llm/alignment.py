"""Alignment of two tokenizers' tokens on the bytes of each text, and how often two tokens end together corpus-wide.

Both tokenizers encode a space followed by the text.  A text is first cut before every space that follows a visible
character: a byte-level BPE with the usual word pattern and a piece BPE whose pieces hold the space mark only in front
both end a token there, whatever stands around, so a worker encodes and aligns each distinct segment once and keeps it
while room lasts.  Vocabularies without that property (``PieceCodec.cuts``) get whole texts as segments.

Within the segments the tokens are divided and conquered (``shared_cuts``): take the middle end of the first
tokenizer's tokens, find it among the ends of the second one by bisection, go to the nearest end that both share,
and go on with both halves; an interval in which nothing is shared is a group.  All intervals of a level are handled
together in arrays.

Counts of linked id pairs come from one row per chunk and distinct pair; they go back to the chunks by a join, so no
text is encoded twice and nothing of the corpus's size is sent to all tasks.  Only the two vocabulary files are.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.arrays import dump, load, narrow
from eventlens.llm.common import query, table
from eventlens.session import materialise

TOKENIZER_A = "/opt/tokenizers/byte_bpe_50k.json"
TOKENIZER_B = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text that are handled together; a longer text is a chunk of its own.
CHUNK_BYTES = 2 << 20
#: New segments that are encoded together, and tokens that a worker keeps of earlier ones before it starts afresh.
NEW_SEGMENTS = 1 << 14
KEPT_TOKENS = 1 << 21
#: Steps outwards from the middle in arrays before an interval is searched on its own.
STEPS = 8
_ID_BITS = 24
_ENCODERS: dict = {}
_STATS = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class ByteCodec:
    """Byte-level BPE from the JSON of a tokenizer; the strings of special tokens are plain text."""

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(data.decode())
        self.tokenizer.encode_special_tokens = True
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes_of = [b""] * (1 + max(vocabulary.values()))
        for piece, i in vocabulary.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in piece)
        pre = json.loads(data).get("pre_tokenizer") or {}
        self.cuts = pre.get("type") == "ByteLevel" and bool(pre.get("use_regex", True))
        self.sizes = np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))

    def encode(self, segments: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(segments, add_special_tokens=False)]


class PieceCodec:
    """Sentence pieces from a serialized model, which puts one space in front itself."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.bytes_of = []
        for i in range(self.model.vocab_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.bytes_of.append(bytes([int(piece[1:-1], 16)]))
            elif self.model.is_control(i) or self.model.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                self.bytes_of.append(piece.replace("▁", " ").encode())
        self.cuts = all(set(piece) == {"▁"} or "▁" not in piece[1:] for piece in map(self.model.id_to_piece, range(self.model.vocab_size())))
        self.sizes = np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))
        self.space = [self.model.piece_to_id("▁")]

    def encode(self, segments: list[str]) -> list[list[int]]:
        out = self.model.encode([s[1:] for s in segments], num_threads=1)
        # the model adds no space to an empty rest
        return [ids if len(s) > 1 else self.space for s, ids in zip(segments, out)]


def segment_starts(buf: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Offsets at which segments begin, of texts that each begin with a space at ``docs``.

    A space is a start if a visible character precedes it; after the last bytes of wide white space it isn't.
    """
    space = buf == 32
    p1 = np.concatenate([[0], buf[:-1]])
    space &= p1 > 32
    if len(buf) > 3 and (buf >= 128).any():
        p2, p3 = np.concatenate([[0, 0], buf[:-2]]), np.concatenate([[0, 0, 0], buf[:-3]])
        space &= ~((p2 == 0xC2) & ((p1 == 0x85) | (p1 == 0xA0)))
        space &= ~((p3 == 0xE1) & (p2 == 0x9A) | (p3 == 0xE2) & ((p2 == 0x80) | (p2 == 0x81)) | (p3 == 0xE3) & (p2 == 0x80))
    space[docs] = True
    return np.flatnonzero(space)


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, a_of: np.ndarray, b_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Last tokens (of a, of b) of every group, in order.

    ``a_of`` and ``b_of`` are the numbers of tokens before each interval and after the last one; both sides of an
    interval end at the same byte.
    """
    lo_a, hi_a, lo_b, hi_b = a_of[:-1], a_of[1:], b_of[:-1], b_of[1:]
    some = (hi_a > lo_a) & (hi_b > lo_b)
    lo_a, hi_a, lo_b, hi_b = (x[some].astype(np.int64) for x in (lo_a, hi_a, lo_b, hi_b))
    done_a, done_b = [], []

    def found(ia):
        """Token of b that ends where the a token does, or -1."""
        ib = np.searchsorted(ends_b, ends_a[ia])
        return np.where(ends_b[np.minimum(ib, len(ends_b) - 1)] == ends_a[ia], ib, -1)

    while len(lo_a):
        leaf = (hi_a - lo_a == 1) | (hi_b - lo_b == 1)
        done_a.append(hi_a[leaf] - 1)
        done_b.append(hi_b[leaf] - 1)
        lo_a, hi_a, lo_b, hi_b = lo_a[~leaf], hi_a[~leaf], lo_b[~leaf], hi_b[~leaf]
        middle, last = (lo_a + hi_a - 2) // 2, hi_a - 2
        cut_a, cut_b = np.full(len(lo_a), -1), np.full(len(lo_a), -1)
        waiting = np.arange(len(lo_a))
        for step in range(2 * STEPS):
            if not len(waiting):
                break
            at = middle[waiting] + ((step + 1) // 2 if step % 2 else -(step // 2))
            inside = (at >= lo_a[waiting]) & (at <= last[waiting])
            hit = np.full(len(waiting), -1)
            hit[inside] = found(at[inside])
            ok = hit >= 0
            cut_a[waiting[ok]], cut_b[waiting[ok]] = at[ok], hit[ok]
            # an interval whose ends have all been tried is a group
            spent = (middle[waiting] - step // 2 <= lo_a[waiting]) & (middle[waiting] + (step + 1) // 2 >= last[waiting])
            waiting = waiting[~ok & ~spent]
        for i in waiting:
            at = np.arange(lo_a[i], last[i] + 1)
            hit = found(at)
            if (hit >= 0).any():
                best = np.flatnonzero(hit >= 0)
                best = best[np.argmin(np.abs(at[best] - middle[i]))]
                cut_a[i], cut_b[i] = at[best], hit[best]
        none = cut_a < 0
        done_a.append(hi_a[none] - 1)
        done_b.append(hi_b[none] - 1)
        lo_a, hi_a, lo_b, hi_b, cut_a, cut_b = (x[~none] for x in (lo_a, hi_a, lo_b, hi_b, cut_a, cut_b))
        lo_a, hi_a = np.concatenate([lo_a, cut_a + 1]), np.concatenate([cut_a + 1, hi_a])
        lo_b, hi_b = np.concatenate([lo_b, cut_b + 1]), np.concatenate([cut_b + 1, hi_b])
    if not done_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.sort(np.concatenate(done_a)), np.sort(np.concatenate(done_b))


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter(chain.from_iterable(ids), np.int64, int(counts.sum()))
    return flat, np.concatenate([[0], np.cumsum(counts)])


def _joins(segments: list[str], ids: list[list[int]], codec) -> np.ndarray:
    """Whether the bytes of the tokens are those of the segment."""
    of = codec.bytes_of.__getitem__
    return np.fromiter((b"".join(map(of, i)) == s.encode() for s, i in zip(segments, ids)), bool, len(segments))


class Segments:
    """Segments with their tokens, groups, links and the text of their groups."""

    def __init__(self, segments: list[str], a, b):
        ids_a, ids_b = a.encode(segments), b.encode(segments)
        self.good = _joins(segments, ids_a, a) & _joins(segments, ids_b, b)
        ids_a = [i if ok else [] for i, ok in zip(ids_a, self.good)]
        ids_b = [i if ok else [] for i, ok in zip(ids_b, self.good)]
        (self.a, a_of), (self.b, b_of) = _flat(ids_a), _flat(ids_b)
        ends_a, ends_b = np.cumsum(a.sizes[self.a]), np.cumsum(b.sizes[self.b])
        self.last_a, self.last_b = shared_cuts(ends_a, ends_b, a_of, b_of)
        self.n_a, self.n_b = np.diff(a_of), np.diff(b_of)
        self.n_groups = np.diff(np.searchsorted(self.last_a, a_of))
        self.pairs = (self.b[self.last_b] << _ID_BITS) | self.a[self.last_a]

    def texts(self) -> list[bytes]:
        """For each segment a1,a2|b1;a3|b2,b3."""
        n = len(self.a) + len(self.b)
        if not n:
            return [b""] * len(self.n_a)
        group_a = np.searchsorted(self.last_a, np.arange(len(self.a)))
        group_b = np.searchsorted(self.last_b, np.arange(len(self.b)))
        # a token stands after the tokens of its side and those of the other side's earlier groups (b: up to its own)
        first_b = np.concatenate([[0], self.last_b + 1])
        at_a = np.arange(len(self.a)) + first_b[group_a]
        at_b = np.arange(len(self.b)) + self.last_a[group_b] + 1
        ids, ends = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
        ids[at_a], ids[at_b] = self.a, self.b
        ends[at_a[self.last_a]], ends[at_b[self.last_b]] = ord("|"), ord(";")
        digits = len(str(max(int(ids.max()), 1)))
        figures = ids[:, None] // 10 ** np.arange(digits - 1, -1, -1)
        shown = np.concatenate([figures > 0, np.ones((n, 1), bool)], axis=1)
        shown[:, digits - 1] = True
        chars = np.concatenate([(figures % 10 + 48).astype(np.uint8), ends[:, None]], axis=1)
        text = chars[shown].tobytes()
        # a segment's text ends before its last ';'
        lengths = np.concatenate([[0], np.cumsum(shown.sum(axis=1))])
        cut = lengths[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])]
        return [text[x:max(x, y - 1)] for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())]


class Encoder:
    """Two codecs and the segments that they have met, each under a number."""

    def __init__(self, a, b):
        self.a, self.b = a, b
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.texts: list[bytes] = []
        self.counts = np.zeros((4, 0), np.int64)  # tokens of a, of b, groups, and whether the bytes differ
        self.pairs = np.zeros(0, np.int64)
        self.first = np.zeros(1, np.int64)  # pairs before each segment, and all

    def numbers(self, segments: list[str]) -> np.ndarray:
        """The numbers of distinct segments; they hold until the next call."""
        if len(self.pairs) > KEPT_TOKENS or len(self.number) > KEPT_TOKENS >> 2:
            self._forget()
        new = [s for s in segments if s not in self.number]
        counts, pairs = [self.counts], [self.pairs]
        for begin in range(0, len(new), NEW_SEGMENTS):
            part = Segments(new[begin:begin + NEW_SEGMENTS], self.a, self.b)
            self.texts += part.texts()
            counts.append(np.stack([part.n_a, part.n_b, part.n_groups, ~part.good]))
            pairs.append(part.pairs)
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
        self.counts, self.pairs = np.concatenate(counts, axis=1), np.concatenate(pairs)
        self.first = np.concatenate([[0], np.cumsum(self.counts[2])])
        return np.fromiter(map(self.number.__getitem__, segments), np.int64, len(segments))


def chunks(batches, limit: int = CHUNK_BYTES):
    """Runs of rows (record batches) with about ``limit`` bytes of text each; null texts are empty."""
    for batch in batches:
        text = batch.column("text").fill_null("").cast(pa.large_string())
        batch = batch.set_column(batch.schema.get_field_index("text"), "text", text)
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
        begin = 0
        while begin < len(text):
            end = int(np.searchsorted(offsets, offsets[begin] + limit, side="right"))
            end = min(max(end - 1, begin + 1), len(text))
            yield batch.slice(begin, end - begin)
            begin = end


def _buffer(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes with a space in front of each, and where each begins (and all end)."""
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    return np.insert(data, offsets[:-1], 32), offsets + np.arange(len(offsets))


def _encode_chunk(chunk: pa.RecordBatch, encoder: Encoder, with_groups: bool):
    """What a chunk keeps: its rows' fixed results, and how often each row holds each pair; and the chunk's sums of pairs."""
    buf, docs = _buffer(chunk.column("text"))
    starts = segment_starts(buf, docs[:-1]) if encoder.a.cuts and encoder.b.cuts else docs[:-1]
    bounds = np.append(starts, len(buf))
    strings = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(buf)).dictionary_encode()
    codes = encoder.numbers(strings.dictionary.to_pylist())[strings.indices.to_numpy(zero_copy_only=False)]
    first = np.searchsorted(starts, docs)  # segments before each row, and all
    per_row = np.diff(np.concatenate([np.zeros((4, 1), np.int64), np.cumsum(encoder.counts[:, codes], axis=1)], axis=1)[:, first])
    none = (np.diff(docs) == 1) | (per_row[3] > 0)
    per_row[:, none] = 0
    groups = []
    for skip, x, y in zip(none.tolist(), first[:-1].tolist(), first[1:].tolist()):
        groups.append(b"" if skip else b";".join([encoder.texts[c] for c in codes[x:y].tolist()]))
    sha = [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
    # the pairs of each row, counted by sorting (row, pair)
    row = np.repeat(np.arange(len(none)), np.diff(first))
    codes, row = codes[~none[row]], row[~none[row]]
    n = encoder.counts[2, codes]
    at = np.repeat(encoder.first[codes] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
    pairs, which = np.unique(encoder.pairs[at], return_inverse=True)
    keys, times = np.unique(np.repeat(row, n) * len(pairs) + which, return_counts=True)
    which = keys % max(len(pairs), 1)
    links = np.searchsorted(keys, np.arange(len(none) + 1) * len(pairs))
    total = np.zeros(len(pairs), np.int64)
    np.add.at(total, which, times)
    blob = dump(chunk.column("id").to_pylist(), [narrow(c) for c in per_row[:3]], sha, pairs, narrow(links), narrow(which), narrow(times),
                [g.decode() for g in groups] if with_groups else None)
    return blob, pairs, total


def _encoder(files, with_groups: bool):
    def encode(batches):
        key = tuple(hashlib.sha256(f).digest() for f in files.value)
        if key not in _ENCODERS:  # a worker serves many tasks; its encoder stays
            _ENCODERS.clear()
            _ENCODERS[key] = Encoder(ByteCodec(files.value[0]), PieceCodec(files.value[1]))
        for chunk in chunks(batches):
            blob, pairs, total = _encode_chunk(chunk, _ENCODERS[key], with_groups)
            yield pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().hex]), pa.array([blob], pa.binary()), pa.array([pairs], pa.list_(pa.int64())), pa.array([total], pa.list_(pa.int64()))],
                ["chunk", "blob", "pairs", "seen"])

    return encode


def _finisher(with_groups: bool):
    columns = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] + ["groups"] * with_groups

    def finish(_, stored: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        ids, counts, sha, pairs, links, which, times, groups = load(stored["blob"].iloc[0])
        n_a, n_b, n_groups = (c.astype(np.int64) for c in counts)
        total, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        at = np.searchsorted(pairs, answers["pair"].to_numpy(np.int64))
        total[at], best[at] = answers["total"].to_numpy(np.int64), answers["best"].to_numpy(np.int64)
        links, times = links.astype(np.int64), times.astype(np.int64)

        def per_row(value):
            return np.diff(np.concatenate([[0], np.cumsum(value[which] * times)])[links])

        out = {"id": pd.array(ids, dtype="Int64"), "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_groups,
               "n_best": per_row(best), "count_sum": per_row(total), "groups_sha256": sha, "groups": groups}
        return pd.DataFrame({c: out[c] for c in columns})

    return finish


def align_tokenizers(docs: DataFrame, tokenizer_a: str = TOKENIZER_A, tokenizer_b: str = TOKENIZER_B, id_col: str = "doc_id",
                     text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """Per row: ids, token, group and link counts, links that are their b id's most frequent, and the sum of link counts.

    ``with_groups`` adds the groups themselves as text (``a1,a2|b1;a3|b2,b3``); its SHA-256 is always returned.  Each
    group ends with one link, since no token is empty.  A null or empty text, and one that a tokenizer doesn't give
    back byte by byte, has zeros and empty strings.  Repeated rows give repeated results and count each; a null id
    stays null.  Other columns don't matter and are left out.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    files = spark.sparkContext.broadcast(tuple(_file(spark, p) for p in (tokenizer_a, tokenizer_b)))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    stored = materialise(rows.mapInArrow(_encoder(files, with_groups), "chunk string, blob binary, pairs array<long>, seen array<long>"))
    pairs = stored.select("chunk", F.explode(F.arrays_zip("pairs", "seen")).alias("x")).select("chunk", F.col("x.pairs").alias("pair"), F.col("x.seen").alias("n"))
    totals = materialise(pairs.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("b", F.shiftright("pair", _ID_BITS)))
    highest = totals.groupBy("b").agg(F.max("total").alias("highest"))
    marked = totals.join(highest, "b").select("pair", "total", (F.col("total") == F.col("highest")).cast("long").alias("best"))
    answers = pairs.select(F.col("chunk").alias("of_chunk"), "pair").join(marked, "pair")
    result = stored.select("chunk", "blob").groupBy("chunk").cogroup(answers.groupBy("of_chunk")).applyInPandas(
        _finisher(with_groups), f"id long, {_STATS}" + (", groups string" if with_groups else ""))
    return result.withColumnRenamed("id", id_col)


def _file(spark, path: str) -> bytes:
    """A vocabulary file's bytes; one that has a scheme is read by Spark, so that it can lie where only Spark reaches."""
    if ":" in path:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    with open(path, "rb") as f:
        return f.read()


@query("op11_align_tokenizers")
def op11(spark, d):
    """Byte BPE against piece BPE over all documents."""
    return align_tokenizers(table(spark, d, "documents"))
