"""Sharding by histogram sort, in DataFrame operations only.

Rows are ordered by a key (digest of the text, then digest of the id), and shards are ranges of it.  The boundaries
come from exact counts: each round counts the bytes between candidate keys in all partitions, narrows every boundary
that isn't settled to the candidates around its target, and puts new candidates between them.  A boundary is settled
when the bytes below it are within the tolerance of the target.  Then all rows are exchanged once.

Equal texts are neighbours in the order.  A boundary that falls into a group of equal texts goes to the nearer edge
of the group if that is within ``group_slack``; a larger group is cut, by the digest of the id, so that a hot text
fills as many shards as its bytes need.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.llm.common import query, table, text_or_empty
from eventlens.session import materialise

SHARDS = 8
TOLERANCE = 0.002
GROUP_SLACK = 0.01
PROBES = 256
RANGE_BYTES = 64 << 20
_KEY_BITS = 63
_TOP = 1 << _KEY_BITS


@dataclass
class _Open:
    """A boundary that isn't settled: it lies in [low, high) of the text key, or within one text key of the id key."""

    number: int
    target: float
    low: int
    high: int
    below: int
    text_key: int | None = None


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    text = text_or_empty(text_col)
    return [
        F.shiftrightunsigned(F.xxhash64(text), 1).alias("text_key"),
        F.shiftrightunsigned(F.xxhash64(id_col, F.lit(11)), 1).alias("id_key"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
    ]


def _histogram(keys: DataFrame, brackets: list[tuple[int | None, int, int]]):
    """For each bracket (text key or None, low, high) its bins: [(first key, last key, start, bytes)], by start.

    A bracket has at most PROBES + 1 bins, so what reaches the driver is bounded by brackets times probes.
    """
    bin_of, bracket_of = None, None
    for number, (text_key, low, high) in enumerate(brackets):
        key = F.col("text_key") if text_key is None else F.col("id_key")
        inside = (key >= low) & (key <= high - 1)
        if text_key is not None:
            inside &= F.col("text_key") == text_key
        step = max(1, (high - low) // PROBES)
        at = F.expr(f"({'text_key' if text_key is None else 'id_key'} - {low}) div {step}")
        bin_of = F.when(inside, at) if bin_of is None else bin_of.when(inside, at)
        bracket_of = F.when(inside, F.lit(number)) if bracket_of is None else bracket_of.when(inside, F.lit(number))
    key = F.when(F.element_at(F.array(*[F.lit(b[0] is None) for b in brackets]), F.col("bracket") + 1), F.col("text_key")).otherwise(F.col("id_key"))
    rows = (
        keys.withColumn("bracket", bracket_of).where("bracket IS NOT NULL").withColumn("bin", bin_of)
        .groupBy("bracket", "bin").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.sum("size").alias("bytes"))
        .collect()
    )
    out: list[list] = [[] for _ in brackets]
    for r in sorted(rows, key=lambda r: (r["bracket"], r["bin"])):
        out[r["bracket"]].append((r["first"], r["last"], r["bytes"]))
    return out


def find_boundaries(keys: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, group_slack: float = GROUP_SLACK) -> list[tuple[int, int]]:
    """The lower keys (text key, id key) of shards 1 .. shards - 1, of a frame (text_key, id_key, size)."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    ideal = total / shards
    waiting = [_Open(j, j * ideal, 0, _TOP, 0) for j in range(1, shards)] if total else []
    settled: dict[int, tuple[int, int]] = {}
    while waiting:
        brackets = list(dict.fromkeys((w.text_key, w.low, w.high) for w in waiting))
        bins = dict(zip(brackets, _histogram(keys, brackets)))
        narrower = []
        for w in waiting:
            below, found = w.below, None
            for first, last, size in bins[w.text_key, w.low, w.high]:
                if below + size >= w.target:
                    found = first, last, size
                    break
                below += size
            if found is None:  # only by rounding of the target
                settled[w.number] = (w.high, 0) if w.text_key is None else (w.text_key, w.high)
                continue
            first, last, size = found
            down, up = w.target - below, below + size - w.target
            single = first == last
            slack = group_slack if single and w.text_key is None else tolerance
            if min(down, up) <= slack * ideal or (single and w.text_key is not None):
                edge = first if down <= up else last + 1
                settled[w.number] = (edge, 0) if w.text_key is None else (w.text_key, edge)
            elif single:
                narrower.append(_Open(w.number, w.target, 0, _TOP, below, first))
            else:
                narrower.append(_Open(w.number, w.target, first, last + 1, below, w.text_key))
        waiting = narrower
    return sorted(settled.values())


def _shard_of(boundaries: list[tuple[int, int]]) -> Column:
    shard = F.lit(0)
    for text_key, id_key in boundaries:
        if text_key >= _TOP:
            continue
        at_or_after = F.col("text_key") > text_key
        if id_key < _TOP:
            at_or_after |= (F.col("text_key") == text_key) & (F.col("id_key") >= id_key)
        shard = shard + at_or_after.cast("int")
    return shard


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
                    tolerance: float = TOLERANCE, group_slack: float = GROUP_SLACK) -> DataFrame:
    """``docs`` with size (UTF-8 bytes plus 1), shard and slot (gapless from 0 within the shard, in a hashed order).

    Sizes of shards are as near to equal as the tolerance and the rows allow.  A null text has no bytes.  Rows that
    repeat both id and text can't be told apart and stay in one shard.  An empty table gives an empty result; columns
    of ``docs`` named size, shard or slot are replaced.
    """
    kept = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    # columns of docs travel under names of their own, so that they neither clash nor, if unused, are exchanged
    own = {c: f"_column_{i}" for i, c in enumerate(kept)}
    keyed = _keyed(docs, id_col, text_col)
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()], *keyed)
    keys = materialise(docs.select(*keyed))
    boundaries = find_boundaries(keys, shards, tolerance, group_slack)
    # slots follow the id key; ranges of it keep each task's part of a shard small
    total = keys.agg(F.sum("size")).first()[0] or 0
    ranges = max(32, -(-total // (shards * RANGE_BYTES)))
    placed = [_shard_of(boundaries).alias("shard"), F.expr(f"id_key div {_TOP // ranges}").alias("range")]
    earlier = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        keys.select(*placed).groupBy("shard", "range").agg(F.count("*").alias("rows"))
        .select("shard", "range", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    )
    inside = Window.partitionBy("shard", "range").orderBy("id_key", "text_key", "size")
    numbered = rows.select("*", *placed).withColumn("number", F.row_number().over(inside) - 1)
    return numbered.join(before, ["shard", "range"]).select(
        *[F.col(n).alias(c) for c, n in own.items()], "size", "shard", (F.col("before") + F.col("number")).alias("slot"))


@query("op7_shard")
def op7(spark, d):
    """Shard and slot of every document, by equal bytes."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.crc32(text_or_empty()).alias("text_crc32"))
    return shard_documents(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
