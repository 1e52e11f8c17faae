"""SimHash near-duplicates through an inverted index on byte positions with count filtering.

A 64-bit fingerprint has eight bytes.  Two fingerprints that differ in at most ``d`` bits share at least
``8 - d`` bytes at equal positions, so the smallest number of matches is guaranteed.  Posting lists for a single
(position, byte) would hold 1/256 of the corpus each; lists are therefore keyed by sets of positions and their
bytes.  The sets are chosen so that any ``8 - d`` matching positions contain one of them, hence no pair is lost.
Each pair that meets in a list is compared there: its shared positional bytes are tallied, pairs under the
guaranteed number are dropped, the others are verified bit by bit.

Equal fingerprints are collapsed first.  A list longer than ``dense`` is keyed again by longer sets (five bytes
instead of three); one that is still long is cut into cells of two blocks, so that no task holds a whole list.
Each task gives a spanning star of the links it has found, never all pairs, and connected components of the stars
are found by alternating star contractions on written tables.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.llm.common import encode, query, table
from eventlens.session import materialise

SHINGLE_WORDS = 3
MAX_BITS = 3
DENSE = 512
BLOCK = 2048
_CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """Unsigned fingerprint of a text; zero for a text without words."""
    words = encode(text).translate(_ASCII_LOWER).split()
    if not words:
        return 0
    width = min(shingle, len(words))
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(length + 1) - 1
    starts = (ends - length)[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(starts), _CHUNK):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[i : i + _CHUNK], ends[i : i + _CHUNK])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


_ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint_column(text: Column, shingle: int = SHINGLE_WORDS) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf(T.LongType())
    def digests(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return digests(text)


def covering_sets(positions: tuple[int, ...], matches: int, size: int) -> list[tuple[int, ...]]:
    """Sets of ``size`` positions of which any ``matches`` positions contain one.

    The positions are cut into the largest number of groups that still forces ``size`` of the matches into one
    group; all sets within a group are taken.
    """
    groups = max(1, (matches - 1) // (size - 1)) if size > 1 else 1
    if size > 1:
        parts = [positions[i::groups] for i in range(groups)]
        return [s for p in parts for s in combinations(p, size)]
    return [(p,) for p in positions[: len(positions) - matches + 1]]


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255))


def _keys(fp: Column, sets: list[tuple[int, ...]]) -> Column:
    """One key per set: its number above the bytes at its positions."""
    keys = []
    for number, positions in enumerate(sets):
        key = F.lit(number).cast("long")
        for p in positions:
            key = key * 256 + _byte(fp, p)
        keys.append(key)
    return F.array(*keys)


def _star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its component) for the components of the links a-b."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def cell_links(cell: np.ndarray, side: np.ndarray, cross: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows of the same cell (rows are sorted by cell).

    ``cross`` marks cells of two different blocks, where only pairs across the blocks are compared.
    """
    found_a, found_b, held = [], [], 0
    last = np.searchsorted(cell, cell, side="right") - 1
    index = np.arange(len(cell))
    for step in range(1, len(cell)):
        index = index[index + step <= last[index]]
        if not len(index):
            break
        a, b = index, index + step
        use = ~cross[a] | (side[a] != side[b])
        a, b = fp[a[use]], fp[b[use]]
        x = a ^ b
        shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        near = shared >= 8 - bits
        a, b, x = a[near], b[near], x[near]
        near = np.bitwise_count(x) <= bits
        if near.any():
            found_a.append(a[near])
            found_b.append(b[near])
            held += int(near.sum())
            if held > 1 << 19:
                a, b = _star(np.concatenate(found_a), np.concatenate(found_b))
                found_a, found_b, held = [a], [b], len(a)
    if not found_a:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    return _star(np.concatenate(found_a), np.concatenate(found_b))


def _links_of_lists(lists: DataFrame, bits: int) -> DataFrame:
    """Stars of the verified links within each list (key, fp, size)."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    side = F.pmod(F.xxhash64("fp", F.lit(7)), blocks.cast("long")).cast("int")
    # every row goes to the cells of its block with each block, so a cell of two blocks has the rows of both
    cells = (
        lists.withColumn("side", side)
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(F.xxhash64("key", F.least("side", "other"), F.greatest("side", "other")).alias("cell"), "fp", "side",
                (F.col("side") != F.col("other")).alias("cross"))
    )
    n = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def scan(batches):
        held: pd.DataFrame | None = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            cell = pdf["cell"].to_numpy()
            cut = int(np.searchsorted(cell, cell[-1], side="left"))
            held = pdf.iloc[cut:]
            if cut:
                yield links(pdf.iloc[:cut])
        if held is not None and len(held):
            yield links(held)

    def links(pdf):
        a, b = cell_links(pdf["cell"].to_numpy(), pdf["side"].to_numpy(), pdf["cross"].to_numpy(),
                          pdf["fp"].to_numpy().view(np.uint64), bits)
        return pd.DataFrame({"u": a.view(np.int64), "v": b.view(np.int64)})

    return cells.repartition(n, "cell").sortWithinPartitions("cell").mapInPandas(scan, "u long, v long")


def _lists(fps: DataFrame, sets: list[tuple[int, ...]]) -> DataFrame:
    """Posting lists with two entries or more: (key, fp, size)."""
    index = fps.select("fp", F.explode(_keys(F.col("fp"), sets)).alias("key"))
    sizes = index.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    return index.join(sizes, "key")


def near_links(fps: DataFrame, bits: int = MAX_BITS, dense: int = DENSE) -> DataFrame:
    """Links (u, v) that connect exactly the distinct fingerprints at ``bits`` differing bits or fewer.

    The links are stars of what each task has found: they connect the same components as all pairs would.
    """
    if not 0 <= bits <= 6:
        raise ValueError("between 0 and 6 differing bits")
    everything, matches = tuple(range(8)), 8 - bits
    short = covering_sets(everything, matches, min(3, matches))
    lists = materialise(_lists(fps, short))
    links = _links_of_lists(lists.where(F.col("size") <= dense), bits)
    crowded = lists.where(F.col("size") > dense).select("fp").distinct()
    if matches >= 4:
        # a pair of a long list meets again under one of the longer sets, or has been found in a short list
        # (of at most six bytes, which with their number fit a key)
        again = _lists(crowded, list(combinations(everything, min(matches, 6))))
        links = links.unionByName(_links_of_lists(again, bits))
    else:
        links = links.unionByName(_links_of_lists(lists.where(F.col("size") > dense), bits))
    return links


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links; the root is the smallest node of its component.

    Alternating large-star and small-star contraction; each round is a written table, and the loop ends when
    a round changes nothing.
    """

    def both(edges):
        return edges.select(F.col("u"), F.col("v")).unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def large(edges):
        near = both(edges)
        low = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        return near.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v")

    def small(edges):
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("low"))
        moved = down.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        return moved.unionByName(low.select("u", F.col("low").alias("v")))

    def digest(edges):
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(row)

    edges = materialise(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    mark = digest(edges)
    while mark[0]:
        edges = materialise(small(large(edges).distinct()).distinct())
        before, mark = mark, digest(edges)
        if before == mark:
            break
    roots = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS,
                    bits: int = MAX_BITS) -> DataFrame:
    """(id, text_hash, fingerprint long, component_id, representative boolean), one row per row of ``docs``.

    ``component_id`` is the smallest id in the component of fingerprints linked at ``bits`` bits or fewer; ids that
    are null come last, so it is null only where all are.  ``representative`` marks the row with that id (by the
    text's hash among rows that repeat an id; rows that repeat both are all marked).  A null or empty text has
    fingerprint zero.  Other columns of ``docs`` are ignored.
    """
    rows = materialise(docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"),
                                   fingerprint_column(F.col(text_col), shingle).alias("fp")))
    # false sorts before true: the smallest known id wins
    first = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "text_hash")).alias("first")
    distinct = materialise(rows.groupBy("fp").agg(first))
    roots = components(near_links(distinct.select("fp"), bits)).withColumnRenamed("node", "fp")
    member = distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    member = materialise(member)
    best = member.groupBy("root").agg(F.min("first").alias("first"))
    of = member.select("fp", "root").join(best, "root").select("fp", "first")
    return rows.join(of, "fp").select(
        F.col("id").alias(id_col), "text_hash", F.col("fp").alias("fingerprint"), F.col("first.id").alias("component_id"),
        (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("text_hash") == F.col("first.text_hash"))).alias("representative"))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS,
                         bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs``, all columns, of which one per near-duplicate component stays.

    Rows meet by plain keys, so that the join and the choice among rows that repeat both id and text need one exchange.
    """
    names = ["_id_key", "_unknown", "_text_hash"]
    while {n.lower() for n in names} & {c.lower() for c in docs.columns}:
        names = [f"_{n}" for n in names]
    keys = lambda of, text_hash: of.withColumns(dict(zip(names, (
        F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(id_col).isNull(), text_hash))))
    kept = keys(near_duplicates(docs, id_col, text_col, shingle, bits).where("representative"), F.col("text_hash")).select(*names).distinct()
    return keys(docs, F.xxhash64(text_col)).join(kept, names, "left_semi").dropDuplicates(names).drop(*names)


@query("op8_simhash_near_dedup")
def op8(spark, d):
    """Fingerprint and component of every document."""
    return near_duplicates(table(spark, d, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
