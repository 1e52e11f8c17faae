"""Collocations: phrases whose words occur together more often than their parts would by chance.

Phrases of two to five words that occur ``least`` times are found without counting all phrases:

1. Words are counted exactly; only phrases of frequent words go on.
2. Every chunk of text sums its phrases by 64-bit hash and deals them to hash partitions.  A partition's chunks are
   merged into one Misra-Gries summary (``merge``) whose capacity exceeds ``SLACK`` times the partition's mass divided
   by ``least``.  So a counter loses less than ``least / SLACK``: no frequent phrase can be missing from the summary, and
   few others look as if they could be frequent.  Pairs go first; longer phrases must consist of surviving pairs.
3. A second pass counts the survivors exactly, by their words and not by their hash, in the same hash partitions.

The filters that the passes share are bitmaps of a fixed size.  They let some more phrases through, never fewer, so
they change the work and not the result.  Scores, cuts and containment are joins of phrase counts.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlens.llm.alignment import chunks
from eventlens.llm.arrays import by_target, dump, from_sorted_planes, load, narrow, part_of, sorted_planes
from eventlens.llm.common import MULTIPLIER, mix64, query, table
from eventlens.session import materialise

LEAST = 100
LONGEST = 5
TOP = 2000
#: Counters of a summary beyond what its guarantee needs, as a factor.
SLACK = 16
#: Bytes of text that are handled together.
CHUNK_BYTES = 4 << 20
#: Positions in the bitmaps that passes share, as powers of two: one for 32 bytes of text within these bounds, so 16 MB at most.
FILTER_BITS = 20, 27
#: Bytes of text whose phrases one hash partition summarises.
PART_BYTES = 64 << 20

_WORD, _GAP, _BREAK = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = _GAP
_KIND[[10, 11, 12, 13, *b".,;:!?"]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    """The words of a chunk: which (language, word) each is, and the piece it stands in."""

    langs: list[str]
    lang: np.ndarray  # of each distinct word
    word: list[str]
    of: np.ndarray  # distinct word of each occurrence
    piece: np.ndarray

    def hashes(self) -> np.ndarray:
        """xxhash64(lang, word) as Spark has it."""
        seeds = [xxhash.xxh64_intdigest(x.encode(), 42) for x in self.langs]
        return np.fromiter((xxhash.xxh64_intdigest(w.encode(), seeds[x]) for w, x in zip(self.word, self.lang.tolist())), np.uint64, len(self.word))

    def follows(self) -> np.ndarray:
        """Whether the next word stands in the same piece."""
        out = np.zeros(len(self.of), bool)
        out[:-1] = self.piece[1:] == self.piece[:-1]
        return out


def words_of(chunk: pa.RecordBatch) -> Words:
    text, lang = chunk.column("text"), chunk.column("lang").dictionary_encode()
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    # a line feed in front of each text keeps texts apart, one after the last ends its word
    docs = offsets - offsets[0] + np.arange(len(offsets))
    buf = np.append(np.insert(_LOWER[data], offsets[:-1] - offsets[0], 10), np.uint8(10))
    kind = _KIND[buf]
    inside = kind == _WORD
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    bounds = np.concatenate([[0], np.cumsum(ends - starts)])
    spelled = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(buf[inside].tobytes())).dictionary_encode()
    spelling = spelled.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.searchsorted(docs, starts, side="right") - 1
    lang_of = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]
    n = len(spelled.dictionary)
    distinct, of = np.unique(lang_of * n + spelling, return_inverse=True)
    spellings = spelled.dictionary.to_pylist()
    return Words(lang.dictionary.to_pylist(), distinct // max(n, 1), [spellings[i] for i in (distinct % max(n, 1)).tolist()], of, np.cumsum(kind == _BREAK)[starts])


class Filter:
    """A bitmap over the leading bits of hashes: a table of 64-bit words, sent to tasks as an array."""

    @staticmethod
    def collect(hashes: DataFrame, bits: int) -> bytes:
        """The bitmap of a column ``hash``: 2^bits positions, so that a bounded number of rows reach the driver."""
        at = F.shiftrightunsigned("hash", 64 - bits)
        rows = (
            hashes.select(at.alias("p")).selectExpr("CAST(p div 64 AS INT) AS at", "shiftleft(1L, CAST(p % 64 AS INT)) AS bit")
            .groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
        )
        out = np.zeros(1 << (bits - 6), np.int64)
        out[rows["at"].to_numpy()] = rows["bits"].to_numpy()
        return out.tobytes()

    def __init__(self, data: bytes):
        self.words = np.frombuffer(data, np.uint64)
        self.shift = np.uint64(64 - (len(data) * 8).bit_length() + 1)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return ((self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


def merge(summaries: list[tuple], capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Misra-Gries summary of several: (sorted keys, counters, what every counter may have lost).

    If more keys than the capacity are left, the largest counter beyond it is taken from all.
    """
    keys, at = np.unique(np.concatenate([s[0] for s in summaries]), return_inverse=True)
    counters = np.bincount(at, np.concatenate([s[1] for s in summaries]), len(keys)).astype(np.int64)
    lost = sum(s[2] for s in summaries)
    if len(keys) > capacity:
        taken = int(np.partition(counters, len(counters) - capacity - 1)[len(counters) - capacity - 1])
        counters -= taken
        kept = counters > 0
        keys, counters, lost = keys[kept], counters[kept], lost + taken
    return keys, counters, lost


def _phrases(words: Words, usable: np.ndarray, longest: int):
    """(length, positions of first words, hashes) for phrases of usable words, lengths 2 and up.

    The caller may send back which of them to build longer ones from.
    """
    hashes, follows = words.hashes(), words.follows()
    of, n = words.of, len(words.of)
    at = np.flatnonzero(usable[of] & follows) if n else np.zeros(0, np.int64)
    at = at[usable[of[at + 1]]]
    value = hashes[of[at]]
    for length in range(2, longest + 1):
        value = mix64(value * MULTIPLIER + hashes[of[at + length - 1]] + np.uint64(length))
        good = yield length, at, value
        if good is None:
            good = np.ones(len(at), bool)
        # a longer phrase begins with a good one, and a good one begins a word later
        held = np.zeros(n + 1, bool)
        held[at[good]] = True
        more = good & held[at + 1]
        at, value = at[more], value[more]


def _word_counts(batches):
    for chunk in chunks(batches, CHUNK_BYTES):
        words = words_of(chunk)
        n = np.bincount(words.of, minlength=len(words.word))
        langs = np.array(words.langs, dtype=object)
        total = np.bincount(words.lang, n, len(langs)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([
            pa.array([*langs[words.lang], *langs], pa.string()), pa.array([*words.word, *[None] * len(langs)], pa.string()),
            pa.array(np.concatenate([n, total]), pa.int64())], ["lang", "word", "n"])


def _summaries(lengths: tuple[int, int], parts: int, frequent, pairs):
    """Chunks' sums of phrases by hash, as rows (part, mass, blob)."""
    shortest, longest = lengths

    def run(batches):
        known, good_pairs = Filter(frequent.value), Filter(pairs.value) if pairs else None
        for chunk in chunks(batches, CHUNK_BYTES):
            words = words_of(chunk)
            found, state = [], _phrases(words, known.holds(words.hashes()), longest)
            step = next(state)
            while step:
                length, _, value = step
                if length >= shortest:
                    found.append(value)
                try:
                    step = state.send(good_pairs.holds(value) if good_pairs and length == 2 else None)
                except StopIteration:
                    step = None
            value, count = np.unique(np.concatenate(found), return_counts=True)
            part = part_of(value, parts)
            cut = np.flatnonzero(np.diff(part, prepend=-1))
            rows = [(int(part[x]), int(count[x:y].sum()), dump(sorted_planes(value[x:y]), narrow(count[x:y]))) for x, y in zip(cut, [*cut[1:], len(value)])]
            yield _record_batch(rows)

    return run


def _survivors(least: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        capacity = SLACK * int(rows["mass"].sum()) // least + 1
        waiting, size = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), 0)], 0
        for blob in rows["blob"]:
            keys, counts = load(blob)
            waiting.append((from_sorted_planes(keys), counts.astype(np.int64), 0))
            size += len(counts)
            if size > capacity:
                waiting, size = [merge(waiting, capacity)], 0
        summary = merge(waiting, capacity)
        keys, counters, lost = summary
        return pd.DataFrame({"hash": keys[counters + lost >= least].view(np.int64)})

    return run


def _exact_sums(longest: int, parts: int, frequent, survivors):
    """Chunks' sums of surviving phrases, by their words, as rows (part, mass, blob)."""

    def run(batches):
        known, left = Filter(frequent.value), Filter(survivors.value)
        for chunk in chunks(batches, CHUNK_BYTES):
            words = words_of(chunk)
            n_words, found = len(words.word), []
            number = words.of.copy()  # of the phrase that begins at each word, among those of its length
            state = _phrases(words, known.holds(words.hashes()), longest)
            step = next(state)
            while step:
                length, at, value = step
                good = left.holds(value)
                at, value = at[good], value[good]
                _, first, number_of, count = np.unique(number[at] * n_words + words.of[at + length - 1], return_index=True, return_inverse=True, return_counts=True)
                number[at] = number_of
                found.append((part_of(value[first], parts), at[first], np.full(len(first), length), count))
                try:
                    step = state.send(good)
                except StopIteration:
                    step = None
            part, at, length, count = (np.concatenate(x) for x in zip(*found))
            rows = []
            for p, (at, length, count) in by_target(part, at, length, count):
                phrases = [" ".join([words.word[w] for w in words.of[i:i + n].tolist()]) for i, n in zip(at.tolist(), length.tolist())]
                # no word holds a line feed
                rows.append((p, int(count.sum()), dump(words.langs, narrow(words.lang[words.of[at]]), "\n".join(phrases), narrow(length), narrow(count))))
            yield _record_batch(rows)

    return run


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["part", "mass", "blob"]),
                                      schema=pa.schema([("part", pa.int64()), ("mass", pa.int64()), ("blob", pa.binary())]), preserve_index=False)


def _total(least: int):
    """Exact counts of a part's phrases; a phrase is in one part only."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        total: Counter = Counter()
        for blob in rows["blob"]:
            langs, lang, phrases, length, count = load(blob)
            for x, phrase, n, c in zip(lang.tolist(), phrases.split("\n"), length.tolist(), count.tolist()):
                total[langs[x], phrase, n] += c
        return pd.DataFrame([(*k, c) for k, c in total.items() if c >= least], columns=["lang", "phrase", "words", "a"])

    return run


def frequent_phrases(rows: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """Of a frame (lang, text): exact counts (lang, phrase, words, a) of all phrases of at least that frequency, and words per lang."""
    spark = rows.sparkSession
    send = spark.sparkContext.broadcast
    counted = materialise(rows.mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("a")).where(f"word IS NULL OR a >= {least}"))
    single = counted.where("word IS NOT NULL").select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), "a")
    totals = counted.where("word IS NULL").select("lang", F.col("a").alias("n"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max((size >> 5).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    frequent = send(Filter.collect(single.select(F.xxhash64("lang", "phrase").alias("hash")), bits))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))

    def survive(lengths, pairs=None):
        summed = rows.mapInArrow(_summaries(lengths, parts, frequent, pairs), "part long, mass long, blob binary")
        return Filter.collect(summed.groupBy("part").applyInPandas(_survivors(least), "hash long"), bits)

    left = survive((2, 2))
    if longest > 2:
        longer = survive((3, longest), send(left))
        left = np.bitwise_or(np.frombuffer(left, np.int64), np.frombuffer(longer, np.int64)).tobytes()
    sums = rows.mapInArrow(_exact_sums(longest, parts, frequent, send(left)), "part long, mass long, blob binary")
    exact = sums.groupBy("part").applyInPandas(_total(least), "lang string, phrase string, words int, a long")
    return materialise(exact.unionByName(single)), totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each language's best phrases by lowest-scoring cut: lang, rank, phrase, a, l, r, n, score.

    A phrase is dropped if a longer candidate that holds it occurs as often.  A null text is empty, a null language is
    ``und``; repeated rows count each.  Ties are broken by frequency, then by the phrase's bytes, so ranks are unique.
    Other columns don't matter.  An empty table, and a language without frequent phrases, gives no rows.
    """
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    counts, totals = frequent_phrases(rows, least, longest)
    candidates = counts.where("words > 1").withColumn("w", F.split("phrase", " "))
    inside = (
        candidates.where("words > 2")
        .selectExpr("lang", "a", "explode(flatten(transform(sequence(2, words - 1), k -> transform(sequence(1, words - k + 1), i -> array_join(slice(w, i, k), ' '))))) AS phrase")
        .groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    )
    kept = candidates.join(inside, ["lang", "phrase"], "left").where("longer IS NULL OR 100 * longer < 100 * a").drop("longer")
    cut = kept.selectExpr("lang", "phrase", "a", "words", "w", "explode(sequence(1, words - 1)) AS k").selectExpr(
        "lang", "phrase", "a", "k", "array_join(slice(w, 1, k), ' ') AS first", "array_join(slice(w, k + 1, words - k), ' ') AS rest")
    first = counts.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    rest = counts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    whole = "CAST({} AS DECIMAL(19, 0))".format
    scored = (
        cut.join(first, ["lang", "first"]).join(rest, ["lang", "rest"]).join(totals, "lang")
        .withColumn("score", F.expr(f"(1000 * {whole('a')} * {whole('n')}) div ({whole('l')} * {whole('r')})"))
        .groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        .select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^ \\t]+') AS w
  FROM (SELECT lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\x0B\\f\\r]')) AS piece FROM documents)
), grams AS (
  SELECT lang, k AS words, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)
), totals AS (SELECT lang, count(*) AS n FROM grams WHERE words = 1 GROUP BY lang),
counts AS (SELECT lang, words, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE words > 1),
inside AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, a, w, k, unnest(range(1, words - k + 2)) AS i FROM candidates, (SELECT unnest(range(2, 5)) AS k) WHERE words > k) GROUP BY 1, 2
), cuts AS (
  SELECT c.lang, c.phrase, c.a, k, array_to_string(w[:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, words)) AS k FROM candidates) c LEFT JOIN inside i ON i.lang = c.lang AND i.phrase = c.phrase
  WHERE i.longer IS NULL OR 100 * i.longer < 100 * c.a
), scored AS (
  SELECT c.lang, c.phrase, c.a, l.a AS l, r.a AS r, n, k,
         CAST((1000 * c.a::HUGEINT * n) // (l.a::HUGEINT * r.a) AS BIGINT) AS score
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = c.first JOIN counts r ON r.lang = c.lang AND r.phrase = c.rest JOIN totals t ON t.lang = c.lang
), lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


@query("op12_collocations", _SQL)
def op12(spark, d):
    """Best phrases of each language over all documents."""
    return collocations(table(spark, d, "documents"))
