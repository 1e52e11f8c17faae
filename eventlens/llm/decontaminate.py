"""Benchmark decontamination by Wu-Manber search over words.

A pattern is a window of ``window`` consecutive words of a benchmark item (an item with fewer words is one shorter
pattern).  The search reads blocks of ``b`` words at the end of a window of the shortest pattern's length: a shift
table says how far the window may move without passing an occurrence, blocks in no pattern move it furthest.  Where
the shift is zero the block's suffix bucket gives the patterns that end so, and each is compared word by word.

The tables of one block of patterns hold at most ``block_patterns`` patterns and are sent to the executors; more
patterns are searched block by block, with the documents and their spans written in between.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import ascii_lower, query, table
from eventlens.session import materialise

WINDOW_WORDS = 10
BLOCK_PATTERNS = 200_000
#: ASCII letters and digits, and every character beyond ASCII
TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_TOKEN = re.compile(TOKEN)
_LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text: str | None) -> list[str]:
    return [] if text is None else _TOKEN.findall(text.translate(_LOWER))


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW_WORDS) -> DataFrame:
    """Distinct windows (words array) with the ids that hold them; items without words have none."""
    words = F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(TOKEN), F.lit(0))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    return (
        items.select(F.col(id_col).cast("string").alias("id"), words.alias("words"))
        .where(F.size("words") > 0)
        .select("id", "words", F.explode(starts).alias("start"))
        .select("id", F.slice("words", F.col("start"), window).alias("words"))
        .groupBy("words").agg(F.collect_set("id").alias("ids"))
    )


class PatternTables:
    """Shift table and suffix buckets of patterns of words, all of at least ``shortest`` words."""

    def __init__(self, patterns: list[tuple[tuple[str, ...], tuple[str, ...]]]):
        self.shortest = min(len(p) for p, _ in patterns)
        self.block = min(3, self.shortest)
        self.far = self.shortest - self.block + 1
        self.shift: dict[tuple[str, ...], int] = {}
        self.buckets: dict[tuple[str, ...], list] = defaultdict(list)
        for words, ids in patterns:
            for end in range(self.block, self.shortest + 1):
                block = words[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.far), self.shortest - end)
            self.buckets[words[self.shortest - self.block : self.shortest]].append((list(words), ids))

    def search(self, words: list[str]):
        """(start, end, ids) of every occurrence."""
        at, n, block, far, shift = self.shortest, len(words), self.block, self.far, self.shift
        while at <= n:
            suffix = tuple(words[at - block : at])
            move = shift.get(suffix, far)
            if not move:
                begin = at - self.shortest
                for pattern, ids in self.buckets[suffix]:
                    if words[begin : begin + len(pattern)] == pattern:
                        yield begin, begin + len(pattern), ids
                move = 1
            at += move


def _tables(rows) -> list[PatternTables]:
    """One set of tables for the full windows, one for the shorter items, so that these don't shorten the moves."""
    patterns = [(tuple(r["words"]), tuple(r["ids"])) for r in rows]
    longest = max((len(p) for p, _ in patterns), default=0)
    parts = [[x for x in patterns if len(x[0]) == longest], [x for x in patterns if len(x[0]) < longest]]
    return [PatternTables(p) for p in parts if p]


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_FOUND = "struct<n_words:bigint,spans:array<struct<start:int,end:int>>,items:array<string>>"
_FIELDS = ["n_words", "spans", "items"]


def _search(text, earlier, tables) -> dict:
    words = words_of(text)
    spans, items = [], set()
    if earlier is not None:
        spans = [(s["start"], s["end"]) for s in earlier["spans"]]
        items.update(earlier["items"])
    for t in tables:
        for a, b, ids in t.search(words):
            spans.append((a, b))
            items.update(ids)
    return {"n_words": len(words), "spans": [{"start": a, "end": b} for a, b in merge_spans(spans)], "items": sorted(items)}


def _searcher(tables):
    @F.pandas_udf(_FOUND)
    def search(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_search(t, None, tables.value) for t in texts], columns=_FIELDS)

    return search


def _continued(tables):
    """Searches one more block of patterns and adds to what the earlier ones have found."""

    @F.pandas_udf(_FOUND)
    def search(texts: pd.Series, earlier: pd.DataFrame) -> pd.DataFrame:
        rows = zip(texts, earlier.to_dict("records"))
        return pd.DataFrame([_search(t, e, tables.value) for t, e in rows], columns=_FIELDS)

    return search


def find_contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
                       window: int = WINDOW_WORDS, block_patterns: int = BLOCK_PATTERNS, found: str = "found") -> DataFrame:
    """``docs`` with a column ``found``: number of words, merged word spans in which windows occur, and item ids.

    Words are counted from 0 and ends are exclusive.  A null or empty text has no words; items without words match
    nothing; equal items are all reported; an item without an id is searched but not named.  A column of ``docs`` named like ``found`` is replaced.
    """
    spark = docs.sparkSession
    windows = materialise(item_windows(items, item_id, item_text, window))
    blocks = -(-windows.count() // block_patterns)
    out = docs.drop(found)
    for number in range(max(blocks, 1)):
        # blocks by hash: each has about block_patterns patterns, however many there are
        block = windows.where(F.pmod(F.xxhash64("words"), F.lit(max(blocks, 1))) == number)
        tables = spark.sparkContext.broadcast(_tables(block.collect()))

        call = _searcher(tables)(F.col(text_col)) if number == 0 else _continued(tables)(F.col(text_col), F.col(found))
        out = out.withColumn(found, call)
        if number + 1 < blocks:
            out = materialise(out)
    return out


def summary(found: str = "found") -> list:
    """Columns n_words, n_hit, n_items, items_sha256 and contaminated of a found column."""
    hit = F.aggregate(f"{found}.spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    items = F.array_sort(F.col(f"{found}.items"))
    return [
        F.col(f"{found}.n_words").alias("n_words"), hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    ]


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs."""
    return find_contamination(docs, items, found="_found").where(F.size("_found.spans") == 0).drop("_found")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
HITS_SQL = f"""item_words AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
item_starts AS (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - {WINDOW_WORDS - 1}, 1))) AS s FROM item_words WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, least(len(w), {WINDOW_WORDS}) AS n, array_to_string(w[s : s + {WINDOW_WORDS - 1}], ' ') AS key FROM item_starts),
lengths AS (SELECT DISTINCT n FROM windows),
doc_words AS (SELECT row_number() OVER () AS r, *, {_WORDS} AS w FROM DOCS),
doc_starts AS (SELECT r, w, l.n, unnest(generate_series(1, len(w) - l.n + 1)) AS s FROM doc_words, lengths l WHERE len(w) >= l.n),
doc_windows AS (SELECT r, n, s, array_to_string(w[s : s + n - 1], ' ') AS key FROM doc_starts),
hits AS (SELECT d.r, d.n, d.s, x.item_id FROM doc_windows d JOIN windows x ON d.n = x.n AND d.key = x.key),
hit_words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(generate_series(s, s + n - 1)) AS p FROM hits) GROUP BY r),
hit_items AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY r)"""


@query("op2_decontaminate", sql=f"""WITH {HITS_SQL.replace("DOCS", "documents")}
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit_words h USING (r) LEFT JOIN hit_items i USING (r)""")
def op2(spark, d):
    """Benchmark windows found in every document."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return find_contamination(docs, table(spark, d, "benchmark")).select("doc_id", *summary())
