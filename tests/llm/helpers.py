"""Small documents with awkward cases, and brute-force versions of the operators."""

from __future__ import annotations

import re

import duckdb

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def words(text: str | None) -> list[str]:
    return WORDS.findall(text or "")


def documents(sf: str = SF) -> list[tuple]:
    return duckdb.sql(f"SELECT doc_id, text, lang, source, n_chars FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()


def awkward() -> list[tuple]:
    """Null and empty columns, repeated rows and ids, ties, one very long text, odd characters."""
    line = "one two three four five six seven eight nine ten eleven twelve "
    return [
        (1, line * 3, "en", "a", 1), (2, line * 3, "en", "a", 1), (2, line * 3, "en", "a", 1), (2, "another text here", "en", "b", 1),
        (3, None, "en", "a", None), (4, "", None, None, 0), (5, " \n\t ", "en", "b", 4), (None, line * 2, None, None, 1),
        (None, None, None, None, None), (6, "\0 a b \U0001f600 É é İ\n" * 5, "en", "c", 1),
        (7, " ".join(f"word{i % 997}" for i in range(60_000)), "en", "c", 1), (8, "x" * 300, "en", "", 1),
        (9, "solo", "en", "a", 1), (10, line * 3 + "coda", "en", "b", 1),
    ]


def frame(spark, rows, **extra):
    """Documents with further columns, named as operators might name their own."""
    df = spark.createDataFrame(rows, DOC_SCHEMA)
    for name, value in extra.items():
        df = df.selectExpr("*", f"{value} AS `{name}`")
    return df


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
