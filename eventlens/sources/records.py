"""CSV with quoted line feeds, read in splits.

A reader of such files normally takes each file in one task, because a line feed ends a record only outside quotes, and
that depends on all quotes before it.  Here lines are read in splits as plain text.  A first scan counts the quotes of
every split; the parity of those before a split says whether it begins inside a record.  A second scan puts the lines of
each split together to records, a third one finds the pieces of records that cross the edge of a split; only these are
exchanged.  Three scans of the text by many tasks replace one scan by a single task.

Quotes inside a value are doubled, so parity sees them in pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_WHOLE, _HEAD, _MIDDLE, _TAIL = 0, 1, 2, 3  # records, and pieces that end, continue and begin one


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _splits(lines: DataFrame) -> DataFrame:
    """file, start, number (from 0 within the file), inside: whether the split begins within quotes.  One row per split."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    parity = lines.groupBy("file", "start").agg((F.sum(quotes) % 2).alias("odd"))
    order = Window.partitionBy("file").orderBy("start")
    before = F.coalesce(F.sum("odd").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parity.select("file", "start", (F.row_number().over(order) - 1).alias("number"), (before % 2 == 1).alias("inside"))


def _joiner(kinds: tuple[int, ...]):
    """Records or pieces (``kinds``) of the splits of a task, whose lines come in order; first: the first record of a file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split, lines, within, begun, first = None, [], False, False, False
        out: list[tuple] = []

        def emit(kind: int) -> None:
            if kind in kinds:
                out.append((split[0], split[1], kind, "\n".join(lines), first))

        for batch in batches:
            for file, number, inside, value in zip(batch["file"], batch["number"], batch["inside"], batch["value"]):
                if (file, number) != split:
                    if lines:
                        emit(_TAIL if begun else _MIDDLE)
                    split, lines, within, begun, first = (file, number), [], bool(inside), False, number == 0
                if not within and not lines:
                    begun = True
                lines.append(value)
                within ^= value.count('"') % 2 == 1
                if not within:
                    emit(_WHOLE if begun else _HEAD)
                    lines, first = [], False
            yield pd.DataFrame(out, columns=_COLUMNS)
            out = []
        if lines:
            emit(_TAIL if begun else _MIDDLE)
        yield pd.DataFrame(out, columns=_COLUMNS)

    return run


_COLUMNS = ["file", "number", "kind", "record", "first"]


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """record, first (of its file): the records of all files under ``path``, line feeds within quotes kept."""
    lines = _lines(spark, path)
    # one row per split; Spark sends it to all tasks or, beyond its bound, sorts both sides by split
    placed = lines.join(_splits(lines), ["file", "start"]).select(F.xxhash64("file").alias("file"), "number", "inside", "value")
    read = lambda *kinds: placed.mapInPandas(_joiner(kinds), "file long, number int, kind int, record string, first boolean")
    order = Window.partitionBy("file").orderBy("number", F.col("kind") == _TAIL)
    pieces = read(_HEAD, _MIDDLE, _TAIL).withColumn("of", F.sum((F.col("kind") == _TAIL).cast("int")).over(order))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "record"))), lambda x: x["record"]), "\n")
    joined = pieces.groupBy("file", "of").agg(text.alias("record"), F.bool_or("first").alias("first"))
    return read(_WHOLE).select("record", "first").unionByName(joined.select("record", "first"))


def read_quoted_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """Rows of CSV files with quoted line feeds; a large file is read by many tasks.

    Empty lines are skipped; a carriage return before the line feed that ends a record belongs to the line end.
    """
    records = quoted_records(spark, path)
    if header:
        records = records.where(~F.col("first"))
    record = F.regexp_replace("record", r"\r\z", "")
    parsed = F.from_csv(record, schema, {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    return records.where(record != "").select(F.inline(F.array(parsed)))
