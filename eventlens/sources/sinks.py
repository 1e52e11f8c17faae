"""Result sinks.  Parquet by default; CSV and JSON where a flat file is wanted."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_archive(df: DataFrame, path: str) -> None:
    """Month directories; a big month is cut into several files by time, a small one is a single file."""
    write_parquet(df.repartitionByRange("month", "created_at"), path, ["month"])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row; nested structs, arrays and maps are kept."""
    df.write.mode("overwrite").json(path)
