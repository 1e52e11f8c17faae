"""Versions of a result table: directories that count once they are committed.

A version's rows are written first and its commit record, an empty file named after it, last.  Readers take the
greatest version that has a record, so a write that died half-way is never seen, and a version that has a record is
never written again.  All access goes through the file system of the path, so the table can lie in any store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_RECORDS = "_committed"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether the path is a single file, and not a folder."""
    fs, p = _path(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def version_path(root: str, version: int) -> str:
    return f"{root}/batch={version}"


def committed(spark: SparkSession, root: str) -> list[int]:
    """Versions with a commit record, in order."""
    fs, records = _path(spark, f"{root}/{_RECORDS}")
    if not fs.exists(records):
        return []
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(records) if s.getPath().getName().isdigit())


def write_version(df: DataFrame, root: str, version: int) -> bool:
    """Write and commit a version; False, and nothing is written, if it is committed already."""
    spark = df.sparkSession
    if version in committed(spark, root):
        return False
    df.write.mode("overwrite").parquet(version_path(root, version))
    fs, record = _path(spark, f"{root}/{_RECORDS}/{version}")
    fs.create(record, True).close()
    return True


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of a committed version, by default the newest one."""
    known = committed(spark, root)
    if not known or (version is not None and version not in known):
        raise ValueError(f"no committed version {'' if version is None else version} in {root}")
    return spark.read.parquet(version_path(root, known[-1] if version is None else version))


def compact_versions(spark: SparkSession, root: str, keep: int = 1) -> list[int]:
    """Remove all versions, finished or not, that are older than the newest ``keep`` committed ones; those that are left.

    The record of a version goes before its rows.
    """
    kept = committed(spark, root)[-max(keep, 1):]
    fs, top = _path(spark, root)
    if not kept:
        return kept
    for status in fs.listStatus(top):
        name = status.getPath().getName()
        version = name.removeprefix("batch=")
        if name.startswith("batch=") and version.isdigit() and int(version) < kept[0]:
            fs.delete(_path(spark, f"{root}/{_RECORDS}/{version}")[1], False)
            fs.delete(status.getPath(), True)
    return kept
