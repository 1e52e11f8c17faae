"""The event archive: month-partitioned rows with a JSON payload, expanded to commits."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens import config
from eventlens.functions.rules import contains_any

ARCHIVE_SCHEMA = (
    "created_at TIMESTAMP, type STRING, actor STRUCT<login: STRING>, "
    "repo STRUCT<name: STRING>, payload STRING, month STRING"
)


def month_label(token: str) -> str:
    """'2025-01', '2025_01' and '202501' all name the same month."""
    m = re.fullmatch(r"(\d{4})[-_]?(\d{2})", token)
    if not m or not 1 <= int(m.group(2)) <= 12:
        raise ValueError(f"not a month: {token!r}")
    return f"{m.group(1)}-{m.group(2)}"


def _first_day(label: str) -> dt.date:
    return dt.date(int(label[:4]), int(label[5:]), 1)


def _next_month(day: dt.date) -> dt.date:
    return dt.date(day.year + day.month // 12, day.month % 12 + 1, 1)


def month_range(df: DataFrame, first: str, last: str, ts: str = "created_at") -> DataFrame:
    """Inclusive calendar-month range.

    A ``month`` partition column is compared as a label, so whole directories
    are pruned; otherwise the range becomes two timestamp bounds that reach
    the file statistics.
    """
    a, b = month_label(first), month_label(last)
    if "month" in df.columns:
        return df.where(F.col("month").between(a, b))
    lo, hi = _first_day(a), _next_month(_first_day(b))
    kind = dict(df.dtypes)[ts]
    bound = lambda d: F.lit(d.isoformat() + " 00:00:00").cast(kind)
    return df.where((F.col(ts) >= bound(lo)) & (F.col(ts) < bound(hi)))


def in_months(df: DataFrame, months: list[str], ts: str = "created_at") -> DataFrame:
    """Rows of the listed months, tagged with ``month``, so that one job answers for all of them."""
    labels = sorted({month_label(m) for m in months})
    if not labels:
        return df.limit(0) if "month" in df.columns else df.limit(0).withColumn("month", F.lit(""))
    if "month" in df.columns:
        return df.where(F.col("month").isin(labels))
    bounded = month_range(df, labels[0], labels[-1], ts)
    return bounded.withColumn("month", F.date_format(ts, "yyyy-MM")).where(F.col("month").isin(labels))


def read_archive(
    spark: SparkSession, path: str, first: str | None = None, last: str | None = None, fmt: str = "parquet"
) -> DataFrame:
    """Scan of a ``month=yyyy-MM`` partitioned archive; actor and repo are flattened."""
    df = spark.read.schema(ARCHIVE_SCHEMA).format(fmt).load(path)
    if first or last:
        df = month_range(df, first or "0001-01", last or "9999-12")
    return df.select(
        "created_at", "type", F.col("actor.login").alias("login"), F.col("repo.name").alias("repo_name"),
        "payload", "month",
    )


def pushes(df: DataFrame) -> DataFrame:
    return df.where(F.col("type") == config.PUSH_TYPE)


def prefilter(df: DataFrame, needles, enabled: bool = True) -> DataFrame:
    """Keep rows whose raw payload holds a needle, before any JSON is parsed.

    This is part of the result definition, not just a speed-up: the test is
    case-sensitive and sees only the payload, so it drops rows that the regular
    expressions or the login rules alone would keep.
    """
    return df.where(contains_any(F.col("payload"), needles)) if enabled else df


_FIELDS = {"sha": "$.sha", "message": "$.message", "author_name": "$.author.name", "author_email": "$.author.email"}


def scalar_text(value: Column, path: str = "$") -> Column:
    """Text of a scalar inside a VARIANT; objects, arrays, JSON null and a missing path are null.

    Numbers come back in their canonical form, booleans as true and false.
    """
    found = F.try_variant_get(value, path, "variant")
    kind = F.substring_index(F.schema_of_variant(found), "<", 1)
    return F.when(~kind.isin("OBJECT", "ARRAY"), F.try_variant_get(found, "$", "string"))


def explode_commits(
    df: DataFrame, fields=("sha", "message", "author_name", "author_email"), keep=None, position: bool = False
) -> DataFrame:
    """One row per element of ``$.commits``; a missing, null, empty or other than array value yields none.

    A payload is parsed once, and only ``commits`` of it is kept, as VARIANT elements.  Fields are read from an
    element when it is asked for them; a value that is no scalar is null, and so are all fields of an element that is no
    object.  The fields come out of a generator, so that conditions on them don't read the element again.
    """
    keep = keep or [c for c in df.columns if c != "payload"]
    parsed = F.from_json("payload", "commits ARRAY<VARIANT>").getField("commits")
    gen = F.posexplode(parsed).alias("commit_pos", "c") if position else F.explode(parsed).alias("c")
    extra = ["commit_pos"] if position else []
    values = F.struct(*[scalar_text(F.col("c"), _FIELDS[f]).alias(f) for f in fields])
    return df.select(*keep, gen).select(*keep, *extra, F.inline(F.array(values)))


def push_size() -> Column:
    """``$.size`` as a number; text that is not a number is null rather than an error."""
    return F.get_json_object("payload", "$.size").try_cast("bigint")
