"""Top-k, top-n per group, latest per key, caps and hash samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.session import materialise


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """Global top-k; each task keeps k rows before the merge.  Give a unique tie-break last."""
    return df.orderBy(*order).limit(k)


def topn_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, rank_col: str | None = None) -> DataFrame:
    """First n rows of every group; the optimizer trims each task to n per group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n)
    return out.withColumnRenamed("_rank", rank_col) if rank_col else out.drop("_rank")


def latest_per_key(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The row with the greatest version tuple per key.

    A max over a struct aggregates on the map side, so a key that holds a large
    share of the rows sends one row per task instead of all of them.
    """
    rest = [c for c in df.columns if c not in keys]
    ordered = version + [c for c in rest if c not in version]
    packed = F.max(F.struct(*ordered)).alias("_row")
    return df.groupBy(*keys).agg(packed).select(*keys, "_row.*").select(*df.columns)


def top1_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return topn_per_group(df, keys, order, 1)


HASH_STEPS = 1 << 32


def hash_fraction(*cols) -> Column:
    """A reproducible uniform integer in [0, HASH_STEPS) from the row's key."""
    digest = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in cols]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def sample_rows(df: DataFrame, keys: list[str], fraction: float, cap: int | None = None, era: str | None = None,
                seeded: bool = True) -> DataFrame:
    """Bernoulli sample of about ``fraction`` of the rows, optionally capped and tagged.

    The hash form depends only on the key, so every engine and every retry
    picks the same rows, and a capped sample keeps the smallest hashes.
    """
    if not 0 < fraction <= 1 or int(fraction * HASH_STEPS) < 1:
        raise ValueError("the fraction must be at least one step of the hash and at most one")
    if not seeded:
        out = df.sample(fraction=fraction)
        out = out.limit(cap) if cap else out
    else:
        out = df.withColumn("_h", hash_fraction(*keys)).where(F.col("_h") < F.lit(int(fraction * HASH_STEPS)))
        out = (_smallest_hashes(out, keys, cap) if cap else out).drop("_h")
    return out.withColumn("era", F.lit(era)) if era else out


def _reached(counts: DataFrame, step: str, cap: int) -> DataFrame:
    """One row: the first step at which the running count reaches the cap, and the rows before it.

    ``counts`` (_all, step, _c) has at most 65,537 rows.  There is no row if the cap is never reached.
    """
    upto = F.sum("_c").over(Window.partitionBy("_all").orderBy(step))
    first = F.min(F.struct(F.col(step).alias("step"), (F.col("_upto") - F.col("_c")).alias("before")))
    return counts.withColumn("_upto", upto).where(F.col("_upto") >= cap).groupBy("_all").agg(first.alias("_first")).select(
        "_all", F.col("_first.step").alias(f"{step}_end"), F.col("_first.before").alias("_before"))


def _smallest_hashes(sample: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """The ``cap`` rows with the least hash.

    The sample is written once.  Counts by the upper and then by the lower half
    of the hash (at most 65,536 rows each) give the hash at which the cap is
    reached; rows below it pass without being ordered, and only rows of that one
    hash are ranked.
    """
    sample = materialise(sample.withColumns({"_top": F.shiftright("_h", 16), "_all": F.lit(0)}))
    top = _reached(sample.groupBy("_all", "_top").agg(F.count("*").alias("_c")), "_top", cap)
    inside = sample.select("_all", "_top", "_h").join(F.broadcast(top), "_all").where(F.col("_top") == F.col("_top_end"))
    # the rows of earlier steps count as one step before all others
    low = inside.groupBy("_all", "_h").agg(F.count("*").alias("_c")).unionByName(
        top.select("_all", F.lit(-1).cast("long").alias("_h"), F.col("_before").alias("_c")))
    end = _reached(low, "_h", cap).withColumnRenamed("_before", "_h_before")
    rows = sample.join(F.broadcast(end), "_all", "left")
    drop = ["_all", "_h_end", "_h_before", "_top"]
    below = rows.where(F.col("_h_end").isNull() | (F.col("_h") < F.col("_h_end"))).drop(*drop)
    rank = F.row_number().over(Window.partitionBy("_h").orderBy(*keys))
    at = rows.where(F.col("_h") == F.col("_h_end")).withColumn("_rank", rank).where(F.col("_h_before") + F.col("_rank") <= cap)
    return below.unionByName(at.drop("_rank", *drop))
