"""Ordered operators that don't put a whole stream into one task.

Time is cut into buckets.  Windows run within (keys, bucket); what a bucket needs of
earlier ones is one row per bucket, found by an aggregation with partial sums, carried
over a small table and joined back.  A stream with a third of all rows is thus worked
on by as many tasks as it has buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a bucket of the densest stream is meant to hold.
BUCKET_ROWS = 500_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows with equal keys in one task, for maps over partitions.

    Spark drops a plain repartition where a join or an aggregation below deals by the same
    keys, and adaptive execution, which sees no need of the map, may then read that join's
    parts piecemeal.  No step below deals by this hash, so the shuffle stays.
    """
    return df.repartition(F.xxhash64(*keys))


def bucket_width(df: DataFrame, keys: Sequence[str], ts: str) -> int:
    """Width of a bucket in the unit of ``ts``, from counts and spans of all keys.

    A stream of minutes at a high rate and one of years at a low rate both come in
    buckets of about ``BUCKET_ROWS``; a stream with fewer rows is one bucket.
    """
    per_key = df.groupBy(*keys).agg(F.count("*").alias("n"), (F.max(ts) - F.min(ts) + 1).alias("span"))
    # Rows per unit of time in the densest stream that needs more than one bucket.
    dense = F.max(F.when(F.col("n") > BUCKET_ROWS, F.col("n") / F.col("span")))
    found = per_key.agg(dense.alias("dense"), F.max("span").alias("span")).first()
    if found["dense"] is None:
        return 1 << 62
    return max(1, int(BUCKET_ROWS / found["dense"]))


def bucketed(df: DataFrame, keys: Sequence[str], ts: str, width: int | None) -> DataFrame:
    return df.withColumn("_bucket", F.floor(F.col(ts) / F.lit(width or bucket_width(df, keys, ts))))


def joined_back(df: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on null-safe keys and bucket."""
    names = [*keys, "_bucket"]
    right = carry.select(*(F.col(k).alias(f"_r_{k}") for k in names), "_carry")
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in names]
    return df.join(right, on, "left").drop(*(f"_r_{k}" for k in names))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, ts: str = "ts_us", width: int | None = None) -> DataFrame:
    """Adds the 0-based place of each row in ``order`` among its ``keys``."""
    rows = bucketed(df, keys, ts, width)
    sizes = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = sizes.withColumn("_carry", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    own = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    placed = joined_back(rows.withColumn("_own", own), carry, keys)
    return placed.withColumn(name, F.col("_carry") + F.col("_own") - 1).drop("_bucket", "_own", "_carry")


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, ts: str = "ts_us", width: int | None = None) -> DataFrame:
    """Adds ``value`` of the row just before, null for the first of its keys."""
    rows = bucketed(df, keys, ts, width).withColumn("_value", value)
    ends = rows.groupBy(*keys, "_bucket").agg(F.max(F.struct(*order, "_value")).alias("_end"))
    over = Window.partitionBy(*keys).orderBy("_bucket")
    carry = ends.withColumn("_carry", F.lag(F.col("_end")["_value"]).over(over))
    first = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)) == 1
    own = F.lag("_value").over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    placed = joined_back(rows.withColumn("_own", own).withColumn("_first", first), carry, keys)
    return placed.withColumn(name, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_own"))).drop("_bucket", "_value", "_own", "_first", "_carry")


def last_known(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, ts: str = "ts_us", width: int | None = None) -> DataFrame:
    """Adds the last value that isn't null at or before each row, in ``order``."""
    rows = bucketed(df, keys, ts, width).withColumn("_value", value)
    known = F.when(F.col("_value").isNotNull(), F.struct(*order, "_value"))
    ends = rows.groupBy(*keys, "_bucket").agg(F.max(known).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.withColumn("_carry", F.last(F.col("_end")["_value"], ignorenulls=True).over(before))
    upto = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = joined_back(rows.withColumn("_own", F.last("_value", ignorenulls=True).over(upto)), carry, keys)
    return placed.withColumn(name, F.coalesce("_own", "_carry")).drop("_bucket", "_value", "_own", "_carry")


def next_known(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, ts: str = "ts_us", width: int | None = None) -> DataFrame:
    """Adds the first value that isn't null at or after each row, in ``order``."""
    rows = bucketed(df, keys, ts, width).withColumn("_value", value)
    known = F.when(F.col("_value").isNotNull(), F.struct(*order, "_value"))
    starts = rows.groupBy(*keys, "_bucket").agg(F.min(known).alias("_start"))
    after = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(1, Window.unboundedFollowing)
    carry = starts.withColumn("_carry", F.first(F.col("_start")["_value"], ignorenulls=True).over(after))
    fromhere = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    placed = joined_back(rows.withColumn("_own", F.first("_value", ignorenulls=True).over(fromhere)), carry, keys)
    return placed.withColumn(name, F.coalesce("_own", "_carry")).drop("_bucket", "_value", "_own", "_carry")


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, ts: str = "ts_us", width: int | None = None) -> DataFrame:
    """Adds the sum of ``value`` up to and with each row."""
    rows = bucketed(df, keys, ts, width).withColumn("_value", value)
    sums = rows.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.withColumn("_carry", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    upto = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = joined_back(rows.withColumn("_own", F.sum("_value").over(upto)), carry, keys)
    return placed.withColumn(name, F.col("_carry") + F.col("_own")).drop("_bucket", "_value", "_own", "_carry")
