"""Counts, ranges, rates and gap statistics of recordings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklode.model import CONFIGURATION, DATA, STATE, stream_name
from tracklode.operators.ordered import previous, running_sum

FILE_STREAM = ("file_id", "type_id", "instance_id")


def stream_counts(records: DataFrame) -> DataFrame:
    """Per stream: n_total, n_configuration, n_state, n_data."""
    kinds = [F.count_if(F.col("record_type") == t).alias(f"n_{t}") for t in (CONFIGURATION, STATE, DATA)]
    return records.groupBy(*FILE_STREAM).agg(F.count("*").alias("n_total"), *kinds)


def data_time_range(records: DataFrame) -> DataFrame:
    """Per file: first and last data time, 0 if there is none."""
    data = F.when(F.col("record_type") == DATA, F.col("ts_us"))
    return records.groupBy("file_id").agg(F.coalesce(F.min(data), F.lit(0)).alias("first_us"), F.coalesce(F.max(data), F.lit(0)).alias("last_us"))


def rate(n: str = "n", first: str = "first_us", last: str = "last_us") -> F.Column:
    """Records per second between the first and the last; null if that isn't defined."""
    n, span = F.col(n), F.col(last) - F.col(first)
    return F.when((n > 1) & (span > 0), (n - 1) * F.lit(1e6) / span)


def stream_type_stats(records: DataFrame) -> DataFrame:
    """Per stream and type: n, first_us, last_us, rps."""
    out = records.groupBy(*FILE_STREAM, "record_type").agg(F.count("*").alias("n"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))
    return out.withColumn("rps", rate())


def overview(records: DataFrame) -> DataFrame:
    """Counts and ranges per file, per stream, and per stream and type, in one pass.

    ``level`` is 0 for a file, 1 for a stream, 2 for a stream and type.
    """
    sets = [("file_id",), ("file_id", "stream_id"), ("file_id", "stream_id", "record_type")]
    grouped = records.groupingSets([[F.col(c) for c in s] for s in sets], "file_id", "stream_id", "record_type")
    out = grouped.agg(
        F.count("*").alias("n"),
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
        F.sum("record_size").alias("size"),
        (2 - F.grouping("stream_id") - F.grouping("record_type")).cast("int").alias("level"),
    )
    return out.select("level", "file_id", "stream_id", "record_type", "n", "first_us", "last_us", "size", rate().alias("rps"))


def stream_signature(records: DataFrame, streams: DataFrame) -> DataFrame:
    """Per file: ``type-serial-#configuration-#state-#data`` of its streams, in order.

    streams(file_id, type_id, instance_id, serial); streams without records count 0.
    """
    held = streams.join(stream_counts(records), list(FILE_STREAM), "left").na.fill(0, [f"n_{t}" for t in (CONFIGURATION, STATE, DATA)])
    part = F.concat_ws("-", "type_id", "serial", "n_configuration", "n_state", "n_data")
    parts = F.array_sort(F.collect_list(F.struct("type_id", "instance_id", part.alias("part"))))
    return held.groupBy("file_id").agg(F.array_join(F.transform(parts, lambda p: p["part"]), ",").alias("signature"))


def gap_bucket(gap: F.Column) -> F.Column:
    """Bucket in ms of a gap in seconds: 1 ms below 10 ms, 5 ms below 1 s, then 1 s."""
    ms = F.floor(gap * 1000).cast("long")
    fine = F.when(ms > 0, ms).when(gap < 0.00075, 0).otherwise(1)
    return F.when(gap < 0.01, fine).when(gap < 1, ms - ms % 5).otherwise(F.floor(gap).cast("long") * 1000)


def gap_histogram(records: DataFrame) -> DataFrame:
    """Per stream: gaps between data records by bucket: bucket, n, sum_us."""
    data = records.where(F.col("record_type") == DATA)
    gaps = previous(data, FILE_STREAM, ("ts_us", "file_offset"), F.col("ts_us"), "_t").withColumn("gap", F.col("ts_us") - F.col("_t")).where("gap IS NOT NULL")
    return gaps.groupBy(*FILE_STREAM, gap_bucket(F.col("gap") / 1e6).alias("bucket")).agg(F.count("*").alias("n"), F.sum("gap").alias("sum_us"))


MOST_GAPS = 501


def rate_from_gaps(gaps: list[float]) -> float:
    """Frames per second from gaps in time order: the modal bucket, widened to four fifths of all gaps."""
    gaps = gaps[:MOST_GAPS]
    if not gaps:
        return 30.0
    buckets: dict[int, list[float]] = {}
    top, top_n = 0, 0
    for g in gaps:
        ms = int(g * 1000)
        key = (ms or (0 if g < 0.00075 else 1)) if g < 0.01 else ms - ms % 5 if g < 1 else int(g) * 1000
        held = buckets.setdefault(key, [0, 0.0])
        held[0] += 1
        held[1] += g
        if key and held[0] > top_n:
            top, top_n = key, held[0]
    if len(gaps) < 10 or top == 0:
        return len(gaps) / sum(gaps) if sum(gaps) > 0 else 0.0
    keys = sorted(buckets)
    lo = hi = keys.index(top)
    n, total = buckets[top]
    while n < len(gaps) * 80 // 100:
        left = buckets[keys[lo - 1]][0] if lo > 0 and keys[lo - 1] != 0 else 0
        right = buckets[keys[hi + 1]][0] if hi + 1 < len(keys) else 0
        if not left and not right:
            break
        if left > right:
            lo -= 1
            more = buckets[keys[lo]]
        else:
            hi += 1
            more = buckets[keys[hi]]
        n, total = n + more[0], total + more[1]
    return n / total if total > 0 else 0.0


@F.pandas_udf(T.DoubleType())
def rate_of(times: pd.Series) -> pd.Series:
    """Rates of arrays of times in microseconds."""
    return pd.Series([rate_from_gaps([(b - a) / 1e6 for a, b in zip(ts, ts[1:])]) for ts in (sorted(x.tolist()) for x in times)])


def fps_estimate(records: DataFrame) -> DataFrame:
    """Per stream: fps from its first data records; tasks cut their streams before any shuffle."""
    place = F.row_number().over(Window.partitionBy(*FILE_STREAM).orderBy("ts_us", "file_offset"))
    data = records.where(F.col("record_type") == DATA).select(*FILE_STREAM, "ts_us", "file_offset", place.alias("_k"))
    first = data.where(F.col("_k") <= MOST_GAPS + 1)
    return first.groupBy(*FILE_STREAM).agg(F.collect_list("ts_us").alias("_ts")).select(*FILE_STREAM, rate_of("_ts").alias("fps"))


def audio_summary(blocks: DataFrame, rate_hz: int) -> DataFrame:
    """Per stream of audio blocks (ts_us, samples): gap and duration extremes, losses, totals.

    The first-sample ratio weighs frame differences to the fourth power in doubles.
    """
    keys = list(FILE_STREAM)
    order = ("ts_us", "file_offset")
    rows = previous(blocks, keys, order, F.struct("ts_us", "samples"), "prior")
    gap = (F.col("ts_us") - F.col("prior.ts_us")) / 1e6
    before, now = F.col("prior.samples") / rate_hz, F.col("samples") / rate_hz
    ratio = gap / F.greatest(before, now)
    in_samples = F.floor(gap * rate_hz)
    rows = rows.select(
        *keys,
        "ts_us",
        "samples",
        gap.alias("gap"),
        before.alias("before"),
        F.when(ratio > 1.8, F.floor(ratio - 0.5)).otherwise(0).alias("missed"),
        F.pow(in_samples - F.col("samples"), F.lit(4.0)).alias("first_w"),
        F.pow(in_samples - F.col("prior.samples"), F.lit(4.0)).alias("past_w"),
    )
    return rows.groupBy(*keys).agg(
        F.min("gap").alias("min_gap"),
        F.max("gap").alias("max_gap"),
        F.min("before").alias("min_mid_duration"),
        F.max("before").alias("max_mid_duration"),
        F.sum("missed").cast("long").alias("missed"),
        (F.sum("samples") / rate_hz).alias("total_duration"),
        (F.sum("first_w") / F.when(F.sum("past_w") > 0, F.sum("past_w"))).alias("first_sample_ratio"),
    )


def segments(blocks: DataFrame, form: str = "form") -> DataFrame:
    """Adds segment, from 0: a new one starts wherever a stream's format changes."""
    order = ("ts_us", "file_offset")
    rows = previous(blocks, FILE_STREAM, order, F.struct(F.col(form).alias("f")), "_prior")
    change = F.when(F.col("_prior").isNotNull() & ~F.col("_prior.f").eqNullSafe(F.col(form)), 1).otherwise(0)
    return running_sum(rows.withColumn("_change", change), FILE_STREAM, order, F.col("_change"), "segment").drop("_prior", "_change")


def jitter(blocks: DataFrame, rate_hz: int, limit_us: int = 10_000) -> DataFrame:
    """Adds expected_us (segment start plus the samples before) and late: off by more than the limit."""
    keys, order = [*FILE_STREAM, "segment"], ("ts_us", "file_offset")
    starts = blocks.groupBy(*keys).agg(F.min("ts_us").alias("_start"))
    rows = running_sum(blocks, keys, order, F.col("samples"), "_sum").join(starts, keys)
    expected = F.col("_start") + F.floor((F.col("_sum") - F.col("samples")) * 1_000_000 / rate_hz)
    return rows.withColumn("expected_us", expected).withColumn("late", F.abs(F.col("ts_us") - F.col("expected_us")) > limit_us).drop("_sum", "_start")


def decode_check(status: DataFrame) -> DataFrame:
    """status(file_id, order columns, ok) -> per file: total, good up to the first error, percent."""
    bad = F.min(F.when(~F.col("ok"), F.struct("ts_us", "type_id", "instance_id", "file_offset")))
    first_bad = status.groupBy("file_id").agg(bad.alias("bad"), F.count("*").alias("total"))
    here = F.struct("ts_us", "type_id", "instance_id", "file_offset")
    joined = status.join(first_bad, "file_id")
    out = joined.groupBy("file_id").agg(F.max("total").alias("total"), F.count_if(F.col("bad").isNull() | (here < F.col("bad"))).alias("good"))
    return out.withColumn("percent", F.col("good") * 100.0 / F.col("total"))


def json_description(records: DataFrame) -> DataFrame:
    """Per stream: a JSON line with counts, range and size over all types."""
    out = records.groupBy(*FILE_STREAM).agg(
        F.count("*").alias("n"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.sum("record_size").alias("size")
    )
    return out.select("file_id", F.to_json(F.struct(stream_name().alias("stream_id"), "n", "first_us", "last_us", "size")).alias("json"))
