"""Lookups by time: lower bound, nearest, as-of, k-th, index numbers, gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklode.model import CONFIGURATION, DATA, ORDER
from tracklode.operators.ordered import bucket_width, last_known, next_known, numbered, previous

FILE_STREAM = ("file_id", "type_id", "instance_id")


def at_or_after(records: DataFrame, ts_us: int) -> DataFrame:
    """The first record with ts >= ts_us in canonical order: at most one row."""
    return records.where(F.col("ts_us") >= ts_us).orderBy(*ORDER).limit(1)


def nearest(records: DataFrame, ts_us: int, epsilon_us: int) -> DataFrame:
    """The record nearest to ts_us, at most epsilon away; the earlier side on a tie."""
    far = F.abs(F.col("ts_us") - ts_us)
    near = records.where(F.col("ts_us").between(ts_us - epsilon_us, ts_us + epsilon_us))
    # Within one time on the left the last record is met first, on the right the first.
    side = F.when(F.col("ts_us") < ts_us, 0).otherwise(1)
    place = [F.when(F.col("ts_us") < ts_us, -F.col(c)).otherwise(F.col(c)) for c in ORDER[1:]]
    return near.orderBy(far, side, *place).limit(1)


def mixed(probes: DataFrame, records: DataFrame, keys: Sequence[str], late: bool) -> DataFrame:
    """Probes and records as one relation; probes come before (or after) records of their time."""
    key_columns = list(keys)
    found = F.struct("ts_us", "file_offset")
    a = records.select(*key_columns, "ts_us", F.lit(0 if late else 1).alias("side"), *(F.col(c) for c in ORDER[1:] if c not in keys), F.lit(None).cast("long").alias("probe"), found.alias("hit"))
    b = probes.select(
        *key_columns,
        "ts_us",
        F.lit(1 if late else 0).alias("side"),
        *(F.lit(None).cast(records.schema[c].dataType).alias(c) for c in ORDER[1:] if c not in keys),
        F.col("probe"),
        F.lit(None).cast("struct<ts_us:bigint,file_offset:bigint>").alias("hit"),
    )
    return a.unionByName(b)


def lower_bound_join(probes: DataFrame, records: DataFrame, keys: Sequence[str] = FILE_STREAM) -> DataFrame:
    """probes(keys, ts_us, probe) -> the same with hit_ts_us and hit_offset of the first record at or after."""
    order = ["ts_us", "side", *(c for c in ORDER[1:] if c not in keys)]
    rows = next_known(mixed(probes, records, keys, late=False), keys, order, F.col("hit"), "next")
    return rows.where(F.col("probe").isNotNull()).select(*keys, "ts_us", "probe", F.col("next.ts_us").alias("hit_ts_us"), F.col("next.file_offset").alias("hit_offset"))


def nearest_join(probes: DataFrame, records: DataFrame, epsilon_us: int, keys: Sequence[str] = FILE_STREAM) -> DataFrame:
    """Like lower_bound_join, for the nearest record within epsilon; the earlier side on a tie."""
    order = ["ts_us", "side", *(c for c in ORDER[1:] if c not in keys)]
    width = bucket_width(records, keys, "ts_us")
    after = next_known(mixed(probes, records, keys, late=False), keys, order, F.col("hit"), "right", width=width)
    both = last_known(after, keys, order, F.col("hit"), "left", width=width).where(F.col("probe").isNotNull())
    left, right = F.col("ts_us") - F.col("left.ts_us"), F.col("right.ts_us") - F.col("ts_us")
    take_right = F.col("left").isNull() | (right < left)
    hit = F.when(take_right, F.col("right")).otherwise(F.col("left"))
    out = both.select(*keys, "ts_us", "probe", hit.alias("hit"))
    ok = F.abs(F.col("hit.ts_us") - F.col("ts_us")) <= epsilon_us
    return out.select(*keys, "ts_us", "probe", F.when(ok, F.col("hit.ts_us")).alias("hit_ts_us"), F.when(ok, F.col("hit.file_offset")).alias("hit_offset"))


def config_asof(records: DataFrame, value: str = "payload") -> DataFrame:
    """Data records with the configuration read last at or before them: config_ts_us, config."""
    known = F.when(F.col("record_type") == CONFIGURATION, F.struct(F.col("ts_us").alias("t"), F.col(value).alias("v")))
    rows = last_known(records, FILE_STREAM, ("ts_us", "file_offset"), known, "seen")
    return rows.where(F.col("record_type") == DATA).withColumn("config_ts_us", F.col("seen.t")).withColumn("config", F.col("seen.v")).drop("seen")


def index_numbers(records: DataFrame) -> DataFrame:
    """Adds index_number (in the file) and stream_index_number, both from 0."""
    out = numbered(records, ("file_id",), ORDER, "index_number")
    return numbered(out, FILE_STREAM, ORDER, "stream_index_number")


def kth_record(records: DataFrame, k: int, by_type: bool = True) -> DataFrame:
    """The k-th record, from 0, of each stream (and type); none where there are fewer."""
    keys = [*FILE_STREAM, "record_type"] if by_type else list(FILE_STREAM)
    return numbered(records, keys, ORDER, "_k").where(F.col("_k") == k).drop("_k")


def record_gaps(records: DataFrame) -> DataFrame:
    """Adds gap_us since the stream's record of the same type before; null for the first."""
    keys = [*FILE_STREAM, "record_type"]
    return previous(records, keys, ORDER, F.col("ts_us"), "_t").withColumn("gap_us", F.col("ts_us") - F.col("_t")).drop("_t")


def record_limits(records: DataFrame) -> DataFrame:
    """Adds next_offset: where the next record of the file starts, whatever its time."""
    turned = records.withColumn("_neg", -F.col("file_offset"))
    return previous(turned, ("file_id",), ("_neg",), F.col("file_offset"), "next_offset", ts="_neg").drop("_neg")


def streams_of_type(streams: DataFrame, type_id: int | None = None, flavor: str = "") -> DataFrame:
    """Streams of a type and flavor; no type or an empty flavor takes any."""
    if type_id is not None:
        streams = streams.where(F.col("type_id") == type_id)
    return streams.where(F.col("flavor") == flavor) if flavor else streams
