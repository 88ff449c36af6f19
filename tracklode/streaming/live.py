"""Live recording: ordered flush behind a watermark, late records, retention.

Records of a stream arrive nearly in order.  A flush takes what is strictly before a
time; late records are appended and put in place when read (sorted on read), never
dropped.  Retention keeps, besides all recent records, the newest configuration and
state of each stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tracklode.model import CONFIGURATION, ORDER, STATE
from tracklode.operators.decimate import grace_window_us

KEYS = ("file_id", "type_id", "instance_id")


def flush_delay(grace_us: int, bucket_us: int = 0) -> str:
    """The watermark's delay: the wider of the grace window and a decimator's own."""
    return f"{max(grace_us, grace_window_us(bucket_us)) // 1000} milliseconds"


def write_live(records: DataFrame, folder: str, checkpoint: str, interval: str | None = None, once: bool = False) -> StreamingQuery:
    """Append a stream of records as Parquet, each batch in canonical order.

    Late records are appended like others; ``read_live`` puts them in their place.
    """

    def put(batch: DataFrame, _: int) -> None:
        batch.sortWithinPartitions(*ORDER).write.mode("append").partitionBy("file_id").parquet(folder)

    writer = records.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval or "1 second")
    return writer.start()


def read_live(spark, folder: str) -> DataFrame:
    """What was written, in canonical order."""
    return spark.read.parquet(folder).orderBy(*ORDER)


def ready(records: DataFrame, flush_us: int) -> DataFrame:
    """Records that a flush up to a time takes: strictly before it."""
    return records.where(F.col("ts_us") < flush_us)


def purged(records: DataFrame, before_us: int) -> DataFrame:
    """Drop records before a time, but keep each stream's newest configuration, newest state and all tags."""
    context = F.col("record_type").isin(CONFIGURATION, STATE)
    place = F.struct("ts_us", "file_offset")
    newest = records.where(context).groupBy(*KEYS, "record_type").agg(F.max(place).alias("newest"))
    met = records.join(newest, [*KEYS, "record_type"], "left")
    keep = (F.col("ts_us") >= before_us) | (F.col("record_type") == "tags") | (place == F.col("newest"))
    return met.where(F.coalesce(keep, F.lit(False))).drop("newest")


def latest_context(records: DataFrame) -> DataFrame:
    """Of a stream of records: each stream's newest configuration and state, as they change.

    State is one row per stream and type, whatever the stream's length.
    """
    out = ", ".join(f"{k} {records.schema[k].dataType.simpleString()}" for k in KEYS) + ", record_type string, ts_us long, file_offset long, payload string"

    def newest(key: tuple, pdfs: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        best = held
        for pdf in pdfs:
            row = pdf.sort_values(["ts_us", "file_offset"]).iloc[-1]
            now = (int(row["ts_us"]), int(row["file_offset"]), row["payload"])
            best = now if best is None or now[:2] >= tuple(best[:2]) else best
        if best != held:
            state.update(best)
            yield pd.DataFrame([(*key, *best)], columns=[*KEYS, "record_type", "ts_us", "file_offset", "payload"])

    context = records.where(F.col("record_type").isin(CONFIGURATION, STATE))
    return context.groupBy(*KEYS, "record_type").applyInPandasWithState(newest, out, "ts_us long, file_offset long, payload string", "update", "NoTimeout")


def live_counts(records: DataFrame, width: str, delay: str) -> DataFrame:
    """Records per stream and time window, final once the watermark has passed."""
    timed = records.withColumn("time", F.timestamp_micros("ts_us")).withWatermark("time", delay)
    return timed.groupBy(*KEYS, F.window("time", width).alias("w")).agg(F.count("*").alias("n")).select(*KEYS, F.col("w.start").alias("start"), "n")
