"""Video streams: key frame groups, sequence checks, frame sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklode.model import DATA
from tracklode.operators.ordered import previous

FILE_STREAM = ("file_id", "type_id", "instance_id")


def in_sequence(frames: DataFrame) -> DataFrame:
    """frames(.., keyframe_ts_us, keyframe_index) -> adds decodable.

    A frame read in order can be decoded if it is a key frame, or follows the frame of
    the same group with the index before.
    """
    prior = previous(frames, FILE_STREAM, ("ts_us", "file_offset"), F.struct("keyframe_ts_us", "keyframe_index"), "_p")
    follows = (F.col("_p.keyframe_ts_us") == F.col("keyframe_ts_us")) & (F.col("keyframe_index") == F.col("_p.keyframe_index") + 1)
    return prior.withColumn("decodable", (F.col("keyframe_index") == 0) | F.coalesce(follows, F.lit(False))).drop("_p")


def keyframe_lookup(frames: DataFrame) -> DataFrame:
    """Each frame with the offset of its key frame (null if that is missing): keyframe_offset."""
    keys = frames.where("keyframe_index = 0").select(*FILE_STREAM, F.col("ts_us").alias("keyframe_ts_us"), F.col("file_offset").alias("keyframe_offset"))
    return frames.join(keys, [*FILE_STREAM, "keyframe_ts_us"], "left")


def frame_set(records: DataFrame, from_us: int) -> DataFrame:
    """Data records from a time on until a stream comes a second time.

    The second record of each stream is found by an aggregation; the set ends before the
    earliest of them.
    """
    data = records.where((F.col("record_type") == DATA) & (F.col("ts_us") >= from_us))
    place = F.struct("ts_us", "type_id", "instance_id", "file_offset")
    first = data.groupBy(*FILE_STREAM).agg(F.min(place).alias("first"))
    second = data.join(first, list(FILE_STREAM)).where(place > F.col("first")).groupBy("file_id").agg(F.min(place).alias("end"))
    met = data.join(second, "file_id", "left")
    return met.where(F.col("end").isNull() | (place < F.col("end"))).drop("end")
