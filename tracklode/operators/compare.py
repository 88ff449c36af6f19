"""Comparing two recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stream_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """The n-th stream of a type on the left with the n-th on the right.

    type_id, place, left_instance, right_instance; one side is null where the other
    has more streams.
    """

    def placed(records: DataFrame, name: str) -> DataFrame:
        streams = records.select("type_id", "instance_id").distinct()
        place = F.row_number().over(Window.partitionBy("type_id").orderBy("instance_id"))
        return streams.select("type_id", place.alias("place"), F.col("instance_id").alias(name))

    return placed(left, "left_instance").join(placed(right, "right_instance"), ["type_id", "place"], "full")


def compare_records(left: DataFrame, right: DataFrame, strict: bool = False) -> DataFrame:
    """Per pair of streams: n_left, n_matched, n_different, n_missing (and n_extra if strict).

    A record matches one of the same stream, time and type with an equal payload.
    Records on the right only are reported where ``strict``.
    """
    pairs = stream_pairs(left, right)
    digest = F.sha2(F.coalesce(F.col("payload").cast("binary"), F.lit(b"")), 256)
    place = ["type_id", "place", "record_type", "ts_us"]

    def sided(records: DataFrame, instance: str, name: str) -> DataFrame:
        rows = records.join(pairs.select("type_id", "place", F.col(instance).alias("instance_id")), ["type_id", "instance_id"])
        return rows.groupBy(*place, digest.alias("digest")).agg(F.count("*").alias(f"n_{name}"))

    # Equal payloads at one place are counted on each side, so repeats match one to one.
    met = sided(left, "left_instance", "l").join(sided(right, "right_instance", "r"), [*place, "digest"], "full")
    n_l, n_r = F.coalesce("n_l", F.lit(0)), F.coalesce("n_r", F.lit(0))
    at = met.groupBy(*place).agg(F.sum(n_l).alias("l"), F.sum(n_r).alias("r"), F.sum(F.least(n_l, n_r)).alias("same"))
    both = (F.col("l") > 0) & (F.col("r") > 0)
    out = at.groupBy("type_id", "place").agg(
        F.sum("l").alias("n_left"),
        F.sum("same").cast("long").alias("n_matched"),
        F.sum(F.when(both, F.col("l") - F.col("same")).otherwise(0)).cast("long").alias("n_different"),
        F.sum(F.when(F.col("r") == 0, F.col("l")).otherwise(0)).alias("n_missing"),
        F.sum(F.when(F.col("l") == 0, F.col("r")).otherwise(0)).alias("n_extra"),
    )
    return out if strict else out.drop("n_extra")


def compare_tags(left: DataFrame, right: DataFrame) -> DataFrame:
    """streams(type_id, instance_id, user_tags, private_tags) on both sides -> type_id, place, name, left_value, right_value of tags that differ."""
    pairs = stream_pairs(left, right)

    def sided(streams: DataFrame, instance: str, name: str) -> DataFrame:
        rows = streams.join(pairs.select("type_id", "place", F.col(instance).alias("instance_id")), ["type_id", "instance_id"])
        return rows.select("type_id", "place", F.explode(F.map_concat(F.transform_keys("user_tags", lambda k, _: F.concat(F.lit("user/"), k)), F.transform_keys("private_tags", lambda k, _: F.concat(F.lit("private/"), k)))).alias("name", name))

    met = sided(left, "left_instance", "left_value").join(sided(right, "right_instance", "right_value"), ["type_id", "place", "name"], "full")
    return met.where(~F.col("left_value").eqNullSafe(F.col("right_value")))
