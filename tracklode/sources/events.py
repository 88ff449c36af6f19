"""Adapters that present ordinary event tables as recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklode.model import stream_name

#: Bytes that a record's header takes in a recording.
HEADER_BYTES = 32

RECORDS_SQL = """
rec AS (
  SELECT event_id % 2 AS file_id, CAST(200 + user_id % 5 AS INT) AS type_id, CAST(user_id // 5 + 1 AS INT) AS instance_id,
         CAST(200 + user_id % 5 AS VARCHAR) || '-' || CAST(user_id // 5 + 1 AS VARCHAR) AS stream_id,
         CASE event_type WHEN 'signup' THEN 'configuration' WHEN 'error' THEN 'state' ELSE 'data' END AS record_type,
         epoch_us(ts) AS ts_us, event_id AS file_offset, 32 + length(coalesce(props, '')) AS record_size,
         props AS payload, value
  FROM events
)"""


def micros(ts: str) -> F.Column:
    """Microseconds since the epoch of a timestamp without time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as two recordings of up to 150 streams."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_type") == "signup", "configuration").when(F.col("event_type") == "error", "state").otherwise("data")
    return e.select(
        (F.col("event_id") % 2).alias("file_id"),
        (F.lit(200) + F.col("user_id") % 5).cast("int").alias("type_id"),
        (F.floor(F.col("user_id") / 5) + 1).cast("int").alias("instance_id"),
        kind.alias("record_type"),
        micros("ts").alias("ts_us"),
        F.col("event_id").alias("file_offset"),
        (F.length(F.coalesce("props", F.lit(""))) + HEADER_BYTES).cast("long").alias("record_size"),
        F.col("props").alias("payload"),
        "value",
    ).withColumn("stream_id", stream_name())


ITEMS_SQL = """
item AS (
  SELECT 0 AS file_id, CAST(300 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS INT) AS type_id,
         CAST(CASE l_linestatus WHEN 'F' THEN 1 ELSE 2 END AS INT) AS instance_id,
         CASE WHEN l_linenumber = 1 THEN 'configuration' WHEN l_linenumber = 2 THEN 'state' ELSE 'data' END AS record_type,
         epoch_us(l_shipdate) AS ts_us, l_orderkey * 8 + l_linenumber AS file_offset, l_quantity AS value
  FROM lineitem
)"""


def item_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``lineitem`` table as one recording of six streams with many equal times."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    kind = F.when(F.col("l_linenumber") == 1, "configuration").when(F.col("l_linenumber") == 2, "state").otherwise("data")
    return t.select(
        F.lit(0).alias("file_id"),
        (F.lit(300) + flag).cast("int").alias("type_id"),
        F.when(F.col("l_linestatus") == "F", 1).otherwise(2).cast("int").alias("instance_id"),
        kind.alias("record_type"),
        micros("l_shipdate").alias("ts_us"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("file_offset"),
        F.col("l_quantity").alias("value"),
    )
