"""Catalog side tables, so that remote files needn't be opened for their index again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklode.sources.recording import RecordingSource


def save_catalog(spark: SparkSession, paths: str, folder: str) -> None:
    """Write files, streams and index of recordings as Parquet; the index is sorted by time."""
    spark.dataSource.register(RecordingSource)
    for table in ("files", "streams", "index"):
        df = spark.read.format("recording").option("table", table).load(paths)
        if table == "index":
            df = df.repartitionByRange("file_id", "ts_us").sortWithinPartitions("file_id", "ts_us")
        df.write.mode("overwrite").parquet(f"{folder}/{table}")


def catalog(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{folder}/{t}") for t in ("files", "streams", "index")}


def with_formats(formats: DataFrame, registry: DataFrame) -> DataFrame:
    """Formats found in files, and those of a registry for streams whose files lack them."""
    keys = ["type_id", "record_type", "format_version"]
    held = registry.select(*keys, F.col("blocks").alias("_known"))
    return formats.join(held, keys, "left").withColumn("blocks", F.coalesce("blocks", "_known")).drop("_known")
