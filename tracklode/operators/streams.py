"""Looking streams up: by type, flavor, name, tag, serial number, content."""

from __future__ import annotations

from collections.abc import Mapping

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklode.functions.text import tag
from tracklode.model import CONFIGURATION, DATA, StreamId
from tracklode.operators.filters import first_records

FILE_STREAM = ("file_id", "type_id", "instance_id")


def nth_stream(streams: DataFrame, type_id: int, n: int, flavor: str = "") -> DataFrame:
    """The n-th stream, from 0, of a type (and flavor) in each file."""
    own = streams.where(F.col("type_id") == type_id)
    own = own.where(F.col("flavor") == flavor) if flavor else own
    place = F.row_number().over(Window.partitionBy("file_id").orderBy("instance_id"))
    return own.withColumn("_n", place).where(F.col("_n") == n + 1).drop("_n")


def stream_by_name(streams: DataFrame, name: str) -> DataFrame:
    """``T-I``, or ``T+N`` with N from 1."""
    if s := StreamId.parse(name):
        return streams.where((F.col("type_id") == s.type_id) & (F.col("instance_id") == s.instance_id))
    type_id, _, n = name.partition("+")
    return nth_stream(streams, int(type_id), int(n) - 1) if type_id.isdigit() and n.isdigit() and int(n) > 0 else streams.limit(0)


def first_stream(streams: DataFrame) -> DataFrame:
    """The first stream of each file."""
    rest = [c for c in streams.columns if c not in ("file_id",)]
    best = streams.groupBy("file_id").agg(F.min_by(F.struct(*rest), F.struct("type_id", "instance_id")).alias("_s"))
    return best.select("file_id", "_s.*")


def stream_by_tag(streams: DataFrame, name: str, value: str) -> DataFrame:
    """The first stream of each file whose user tag has a value."""
    return first_stream(streams.where(tag(F.col("user_tags"), name) == value))


def stream_by_serial(streams: DataFrame, serial: str) -> DataFrame:
    return first_stream(streams.where(F.col("serial_number") == serial))


def record_formats(streams: DataFrame) -> DataFrame:
    """Formats in private tags ``RF:Type:version``: stream columns, record_type, format_version, blocks."""
    rows = streams.select(*FILE_STREAM, F.explode("private_tags").alias("name", "blocks")).where(F.col("name").rlike(r"^RF:\w+:\d+$"))
    part = F.split("name", ":")
    return rows.select(*FILE_STREAM, F.lower(part[1]).alias("record_type"), part[2].cast("int").alias("format_version"), F.split("blocks", r"\+").alias("blocks"))


def layouts(streams: DataFrame) -> DataFrame:
    """Layouts in private tags ``DL:Type:version:block``."""
    rows = streams.select(*FILE_STREAM, F.explode("private_tags").alias("name", "layout")).where(F.col("name").rlike(r"^DL:\w+:\d+:\d+$"))
    part = F.split("name", ":")
    return rows.select(*FILE_STREAM, F.lower(part[1]).alias("record_type"), part[2].cast("int").alias("format_version"), part[3].cast("int").alias("block"), "layout")


def might_contain(streams: DataFrame, records: DataFrame, kind: str) -> DataFrame:
    """Streams with a format that has a block of ``kind`` and at least one data record."""
    formats = record_formats(streams).where(F.exists("blocks", lambda b: b.startswith(kind))).select(*FILE_STREAM).distinct()
    data = records.where(F.col("record_type") == DATA).select(*FILE_STREAM)
    return formats.join(data, list(FILE_STREAM), "left_semi")


def first_configurations(records: DataFrame) -> DataFrame:
    """The first configuration of each stream."""
    return first_records(records.where(F.col("record_type") == CONFIGURATION))


def new_instances(streams: DataFrame) -> DataFrame:
    """Adds new_instance: a counter from 1 for each type, in canonical order of files."""
    place = F.row_number().over(Window.partitionBy("type_id").orderBy("file_id", "instance_id"))
    return streams.withColumn("new_instance", place)


#: Bytes of user tags that a serial number takes in.
MOST_TAG_BYTES = 2000


def serial_number(file_tags: Mapping[str, str], user: Mapping[str, str], private: Mapping[str, str], place: StreamId) -> str:
    """A serial for a stream without one, from its tags and its place among streams of its type."""
    from tracklode.operators.digest import Digest

    held, size = {}, 0
    for k in sorted(user):
        size += len(k) + len(user[k])
        if size > MOST_TAG_BYTES:
            break
        held[k] = user[k]
    d = Digest().mapping(file_tags).mapping(held).mapping(private)
    return xxhash.xxh64(f"{d.hex()}{place}", seed=0).hexdigest()
