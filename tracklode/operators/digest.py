"""XXH64 digests of recordings, with the framing that recordings use.

Seed 0; strings are hashed with a NUL behind them, maps behind a signature; the
digest is sixteen hexadecimal digits.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Mapping

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklode.model import RECORD_TYPE_CODES
from tracklode.operators.ordered import dealt

# Fixed value of the format: what a map's digest starts with.
MAP_SIGNATURE = b"map<string, string>"


class Digest:
    """A running XXH64."""

    def __init__(self) -> None:
        self.state = xxhash.xxh64(seed=0)

    def raw(self, data: bytes) -> Digest:
        self.state.update(data)
        return self

    def text(self, value: str) -> Digest:
        return self.raw(value.encode("utf-8") + b"\0")

    def mapping(self, tags: Mapping[str, str]) -> Digest:
        self.raw(MAP_SIGNATURE)
        for k in sorted(tags):
            self.text(k).text(tags[k])
        return self

    def hex(self) -> str:
        return self.state.hexdigest()


def header_bytes(ts: float, version: int, size: int, type_id: int, instance: int, kind: str) -> bytes:
    """A record's header as it goes into a digest; ``instance`` is the stream's place in its type."""
    return struct.pack("<dIIHHB", ts, version, size, type_id, instance, RECORD_TYPE_CODES[kind])


@F.pandas_udf(T.StringType())
def bytes_checksum(data: pd.Series) -> pd.Series:
    """The digest of each payload."""
    return pd.Series([Digest().raw(x or b"").hex() for x in data])


def tags_checksum(tags: Mapping[str, str]) -> str:
    """The digest of ``name=value/`` over all tags in order."""
    return Digest().raw("".join(f"{k}={tags[k]}/" for k in sorted(tags)).encode("utf-8")).hex()


def stream_digests(records: DataFrame) -> DataFrame:
    """Per stream: n, and digests of its records' headers and of its payloads, in order.

    A digest is sequential by nature: a map over partitions sorted by stream feeds it,
    one Arrow batch in memory.  Without columns timestamp and format_version the time is
    that of ts_us and the version 0.
    """
    keys = ("file_id", "type_id", "instance_id")
    place = F.dense_rank().over(Window.partitionBy("file_id", "type_id").orderBy("instance_id"))
    streams = records.select(*keys).distinct().withColumn("place", place)
    payload = F.coalesce(F.col("payload").cast("binary"), F.lit(b""))
    time = F.col("timestamp") if "timestamp" in records.columns else F.col("ts_us") / F.lit(1e6)
    version = F.col("format_version") if "format_version" in records.columns else F.lit(0)
    rows = records.join(streams, list(keys)).select(*keys, "place", "record_type", time.alias("time"), version.alias("version"), "file_offset", payload.alias("payload"))
    schema = ", ".join(f"{k} {records.schema[k].dataType.simpleString()}" for k in keys) + ", n long, headers string, payloads string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, heads, bodies, n, kinds = None, None, None, 0, None

        def row() -> pa.RecordBatch:
            arrays = [pa.array([v], t) for v, t in zip(own, kinds)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([n], pa.int64()), pa.array([heads.hex()]), pa.array([bodies.hex()])], [*keys, "n", "headers", "payloads"])

        for batch in batches:
            kinds = [batch.schema.field(i).type for i in range(3)]
            for f, t, i, place, kind, ts, version, _, data in zip(*(c.to_pylist() for c in batch.columns)):
                if (f, t, i) != own:
                    if own is not None:
                        yield row()
                    own, heads, bodies, n = (f, t, i), Digest(), Digest(), 0
                heads.raw(header_bytes(ts, version, len(data), t, place, kind))
                bodies.raw(data)
                n += 1
        if own is not None:
            yield row()

    return dealt(rows, *keys).sortWithinPartitions(*keys, "time", "file_offset").mapInArrow(run, schema)


def checksums(records: DataFrame, streams: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, name, checksum: of the file's tags, of each stream's tags, headers and payloads, and of all of these (``checksum``).

    Streams that hold no record count with empty digests.  Per file, one row a stream comes to one
    task in order, which holds one Arrow batch and running digests.
    """
    keys = ["file_id", "type_id", "instance_id"]
    empty = Digest().hex()
    rows = streams.select(*keys, "user_tags", "private_tags").join(stream_digests(records), keys, "left")
    rows = rows.join(files.select("file_id", "tags"), "file_id").select(*keys, "user_tags", "private_tags", "tags", F.coalesce("headers", F.lit(empty)).alias("headers"), F.coalesce("payloads", F.lit(empty)).alias("payloads"))
    kind = streams.schema["file_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total, ids, nth, of_type, kinds = None, None, None, 0, None, None

        def table(found: list[tuple[str, str]], whose: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(whose, kinds), pa.array([n for n, _ in found], pa.string()), pa.array([c for _, c in found], pa.string())], ["file_id", "name", "checksum"])

        def done() -> pa.RecordBatch:
            return table([("checksum", total.text(ids.hex()).hex())], [own])

        for batch in batches:
            kinds, found, whose = batch.schema.field(0).type, [], []
            for f, t, i, user, private, tags, headers, payloads in zip(*(c.to_pylist() for c in batch.columns)):
                if total is None or f != own:
                    if total is not None:
                        yield done()
                    own, ids, of_type = f, Digest(), None
                    found.append(("filetags", tags_checksum(dict(tags))))
                    whose.append(f)
                    total = Digest().text(found[-1][1])
                mine = [("vrstags", tags_checksum(dict(private))), ("usertags", tags_checksum(dict(user))), ("headers", headers), ("payload", payloads)]
                for what, value in mine:
                    found.append((f"{t}-{i}_{what}", value))
                    whose.append(f)
                    total.text(value)
                nth = nth + 1 if t == of_type else 1
                of_type = t
                ids.raw(f"{t}-{nth}/".encode())
            yield table(found, whose)
        if total is not None:
            yield done()

    return dealt(rows, "file_id").sortWithinPartitions("file_id", "type_id", "instance_id").mapInArrow(run, f"file_id {kind}, name string, checksum string")
