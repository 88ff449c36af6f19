"""Exports of a selection: metadata as JSON lines, images, sound, verbatim checksums."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import closing

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklode.functions import media
from tracklode.operators.ordered import dealt
from tracklode.sources.recording import LZ4, NONE, ZSTD, Chunks, opened, packed


def put_file(path: str, data: bytes) -> None:
    """Write a file under another name, then move it to its place."""
    fs, p = opened(path)
    fs.create_dir(p.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(p + ".part") as out:
        out.write(data)
    fs.move(p + ".part", p)


def metadata_lines(records: DataFrame, value: str) -> DataFrame:
    """One JSON text per record: where it stands, then the decoded ``value``."""
    where = F.struct("stream_id", "record_type", "ts_us", "file_offset")
    return records.select("file_id", "ts_us", "file_offset", F.to_json(F.struct(where.alias("record"), F.col(value).alias("content"))).alias("line"))


def export_images(frames: DataFrame, folder: str) -> DataFrame:
    """frames(stream_id, number, timestamp, pixel, width, height, stride, payload) -> path, bytes of each PNG."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            out = []
            for r in pdf.itertuples():
                pixels = media.normalised(r.payload, r.pixel, r.width, r.height, r.stride)
                data = media.png_bytes(pixels)
                path = f"{folder}/{media.image_name(r.stream_id, r.number, r.timestamp, 'png')}"
                put_file(path, data)
                out.append((path, len(data)))
            yield pd.DataFrame(out, columns=["path", "bytes"])

    return frames.select("stream_id", "number", "timestamp", "pixel", "width", "height", "stride", "payload").mapInPandas(run, "path string, bytes long")


#: A sound file ends before it reaches this many bytes.
MOST_WAV = 1 << 32


def export_audio(blocks: DataFrame, folder: str) -> DataFrame:
    """blocks(stream_id, segment, ts_us, sample, channels, rate, payload) -> path, n of each WAV file.

    A segment's blocks come sorted to one task; its sound is held until it is written,
    and a new file starts where the format's own limit would be passed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, held, form = None, 0, [], None

        def done() -> pa.RecordBatch:
            path = f"{folder}/{own[0]}-{own[1]:03d}-{part:03d}.wav"
            put_file(path, media.wav_bytes(b"".join(held), *form))
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(held)], pa.int64())], ["path", "n"])

        size = 0
        for batch in batches:
            for stream, segment, _, sample, channels, rate, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if own != (stream, segment) or size + len(payload) >= MOST_WAV - 64:
                    if held:
                        yield done()
                    part = part + 1 if own == (stream, segment) else 0
                    own, held, form, size = (stream, segment), [], (sample, channels, rate), 0
                held.append(payload)
                size += len(payload)
        if held:
            yield done()

    rows = blocks.select("stream_id", "segment", "ts_us", "sample", "channels", "rate", "payload")
    return dealt(rows, "stream_id", "segment").sortWithinPartitions("stream_id", "segment", "ts_us").mapInArrow(run, "path string, n long")


READ_UNIT = 4 << 20


def file_checksums(paths: DataFrame) -> DataFrame:
    """paths(path) -> path, size, digest of the bytes, read in pieces."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            out = []
            for path in pdf["path"]:
                fs, p = opened(path)
                state, size = xxhash.xxh64(seed=0), 0
                with fs.open_input_stream(p) as f:
                    while chunk := f.read(READ_UNIT):
                        state.update(chunk)
                        size += len(chunk)
                out.append((path, size, state.hexdigest()))
            yield pd.DataFrame(out, columns=["path", "size", "digest"])

    return paths.select("path").repartition("path").mapInPandas(run, "path string, size long, digest string")


def compare_verbatim(spark: SparkSession, left: str, right: str) -> DataFrame:
    """One row: left_size, right_size, same, first_difference (null where the bytes agree as far as both go).

    Tasks read blocks of READ_UNIT bytes of both recordings, all their chunks.
    """
    a, b = Chunks(left), Chunks(right)
    sizes, shared = (a.size, b.size), min(a.size, b.size)
    a.close()
    b.close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with closing(Chunks(left)) as x, closing(Chunks(right)) as y:
            for batch in batches:
                found = []
                for k in batch.column(0).to_pylist():
                    at = k * READ_UNIT
                    n = min(READ_UNIT, shared - at)
                    p, q = (np.frombuffer(f.read_at(n, at), np.uint8) for f in (x, y))
                    if (other := np.flatnonzero(p != q)).size:
                        found.append(at + int(other[0]))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["at"])

    first = spark.range(-(-shared // READ_UNIT)).mapInArrow(run, "at long").agg(F.min("at").alias("first_difference"))
    same = F.col("first_difference").isNull() & F.lit(sizes[0] == sizes[1])
    return first.select(F.lit(sizes[0]).cast("long").alias("left_size"), F.lit(sizes[1]).cast("long").alias("right_size"), same.alias("same"), "first_difference")


# Compression presets by name, as (kind, level).
PRESETS = {"none": (NONE, 0), "lz4": (LZ4, 0), "zstd-faster": (ZSTD, -1), "zstd-light": (ZSTD, 1), "zstd-medium": (ZSTD, 3), "zstd-high": (ZSTD, 7), "zstd-12": (ZSTD, 12), "zstd-15": (ZSTD, 15), "zstd-18": (ZSTD, 18), "zstd-tight": (ZSTD, 20)}


def compression_benchmark(records: DataFrame, presets: tuple[str, ...] = ("none", "lz4", "zstd-light", "zstd-medium")) -> DataFrame:
    """Per preset: n, bytes before and after, ratio and MB a second."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            out = []
            for name in presets:
                start = time.perf_counter()
                after = sum(len(packed(p, *PRESETS[name])[0]) for p in pdf["payload"])
                out.append((name, len(pdf), int(pdf["payload"].map(len).sum()), after, time.perf_counter() - start))
            yield pd.DataFrame(out, columns=["preset", "n", "before", "after", "s"])

    rows = records.select(F.coalesce(F.col("payload").cast("binary"), F.lit(b"")).alias("payload")).mapInPandas(run, "preset string, n long, before long, after long, s double")
    out = rows.groupBy("preset").agg(*(F.sum(c).alias(c) for c in ("n", "before", "after", "s")))
    return out.select("preset", "n", "before", "after", (F.col("before") / F.col("after")).alias("ratio"), (F.col("before") / 1e6 / F.col("s")).alias("mb_s"))
