"""Binary recordings as a Spark data source and sink.

A file is a header, a description record (tags), records, and an index record.  The
reader's driver side goes through header, description and index, a block at a time, and
keeps only where a task's part of them stands; its tasks
read ranges of records of about ``SPLIT`` bytes, neighbours by one read, so one file of
many terabytes feeds many tasks.  A compressed index is held whole.  Filters on time, type, instance and record type are held
against the index, and records that they leave out are never read, with option
``pushdown`` and ``spark.sql.python.filterPushdown.enabled`` set; Spark keeps the filters pushed last for
all scans of one ``load``, so the option is for a load that is scanned once.  A file without a usable index is walked once,
record header by record header.

The format has 16 bits for an instance.  A stream with a larger one is stored with a negative
type, which no stream of the format has, that holds the upper bits (``stored_id``).  A recording may be cut into chunks, ``name``, ``name_1``,
``name_2`` …, and its index may stand before the records.  Paths are opened through pyarrow's file systems, so
stores work as well as local folders.

Table ``records`` fails at a damaged record; ``checked`` has the same columns and ``ok``,
false where a record isn't the one of the index or can't be unpacked.

    spark.dataSource.register(RecordingSource)
    spark.read.format("recording").load("/data/*.rec")
    spark.read.format("recording").option("table", "streams").load(path)
"""

from __future__ import annotations

import glob
import json
import os
import re
import struct
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tracklode.operators.ordered import dealt

# Fixed values of the file format.
MAGIC = (0x69736956, 0x65526E6F, 0x64726F63)
VERSIONS = (0x31535256, 0x32535256, 0x33535256)
HEADER = struct.Struct("<IIQIIqqqQQQII")
RECORD = struct.Struct("<IIiIdHBBI")
STREAM_ID = struct.Struct("<iH")
INDEX_ENTRY = struct.Struct("<dIBiH")
KINDS = {1: "state", 2: "configuration", 3: "data", 4: "tags"}
CODES = {name: n for n, name in KINDS.items()}
INDEX_TYPE, DESCRIPTION_TYPE = 1, 2
INDEX_VERSION, SPLIT_INDEX_VERSION, DESCRIPTION_VERSION = 2, 3, 2
NONE, LZ4, ZSTD = 0, 1, 2
#: Ends of the names of private tags.
FLAVOR, ORIGINAL_NAME, SERIAL = "_Recordable_Flavor", "_Original_Recordable_Name", "_Serial_Number"
SPLIT = 64 << 20
#: Records that one task reads at most, however small.
SPLIT_RECORDS = 1 << 17
#: Entries of an index that are read at a time, and records of an Arrow batch at most.
INDEX_ROWS, BATCH_ROWS = 1 << 20, 1 << 15
#: Streams that one task reads.
STREAM_ROWS = 8192
#: Payloads below this many bytes are never compressed.
LEAST_COMPRESSED = 250

RECORDS = T.StructType(
    [
        T.StructField("file_id", T.StringType()), T.StructField("type_id", T.IntegerType()), T.StructField("instance_id", T.IntegerType()), T.StructField("stream_id", T.StringType()),
        T.StructField("record_type", T.StringType()), T.StructField("format_version", T.LongType()), T.StructField("timestamp", T.DoubleType()), T.StructField("ts_us", T.LongType()),
        T.StructField("file_offset", T.LongType()), T.StructField("record_size", T.LongType()), T.StructField("compression", T.IntegerType()), T.StructField("payload", T.BinaryType()),
    ]
)
TAGS = T.MapType(T.StringType(), T.StringType())
STREAMS = T.StructType(
    [
        T.StructField("file_id", T.StringType()), T.StructField("type_id", T.IntegerType()), T.StructField("instance_id", T.IntegerType()), T.StructField("stream_id", T.StringType()),
        T.StructField("original_name", T.StringType()), T.StructField("flavor", T.StringType()), T.StructField("serial_number", T.StringType()),
        T.StructField("user_tags", TAGS), T.StructField("private_tags", TAGS),
    ]
)
FILES = T.StructType([T.StructField("file_id", T.StringType()), T.StructField("total_size", T.LongType()), T.StructField("creation_id", T.DecimalType(20, 0)), T.StructField("tags", TAGS), T.StructField("has_index", T.BooleanType())])
TABLES = {"records": RECORDS, "checked": T.StructType([*RECORDS, T.StructField("ok", T.BooleanType())]), "index": T.StructType([f for f in RECORDS if f.name != "payload"]), "streams": STREAMS, "files": FILES}


class Damaged(ValueError):
    """A file that isn't a recording, or a part of one that can't be read."""


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), os.path.abspath(path))


def following(place: str, n: int) -> str:
    """The place of chunk ``n``, from 1, of the recording that starts at ``place``."""
    return f"{place[:-1] if place.endswith('_0') else place + '_'}{n}"


def starts(places: list[str]) -> list[str]:
    """The places without those that are later chunks of another one."""
    known = set(places)

    def later(place: str) -> bool:
        m = re.fullmatch(r"(.+)_([1-9]\d*)", place)
        return m is not None and (m[1] in known or m[1] + "_0" in known)

    return [p for p in places if not later(p)]


class Chunks:
    """The chunks of a recording, read as one file."""

    def __init__(self, path: str) -> None:
        self.fs, first = opened(path)
        self.parts = [(0, self.fs.get_file_info(first).size, first)]  # start, size, place
        while True:
            info = self.fs.get_file_info(following(first, len(self.parts)))
            if info.type != pafs.FileType.File:
                break
            self.parts.append((self.size, info.size, info.path))
        self.files: dict[str, pa.NativeFile] = {}

    @property
    def size(self) -> int:
        return self.parts[-1][0] + self.parts[-1][1]

    def read_at(self, n: int, at: int) -> bytes:
        out = []
        for start, size, place in self.parts:
            lo, hi = max(at, start), min(at + n, start + size)
            if lo < hi:
                if place not in self.files:
                    self.files[place] = self.fs.open_input_file(place)
                out.append(self.files[place].read_at(hi - lo, lo - start))
        return out[0] if len(out) == 1 else b"".join(out)

    def close(self) -> None:
        for f in self.files.values():
            f.close()


@dataclass
class Header:
    creation_id: int
    header_size: int
    record_header_size: int
    index_at: int
    description_at: int
    first_record_at: int

    @classmethod
    def read(cls, data: bytes) -> Header:
        if len(data) < HEADER.size:
            raise Damaged("shorter than a header")
        m1, m2, creation, size, record_size, index, description, first, _, _, _, m3, version = HEADER.unpack_from(data)
        if (m1, m2, m3) != MAGIC:
            raise Damaged("no recording")
        if version not in VERSIONS or size < HEADER.size or record_size < RECORD.size:
            raise Damaged("a format that isn't known")
        return cls(creation, size, record_size, index, description, first)


def is_recording(path: str) -> bool:
    fs, p = opened(path)
    try:
        with fs.open_input_file(p) as f:
            Header.read(f.read_at(HEADER.size, 0))
    except (Damaged, OSError):
        return False
    return True


def stored_id(type_id: int, instance: int) -> tuple[int, int]:
    """A stream's type and instance as the 32 and 16 bits that a file has for them.

    Of the 32 a type takes 16.  An instance beyond 65535 has its upper 15 bits above these, and the sign is set.
    """
    if instance <= 0xFFFF:
        return type_id, instance
    if not 0 <= type_id <= 0xFFFF:
        raise ValueError(f"a file can't hold stream {type_id}-{instance}")
    return (instance >> 16 << 16 | type_id) - (1 << 31), instance & 0xFFFF


def stream_key(type_id: int, instance: int) -> tuple[int, int]:
    """Type and instance of a stored id."""
    if type_id >= 0:
        return type_id, instance
    wide = type_id + (1 << 31)
    return wide & 0xFFFF, wide >> 16 << 16 | instance


def stream_keys(types: np.ndarray, instances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``stream_key`` of arrays."""
    if not (types < 0).any():
        return types.astype("<i4"), instances.astype("<i4")
    wide = types.astype(np.int64) + (1 << 31)
    return np.where(types < 0, wide & 0xFFFF, types).astype("<i4"), (np.where(types < 0, wide >> 16 << 16, 0) | instances).astype("<i4")


class Cursor:
    """Counted strings and maps of a description."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def number(self) -> int:
        if self.at + 4 > len(self.data):
            raise Damaged("a description that ends early")
        self.at += 4
        return struct.unpack_from("<I", self.data, self.at - 4)[0]

    def text(self) -> str:
        n = self.number()
        if self.at + n > len(self.data):
            raise Damaged("a description that ends early")
        self.at += n
        return self.data[self.at - n : self.at].decode("utf-8", "replace")

    def tags(self) -> dict[str, str]:
        return {self.text(): self.text() for _ in range(self.number())}

    def pass_tags(self) -> None:
        for _ in range(2 * self.number()):
            n = self.number()
            self.at += n

    def stream(self) -> tuple[int, int]:
        if self.at + STREAM_ID.size > len(self.data):
            raise Damaged("a description that ends early")
        self.at += STREAM_ID.size
        return stream_key(*STREAM_ID.unpack_from(self.data, self.at - STREAM_ID.size))


@dataclass
class Stream:
    user: dict[str, str] = field(default_factory=dict)
    private: dict[str, str] = field(default_factory=dict)

    def private_tag(self, end: str) -> str:
        return next((v for k, v in self.private.items() if k.endswith(end)), "")


def read_description(payload: bytes, version: int) -> tuple[dict[tuple[int, int], Stream], dict[str, str]]:
    c = Cursor(payload)
    if version == DESCRIPTION_VERSION:
        streams = {c.stream(): Stream(c.tags(), c.tags()) for _ in range(c.number())}
        return streams, c.tags()
    if version == 1:  # JSON with a name and tags
        streams = {}
        for _ in range(c.number()):
            key, held = c.stream(), json.loads(c.text())
            streams[key] = Stream({k: v for k, v in held.get("tags", {}).items() if isinstance(v, str)}, {ORIGINAL_NAME.lstrip("_"): held.get("name", "")})
        return streams, json.loads(c.text() or "{}")
    raise Damaged("a description of an unknown version")


def unpacked(data: bytes, kind: int, size: int) -> bytes:
    """A payload as it was before compression."""
    if kind == NONE:
        return data
    if kind == ZSTD:
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    if kind == LZ4:
        return pa.CompressedInputStream(pa.BufferReader(data), "lz4").read(size)
    raise Damaged(f"compression {kind}")


def packed(data: bytes, kind: int, level: int = 3) -> tuple[bytes, int]:
    """(bytes, compression): compressed if that is asked for, worth it and smaller."""
    if kind == NONE or len(data) < LEAST_COMPRESSED:
        return data, NONE
    if kind == ZSTD:
        import zstandard

        out = zstandard.ZstdCompressor(level=level).compress(data)
    else:
        sink = pa.BufferOutputStream()
        with pa.CompressedOutputStream(sink, "lz4") as s:
            s.write(data)
        out = sink.getvalue().to_pybytes()
    return (out, kind) if len(out) < len(data) else (data, NONE)


#: An index entry as it is stored, and with the place of its record.
STORED = np.dtype([("ts", "<f8"), ("size", "<u4"), ("kind", "u1"), ("type_id", "<i4"), ("instance_id", "<u2")])
ENTRY = np.dtype([*STORED.descr[:-1], ("instance_id", "<i4"), ("at", "<i8")])
#: ``RECORD`` for arrays.
HEAD = np.dtype([("size", "<u4"), ("before", "<u4"), ("type_id", "<i4"), ("version", "<u4"), ("ts", "<f8"), ("instance_id", "<u2"), ("kind", "u1"), ("how", "u1"), ("unpacked", "<u4")])
#: The most that one read takes in.
READ = 8 << 20
#: Columns whose filters the index can answer, and how.
ANSWERED = {
    "ts_us": lambda e: np.rint(e["ts"] * 1e6).astype(np.int64), "timestamp": lambda e: e["ts"], "type_id": lambda e: e["type_id"].astype(np.int64),
    "instance_id": lambda e: e["instance_id"].astype(np.int64), "record_type": lambda e: np.array([KINDS.get(k, "") for k in range(256)])[e["kind"]],
}
TESTS = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}


def placed(stored: np.ndarray, first: int) -> np.ndarray:
    """Stored entries with the ids of their streams and their offsets, the first of which is ``first``."""
    out = np.zeros(len(stored), ENTRY)
    for name in ("ts", "size", "kind"):
        out[name] = stored[name]
    out["type_id"], out["instance_id"] = stream_keys(stored["type_id"], stored["instance_id"])
    out["at"] = first + np.cumsum(stored["size"], dtype=np.int64) - stored["size"]
    return out


def chosen(entries: np.ndarray, asked: list[tuple[str, type, object]]) -> np.ndarray:
    """Which entries are records that filters leave."""
    keep = np.isin(entries["kind"], [k for k, name in KINDS.items() if name != "tags"])
    for name, kind, value in asked:
        own = ANSWERED[name](entries)
        keep &= np.isin(own, list(value)) if kind is In else TESTS[kind](own, value)
    return keep


def cuts(entries: np.ndarray) -> np.ndarray:
    """Where the entries of another task begin."""
    part = np.cumsum(entries["size"], dtype=np.int64) // SPLIT
    return np.flatnonzero(np.diff(part) | np.diff(np.arange(len(entries)) // SPLIT_RECORDS)) + 1


@dataclass
class Place:
    """Where uncompressed entries of an index stand, and how many."""

    at: int
    n: int


class Recording:
    """The catalog side of one file."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.file = Chunks(path)
        self.size = self.file.size
        self.header = Header.read(self.file.read_at(HEADER.size, 0))
        self.described_at = self.header.description_at or self.header.header_size
        self.described = self.head(self.described_at)
        self.first = self.header.first_record_at or self.described_at + self.described[0]

    def head(self, at: int) -> tuple:
        raw = self.file.read_at(self.header.record_header_size, at)
        if len(raw) < self.header.record_header_size:
            raise Damaged(f"no record at {at}")
        head = RECORD.unpack_from(raw)
        if head[0] < self.header.record_header_size:
            raise Damaged(f"no record at {at}")
        return head

    def description(self) -> bytes:
        return self.file.read_at(self.described[0] - self.header.record_header_size, self.described_at + self.header.record_header_size)

    def parts(self) -> tuple[list[InputPartition], dict[str, str]]:
        """The streams, in parts of ``STREAM_ROWS``, and the file's tags.

        Streams in order of their ids are left in the file for the tasks.
        """
        payload, begin = self.description(), self.described_at + self.header.record_header_size
        if self.described[3] == DESCRIPTION_VERSION:
            c, out, before = Cursor(payload), [], (-1, -1)
            n = c.number()
            for k in range(n):
                if k % STREAM_ROWS == 0:
                    out.append(c.at)
                key = c.stream()
                if key <= before:
                    break
                before = key
                c.pass_tags()
                c.pass_tags()
            else:
                ends = [*out[1:], c.at]
                return [Described(self.path, begin + lo, hi - lo, min(STREAM_ROWS, n - k * STREAM_ROWS)) for k, (lo, hi) in enumerate(zip(out, ends))], c.tags()
        streams, tags = read_description(payload, self.described[3])
        rows = [stream_row(self.path, key, s) for key, s in sorted(streams.items())]
        return [Rows(rows[k : k + STREAM_ROWS]) for k in range(0, len(rows), STREAM_ROWS)], tags

    def found_index(self) -> Place | np.ndarray | None:
        """Where the entries of the index stand, or these, in file order, where they are compressed; None if there is no usable one."""
        try:
            if self.header.index_at <= 0:
                return None
            head = self.head(self.header.index_at)
            if head[2] == INDEX_TYPE and head[3] == SPLIT_INDEX_VERSION:
                return self.split_index(head)
            if head[2] != INDEX_TYPE or head[3] != INDEX_VERSION:
                return None
            begin = self.header.index_at + self.header.record_header_size
            end = min(self.header.index_at + head[0], self.size)
            at = begin + 4 + struct.unpack("<I", self.file.read_at(4, begin))[0] * STREAM_ID.size
            count, at = struct.unpack("<I", self.file.read_at(4, at))[0], at + 4
            if head[7] == NONE:
                return Place(at, count) if at + count * STORED.itemsize <= end else None
            data = unpacked(self.file.read_at(max(end - at, 0), at), head[7], count * STORED.itemsize)
            return self.within(np.frombuffer(data, STORED, count))
        except (Damaged, struct.error, OSError, ValueError):
            return None

    def split_index(self, head: tuple) -> Place | np.ndarray | None:
        """The index that stands before the records, as far as it was written.

        A recording that wasn't closed tells neither the index's size nor where records
        start; the end of the first chunk then tells both.
        """
        begin = self.header.index_at + self.header.record_header_size
        size, end = head[0] - self.header.record_header_size, self.file.parts[0][1]
        first = self.header.first_record_at
        if begin > end or (size == 0 and first == 0 and len(self.file.parts) == 1):
            return None
        self.first = min(first, end) if first else end
        last = max(min(begin + size if size else end, self.first), begin)

        def usable(stored: np.ndarray) -> bool:
            return not (stored["size"] < self.header.record_header_size).any() and bool(np.isin(stored["kind"], list(KINDS)).all())

        if head[7] == NONE:
            place = Place(begin, (last - begin) // STORED.itemsize)
            return place if all(usable(stored) for _, stored in self.stored(place)) else None
        data = self.file.read_at(last - begin, begin)
        if head[7] == ZSTD:  # frames, one after the other
            import zstandard

            data = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        else:
            data = unpacked(data, head[7], head[8])
        stored = np.frombuffer(data, STORED, len(data) // STORED.itemsize)
        return self.within(stored) if usable(stored) else None

    def within(self, stored: np.ndarray) -> np.ndarray:
        """Entries with their offsets, up to the end of a cut file."""
        out = placed(stored, self.first)
        return out[: np.searchsorted(out["at"] + out["size"], self.size, side="right")]

    def stored(self, place: Place) -> Iterator[tuple[int, np.ndarray]]:
        """Number of the first one and entries as they are stored, a block at a time."""
        for lo in range(0, place.n, INDEX_ROWS):
            n = min(INDEX_ROWS, place.n - lo)
            yield lo, np.frombuffer(self.file.read_at(n * STORED.itemsize, place.at + lo * STORED.itemsize), STORED)

    def blocks(self, place: Place) -> Iterator[tuple[int, np.ndarray]]:
        """Number of the first one and entries of the index with their offsets, a block at a time, up to the end of a cut file."""
        first = self.first
        for lo, stored in self.stored(place):
            out = placed(stored, first)
            ends = out["at"] + out["size"]
            n = int(np.searchsorted(ends, self.size, side="right"))
            yield lo, out[:n]
            if n < len(out):
                return
            first = int(ends[-1])

    def index(self) -> np.ndarray | None:
        """All entries of the index in file order; None if there is no usable one."""
        found = self.found_index()
        return np.concatenate([np.zeros(0, ENTRY), *(e for _, e in self.blocks(found))]) if isinstance(found, Place) else found

    def walk(self) -> np.ndarray:
        """Entries found by walking record headers, in order of time; stops where the chain breaks."""
        out, at, before = [], self.first, None
        while at + self.header.record_header_size <= self.size:
            head = RECORD.unpack_from(self.file.read_at(self.header.record_header_size, at))
            size, prior, type_id, _, ts, instance, kind, _, _ = head
            if size < self.header.record_header_size or at + size > self.size or (before is not None and prior != before):
                break
            if type_id not in (INDEX_TYPE, DESCRIPTION_TYPE):
                if kind not in KINDS:
                    break
                out.append((ts, size, kind, *stream_key(type_id, instance), at))
            before, at = size, at + size
        found = np.array(out, ENTRY)
        return found[np.lexsort((found["at"], found["instance_id"], found["type_id"], found["ts"]))]


@dataclass
class Range(InputPartition):
    """Records that one task reads: the place of their entries in an index with the offset of the first one, or the entries."""

    path: str
    record_header_size: int
    asked: list[tuple[str, type, object]]
    place: Place | None = None
    first: int = 0
    held: np.ndarray | None = None

    @property
    def entries(self) -> np.ndarray:
        if self.place is None:
            return self.held
        with closing(Chunks(self.path)) as f:
            found = placed(np.frombuffer(f.read_at(self.place.n * STORED.itemsize, self.place.at), STORED), self.first)
        return found[chosen(found, self.asked)]


@dataclass
class Described(InputPartition):
    """Streams of a description that one task reads."""

    path: str
    at: int
    size: int
    n: int


@dataclass
class Rows(InputPartition):
    rows: list[tuple]


def stream_row(path: str, key: tuple[int, int], s: Stream) -> tuple:
    return (path, *key, f"{key[0]}-{key[1]}", s.private_tag(ORIGINAL_NAME), s.private_tag(FLAVOR), s.private_tag(SERIAL), s.user, s.private)


class RecordingReader(DataSourceReader):
    """Reads a table; Spark takes records in Arrow batches (``batched``), else they come as tuples."""

    def __init__(self, paths: list[str], table: str, rebuild: bool, batched: bool = False) -> None:
        self.paths, self.table, self.rebuild, self.batched = paths, table, rebuild, batched
        self.asked: list[tuple[str, type, object]] = []

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.paths:
            r = Recording(path)
            if self.table == "streams":
                out += r.parts()[0]
                continue
            found = None if self.rebuild else r.found_index()
            if self.table == "files":
                out.append(Rows([(path, r.size, Decimal(r.header.creation_id), r.parts()[1], found is not None)]))
                continue
            if isinstance(found, Place):
                for lo, entries in r.blocks(found):
                    own = np.flatnonzero(chosen(entries, self.asked))
                    for x in np.split(own, cuts(entries[own])):
                        if len(x):
                            place = Place(found.at + (lo + int(x[0])) * STORED.itemsize, int(x[-1] - x[0]) + 1)
                            out.append(Range(path, r.header.record_header_size, self.asked, place, int(entries["at"][x[0]])))
                continue
            found = r.walk() if found is None else found
            own = found[chosen(found, self.asked)]
            out += [Range(path, r.header.record_header_size, self.asked, held=x) for x in np.split(own, cuts(own)) if len(x)]
        return out or [Rows([])]

    def read(self, partition: InputPartition) -> Iterator[tuple] | Iterator[pa.RecordBatch]:
        if isinstance(partition, Rows):
            yield from partition.rows
        elif isinstance(partition, Described):
            with closing(Chunks(partition.path)) as f:
                c = Cursor(f.read_at(partition.size, partition.at))
            for _ in range(partition.n):
                yield stream_row(partition.path, c.stream(), Stream(c.tags(), c.tags()))
        elif self.batched:
            yield from self.batches(partition)
        else:
            for batch in self.batches(partition):
                yield from zip(*(c.to_pylist() for c in batch.columns))

    def batches(self, partition: Range) -> Iterator[pa.RecordBatch]:
        head_size, entries = partition.record_header_size, partition.entries
        if not len(entries):
            return
        slim = self.table == "index"
        sizes = entries["size"].astype(np.int64)
        ends = entries["at"] + sizes
        # Neighbours are read together; headers alone where records are large.
        heads_only = slim and entries["size"].mean() > 4096
        begins = np.flatnonzero(np.concatenate(([True], (entries["at"][1:] != ends[:-1]) | heads_only, [True])))
        with closing(Chunks(partition.path)) as f:
            lo, held, since, n_bytes = 0, [], 0, 0
            while lo < len(entries):
                stop = min(int(begins[np.searchsorted(begins, lo, side="right")]), since + BATCH_ROWS)
                hi = max(lo + 1, lo + int(np.searchsorted(ends[lo:stop], entries["at"][lo] + READ, side="right")))
                n = head_size if heads_only else int(ends[hi - 1] - entries["at"][lo])
                held.append(f.read_at(n, int(entries["at"][lo])))
                if len(held[-1]) < n:
                    raise Damaged(f"{partition.path}: no {n} bytes at {entries['at'][lo]}")
                lo, n_bytes = hi, n_bytes + n
                if n_bytes >= READ or lo - since >= BATCH_ROWS or lo == len(entries):
                    own = slice(since, lo)
                    yield self.batch(partition.path, head_size, entries[own], b"".join(held), np.full(lo - since, head_size) if heads_only else sizes[own])
                    held, since, n_bytes = [], lo, 0

    def batch(self, path: str, head_size: int, entries: np.ndarray, data: bytes, lengths: np.ndarray) -> pa.RecordBatch:
        """Records that stand in ``data`` one after the other, ``lengths`` bytes of each."""
        raw = np.frombuffer(data + bytes(RECORD.size), np.uint8)
        starts = np.cumsum(lengths) - lengths
        heads = raw[starts[:, None] + np.arange(RECORD.size)].view(HEAD)[:, 0]
        types, instances = stream_keys(heads["type_id"], heads["instance_id"])
        ok = (heads["size"] == entries["size"]) & (types == entries["type_id"]) & (instances == entries["instance_id"]) & (heads["kind"] == entries["kind"]) & (entries["size"] >= head_size)
        payloads = None
        if self.table != "index" and ok.all() and (heads["how"] == NONE).all():
            inside = np.ones(len(data), bool)
            inside[starts[:, None] + np.arange(head_size)] = False
            offsets = np.concatenate(([0], np.cumsum(lengths - head_size))).astype("<i4")
            payloads = pa.Array.from_buffers(pa.binary(), len(entries), [None, pa.py_buffer(offsets), pa.py_buffer(raw[: len(data)][inside])])
        elif self.table != "index":
            found: list[bytes | None] = []
            for k, (start, n) in enumerate(zip(starts.tolist(), lengths.tolist())):
                try:
                    found.append(unpacked(data[start + head_size : start + n], int(heads["how"][k]), int(heads["unpacked"][k])) if ok[k] else None)
                except Exception:
                    if self.table != "checked":
                        raise
                    ok[k] = False
                    found.append(None)
            payloads = pa.array(found, pa.binary())
        if self.table != "checked" and not ok.all():
            raise Damaged(f"{path}: the record at {entries['at'][~ok][0]} isn't the one of the index")
        streams, of = np.unique(entries["type_id"].astype(np.int64) << 32 | entries["instance_id"], return_inverse=True)
        kinds = pa.array([KINDS.get(k) for k in range(256)], pa.string())
        columns = [
            pa.repeat(pa.scalar(path, pa.string()), len(entries)), pa.array(np.ascontiguousarray(entries["type_id"])), pa.array(np.ascontiguousarray(entries["instance_id"])),
            pa.array([f"{k >> 32}-{k & 0xFFFFFFFF}" for k in streams.tolist()], pa.string()).take(pa.array(of)), kinds.take(pa.array(np.ascontiguousarray(entries["kind"]))),
            pa.array(heads["version"].astype(np.int64), mask=~ok), pa.array(np.ascontiguousarray(entries["ts"])), pa.array(ANSWERED["ts_us"](entries)),
            pa.array(np.ascontiguousarray(entries["at"])), pa.array(entries["size"].astype(np.int64)), pa.array(heads["how"].astype(np.int32), mask=~ok),
        ]
        columns += [] if self.table == "index" else [payloads] if self.table == "records" else [payloads, pa.array(ok)]
        return pa.RecordBatch.from_arrays(columns, TABLES[self.table].names)


class FilteringReader(RecordingReader):
    """A reader that holds filters against the index; Spark takes one only where its pushdown is enabled."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if self.table in ("records", "index", "checked") and type(f) in (*TESTS, In) and len(f.attribute) == 1 and f.attribute[0] in ANSWERED and f.value is not None:
                self.asked.append((f.attribute[0], type(f), f.value))
            yield f  # Spark asks again


class RecordingSource(DataSource):
    """``spark.read.format("recording")``; options: path, table, rebuild, pushdown."""

    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> T.StructType:
        return TABLES[self.options.get("table", "records")]

    def reader(self, schema: T.StructType) -> RecordingReader:
        path = self.options["path"]
        paths = starts(sorted(glob.glob(path))) if "://" not in path and any(c in path for c in "*?[") else path.split(",")
        kind = FilteringReader if self.options.get("pushdown", "false").lower() == "true" else RecordingReader
        return kind(paths, self.options.get("table", "records"), self.options.get("rebuild", "false").lower() == "true", batched=True)


def tags_bytes(tags: dict[str, str]) -> bytes:
    def text(s: str) -> bytes:
        raw = s.encode("utf-8")
        return struct.pack("<I", len(raw)) + raw

    return struct.pack("<I", len(tags)) + b"".join(text(k) + text(v) for k, v in sorted(tags.items()))


#: Bytes and records of a recording that a task makes at a time.
PIECE_BYTES, PIECE_RECORDS = 4 << 20, 1 << 15
#: What a piece holds, in the order in which a recording is written.
DESCRIBED, BODIES, IDS, ENTRIES = range(4)
PIECES = T.StructType([T.StructField("file_id", T.StringType()), T.StructField("what", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("nth", T.LongType()), T.StructField("data", T.BinaryType()), T.StructField("sizes", T.BinaryType())])


class RecordingWriter:
    """Writes one recording from front to back, from pieces that come as it is laid out.

    ``described`` and ``body_size`` are the bytes that the descriptions of all streams and all
    records will take.  ``chunk_size`` starts a new chunk before a record that would pass it.
    With ``split`` the first chunk holds header, tags and index, and all records follow in
    chunks of their own.  Nothing but the piece at hand is held.
    """

    def __init__(self, path: str, tags: dict[str, str], n_streams: int, described: int, n: int, body_size: int, creation_id: int = 0, chunk_size: int = 0, split: bool = False) -> None:
        self.path, self.n, self.n_streams, self.what = path, n, n_streams, DESCRIBED
        self.fs, self.place = opened(path)
        self.chunk_size, self.split, self.n_chunks = chunk_size, split, 1
        self.fs.create_dir(os.path.dirname(self.place), recursive=True)
        self.out = self.top = self.fs.open_output_stream(self.place + ".part")
        self.tags = tags_bytes(tags)
        self.before = RECORD.size + 4 + described + len(self.tags)
        first = self.held = HEADER.size + self.before
        at = first + RECORD.size + n * INDEX_ENTRY.size if split else first
        self.out.write(HEADER.pack(*MAGIC[:2], creation_id, HEADER.size, RECORD.size, first if split else first + body_size, HEADER.size, at, 0, 0, 0, MAGIC[2], VERSIONS[1]))
        self.out.write(RECORD.pack(self.before, 0, DESCRIPTION_TYPE, DESCRIPTION_VERSION, 0.0, 0, 1, NONE, 0) + struct.pack("<I", n_streams))

    def next_chunk(self) -> None:
        if self.out is not self.top or not self.split:
            self.out.close()
        self.out, self.held = self.fs.open_output_stream(following(self.place, self.n_chunks) + ".part"), 0
        self.n_chunks += 1

    def reach(self, what: int) -> None:
        """Writes what stands between the pieces before and those of ``what``."""
        while self.what < what:
            self.what += 1
            if self.what == BODIES:
                self.out.write(self.tags)
                if self.split:
                    size = RECORD.size + self.n * INDEX_ENTRY.size
                    self.out.write(RECORD.pack(size, self.before, INDEX_TYPE, SPLIT_INDEX_VERSION, 0.0, 0, 1, NONE, 0))
                    self.before = 0
                    self.next_chunk()
            elif self.what == IDS and not self.split:
                size = RECORD.size + 8 + self.n_streams * STREAM_ID.size + self.n * INDEX_ENTRY.size
                if self.chunk_size and self.held and self.held + size > self.chunk_size:
                    self.next_chunk()
                self.out.write(RECORD.pack(size, self.before, INDEX_TYPE, INDEX_VERSION, 0.0, 0, 1, NONE, 0) + struct.pack("<I", self.n_streams))
            elif self.what == ENTRIES and not self.split:
                self.out.write(struct.pack("<I", self.n))

    def add(self, what: int, data: bytes, sizes: bytes | None) -> None:
        self.reach(what)
        if what == BODIES:
            self.add_records(data, np.frombuffer(sizes, "<u4"))
        elif what == DESCRIBED or not self.split:
            self.out.write(data)
        elif what == ENTRIES:
            self.top.write(data)

    def add_records(self, data: bytes, sizes: np.ndarray) -> None:
        """Records one after the other; the first one is told the size of the one before it."""
        data = memoryview(data[:4] + struct.pack("<I", self.before) + data[8:])
        self.before = int(sizes[-1])
        ends = np.cumsum(sizes, dtype=np.int64)
        k, at = 0, 0
        while k < len(ends):
            upto = len(ends)
            if self.chunk_size:
                upto = int(np.searchsorted(ends, at + self.chunk_size - self.held, side="right"))
                if upto <= k and self.held:
                    self.next_chunk()
                    continue
                upto = max(upto, k + 1)
            self.out.write(data[at : ends[upto - 1]])
            self.held += int(ends[upto - 1]) - at
            k, at = upto, int(ends[upto - 1])

    def close(self) -> None:
        """Moves the chunks to their places, the first one last."""
        self.reach(ENTRIES)
        for out in {id(x): x for x in (self.out, self.top)}.values():
            out.close()
        n = self.n_chunks
        while self.fs.get_file_info(following(self.place, n)).type == pafs.FileType.File:  # of an earlier, longer recording
            self.fs.delete_file(following(self.place, n))
            n += 1
        for place in [*(following(self.place, k) for k in range(1, self.n_chunks)), self.place]:
            self.fs.move(place + ".part", place)


def pieces(own: str, rows: list[tuple]) -> pa.RecordBatch:
    """Rows (what, part, nth, data, sizes) of one recording."""
    columns = [[own] * len(rows), *zip(*rows)]
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], PIECES.names)


def stream_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, nth, own, held, ids, size = TaskContext.get().partitionId(), 0, None, [], [], 0

    def done() -> pa.RecordBatch:
        return pieces(own, [(DESCRIBED, part, nth, b"".join(held), None), (IDS, part, nth, b"".join(ids), None)])

    for batch in batches:
        for file_id, type_id, instance, user, private in zip(*(c.to_pylist() for c in batch.columns)):
            if held and (file_id != own or size > PIECE_BYTES):
                yield done()
                nth, held, ids, size = nth + 1, [], [], 0
            own = file_id
            ids.append(STREAM_ID.pack(*stored_id(type_id, instance)))
            held.append(ids[-1] + tags_bytes(dict(user or ())) + tags_bytes(dict(private or ())))
            size += len(held[-1])
    if held:
        yield done()


def described_streams(streams: DataFrame) -> DataFrame:
    """streams(file_id, type_id, instance_id, user_tags, private_tags), one row each -> pieces DESCRIBED and IDS."""

    keys = ("file_id", "type_id", "instance_id")
    return streams.select(*keys, "user_tags", "private_tags").repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(stream_pieces, PIECES)


def record_pieces(batches: Iterator[pa.RecordBatch], compression: int) -> Iterator[pa.RecordBatch]:
    part, nth, own, held, entries, sizes, size, before = TaskContext.get().partitionId(), 0, None, [], [], [], 0, 0

    def done() -> pa.RecordBatch:
        return pieces(own, [(BODIES, part, nth, b"".join(held), np.array(sizes, "<u4").tobytes()), (ENTRIES, part, nth, b"".join(entries), None)])

    for batch in batches:
        for file_id, type_id, instance, kind, ts, version, payload in zip(*(c.to_pylist() for c in batch.columns)):
            if held and (file_id != own or size > PIECE_BYTES or len(sizes) >= PIECE_RECORDS):
                yield done()
                nth, held, entries, sizes, size, before = nth + 1, [], [], [], 0, 0
            own, payload, code = file_id, payload or b"", CODES[kind]
            type_id, instance = stored_id(type_id, instance)
            body, how = packed(payload, compression)
            n = RECORD.size + len(body)
            held += (RECORD.pack(n, before, type_id, version, ts, instance, code, how, len(payload) if how else 0), body)
            entries.append(INDEX_ENTRY.pack(ts, n, code, type_id, instance))
            sizes.append(n)
            size, before = size + n, n
    if held:
        yield done()


def encoded_records(rows: DataFrame, compression: int) -> DataFrame:
    """rows(file_id, type_id, instance_id, record_type, time, version, file_offset, payload) -> pieces BODIES and ENTRIES.

    Rows are dealt by ranges of their order, so that all tasks make records of one recording.
    """

    order = ("file_id", "time", "type_id", "instance_id", "file_offset")
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return placed.select("file_id", "type_id", "instance_id", "record_type", "time", "version", "payload").mapInArrow(lambda batches: record_pieces(batches, compression), PIECES)


def packed_sizes(rows: DataFrame, compression: int) -> DataFrame:
    """file_id, size of each record as it will be written."""
    head = RECORD.size
    if compression == NONE:
        return rows.select("file_id", (F.coalesce(F.length("payload"), F.lit(0)) + head).cast("long").alias("size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [head + len(packed(x.as_py() or b"", compression)[0]) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["file_id", "size"])

    return rows.select("file_id", "payload").mapInArrow(run, "file_id string, size long")


def write_recordings(records: DataFrame, folder: str, tags: dict[str, str] | None = None, compression: int = ZSTD, streams: DataFrame | None = None, chunk_size: int = 0, split: bool = False) -> DataFrame:
    """One file per file_id, in canonical order: file_id, path, n.

    ``streams``(file_id, type_id, instance_id, user_tags, private_tags) gives the streams
    their tags, those without records too.  Times are those of ``timestamp`` and formats
    those of ``format_version`` where records have them; else ts_us and 1.  ``chunk_size``
    (bytes) and ``split`` are those of ``RecordingWriter``.

    Descriptions, records and index entries are made by all tasks, as pieces of a few MB.  Their
    sizes, summed per file, tell where its index will stand; so one task writes a file in one
    go, as its format asks, and only copies pieces.
    """
    keys = ["file_id", "type_id", "instance_id"]
    tags = dict(tags or {})
    file_id = F.coalesce(F.col("file_id").cast("string"), F.lit("None")).alias("file_id")
    time = F.col("timestamp") if "timestamp" in records.columns else F.col("ts_us") / F.lit(1e6)
    version = F.col("format_version") if "format_version" in records.columns else F.lit(1)
    source = records.select(file_id, *keys[1:], "record_type", time.cast("double").alias("time"), version.cast("long").alias("version"), "file_offset", F.col("payload").cast("binary").alias("payload"))
    found = source.select(*keys).distinct().withColumn("user_tags", F.lit(None).cast(TAGS)).withColumn("private_tags", F.lit(None).cast(TAGS))
    if streams is not None:
        given = streams.select(file_id, *keys[1:], F.col("user_tags").cast(TAGS).alias("user_tags"), F.col("private_tags").cast(TAGS).alias("private_tags"))
        found = found.unionByName(given).groupBy(*keys).agg(*(F.last(c, ignorenulls=True).alias(c) for c in ("user_tags", "private_tags")))
    described = described_streams(found)
    # One row a file.
    totals = {r[0]: (r[1], r[2]) for r in packed_sizes(source, compression).groupBy("file_id").agg(F.count("*"), F.sum("size")).collect()}
    heads = {r[0]: (r[1] // STREAM_ID.size, r[2]) for r in described.groupBy("file_id").agg(*(F.sum(F.when(F.col("what") == k, F.length("data"))) for k in (IDS, DESCRIBED))).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, writer = None, None

        def done() -> pa.RecordBatch:
            writer.close()
            return pa.RecordBatch.from_arrays([pa.array([own]), pa.array([writer.path]), pa.array([writer.n], pa.int64())], ["file_id", "path", "n"])

        for batch in batches:
            for i in range(batch.num_rows):
                name, what, _, _, data, sizes = (c[i].as_py() for c in batch.columns)
                if name not in totals:  # streams of a file without records
                    continue
                if name != own:
                    if writer is not None:
                        yield done()
                    own, writer = name, RecordingWriter(f"{folder}/{os.path.basename(name)}.rec", tags, *heads[name], *totals[name], chunk_size=chunk_size, split=split)
                writer.add(what, data, sizes)
        if writer is not None:
            yield done()

    placed = dealt(described.unionByName(encoded_records(source, compression)), "file_id").sortWithinPartitions("file_id", "what", "part", "nth")
    return placed.mapInArrow(run, "file_id string, path string, n long")
