"""Records as content blocks: formats and layouts of their streams resolved and read.

A stream's private tags tell, by record type and format version, which blocks a record
has (``RF:Type:version``) and how its layout blocks are built (``DL:Type:version:block``).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklode.functions.formats import Block, block_sizes, parse_format
from tracklode.functions.layouts import Layout
from tracklode.operators.streams import layouts, record_formats

FILE_STREAM = ("file_id", "type_id", "instance_id")
#: The piece of a layout that tells the size of the next block.
NEXT_SIZE = "next_content_block_size"
KIND = (*FILE_STREAM, "record_type", "format_version")


def with_formats(records: DataFrame, streams: DataFrame) -> DataFrame:
    """Adds blocks (texts of the format) and layouts (by block) of each record's stream, type and version; null where the stream has none."""
    own = layouts(streams).groupBy(*KIND).agg(F.map_from_entries(F.collect_list(F.struct(F.col("block").cast("string"), "layout"))).alias("layouts"))
    told = record_formats(streams).join(own, list(KIND), "left")
    return records.join(told, list(KIND), "left")


def plain(value: object) -> object:
    """A value as JSON takes it; whole numbers beyond a double stay whole."""
    if isinstance(value, Decimal):
        return int(value)
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, list) else value


@lru_cache(maxsize=4096)
def parsed_format(text: str) -> tuple[tuple[Block, str], ...]:
    """The blocks of a format and their texts; streams share a few formats, records all of them."""
    return tuple((b, b.text()) for b in parse_format(text))


def blocks_of(payload: bytes, texts: list[str], by_block: dict[str, Layout]) -> list[tuple[int, Block, int | None, int | None, str | None]]:
    """(number, block, start, size, JSON of a layout) of each block of a record.

    A layout without a given size is as long as its own index says, and may tell the size
    of the block behind it; the one other block without a size takes what is left.  A block whose start can't be told is given up,
    and so is what follows it.
    """
    parsed = [b for b, _ in parsed_format("+".join(texts))]
    sizes = [0 if b.kind == "empty" else b.size for b in parsed]
    layouts_at = {i for i in range(len(parsed)) if str(i) in by_block}
    out, at = [], 0
    for i, block in enumerate(parsed):
        layout = by_block.get(str(i))
        if sizes[i] is None and layout is not None and at is not None:
            sizes[i] = layout.size_in(payload[at:])
        size = block_sizes(sizes, len(payload))[i] if at is not None else None
        if size is not None and at + size > len(payload):
            size = None
        value = None
        if layout is not None and size is not None:
            held = layout.read(payload[at : at + size])
            value = json.dumps(plain(held), sort_keys=True)
            if i + 1 < len(sizes) and sizes[i + 1] is None and i + 1 not in layouts_at:
                sizes[i + 1] = held.get(NEXT_SIZE) or None
        out.append((i, block, at, size, value))
        at = None if at is None or size is None else at + size
    return out


def decoded_blocks(records: DataFrame, streams: DataFrame) -> DataFrame:
    """One row a block: FILE_STREAM, record_type, ts_us, file_offset, block, kind, format, spec (the block's text), start, size, n_bytes (of the record), content (JSON of a layout).

    Records of a stream without a format are one block of kind ``custom``.  A map: records
    meet formats by a join on a table of a few rows a stream.
    """
    keys = [*FILE_STREAM, "record_type", "ts_us", "file_offset"]
    rows = with_formats(records, streams).select(*keys, "payload", "blocks", "layouts")
    kinds = {k: rows.schema[k].dataType for k in keys}
    added = {"block": T.IntegerType(), "kind": T.StringType(), "format": T.StringType(), "spec": T.StringType(), "start": T.LongType(), "size": T.LongType(), "n_bytes": T.LongType(), "content": T.StringType()}
    schema = T.StructType([T.StructField(n, t) for n, t in (kinds | added).items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Layout] = {}  # as many as the streams' tags hold
        for batch in batches:
            whose, out = [], []
            for i, (payload, texts, by_block) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(len(keys), len(keys) + 3)))):
                held = {b: known.setdefault(t, Layout.parse(t)) if t not in known else known[t] for b, t in (by_block or ())}
                found = blocks_of(payload or b"", texts or ["custom"], held)
                shown = parsed_format("+".join(texts or ["custom"]))
                whose += [i] * len(found)
                out += [(n, b.kind, b.format, shown[n][1], start, size, len(payload or b""), value) for n, b, start, size, value in found]
            at = pa.array(whose, pa.int64())
            new = [pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * len(added), (pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(keys))), *new], schema.names)

    return rows.mapInArrow(run, schema)
