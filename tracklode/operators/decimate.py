"""Decimation by interval and by bucket.

Both walk records in order with a state of one time per stream, so they run as a map
over sorted partitions: memory doesn't grow with a stream's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklode.model import DATA, ORDER
from tracklode.operators.ordered import dealt

DELTA_US = 33_333
WIDTH_OF_GRACE = 1.2


def grace_window_us(interval_us: int) -> int:
    return round(WIDTH_OF_GRACE * interval_us)


def interval_decimate(records: DataFrame, intervals_us: dict[int, int] | int) -> DataFrame:
    """Of each stream's data keep a record if it is an interval after the last kept one.

    intervals_us: one interval, or one by type id; other types, configuration and state
    pass.  A stream is walked by one task, which reads it sorted and holds one time.
    """
    by_type = intervals_us if isinstance(intervals_us, dict) else None
    due = F.col("record_type") == DATA
    if by_type is not None:
        due = due & F.col("type_id").isin(list(by_type))
    names = records.columns
    keys = ("file_id", "type_id", "instance_id")
    at = [names.index(k) for k in keys]
    place, kind = names.index("ts_us"), names.index("type_id")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, last = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = [batch.column(i).to_pylist() for i in at]
            ts = batch.column(place).to_numpy()
            types = ids[1]
            keep = np.zeros(batch.num_rows, bool)
            i = 0
            while i < batch.num_rows:
                own = (ids[0][i], ids[1][i], ids[2][i])
                end = i
                while end < batch.num_rows and ids[2][end] == own[2] and ids[1][end] == own[1] and ids[0][end] == own[0]:
                    end += 1
                step = by_type[types[i]] if by_type is not None else intervals_us
                j = i
                if own != stream:
                    keep[i], last, stream, j = True, ts[i], own, i + 1
                while (j := int(np.searchsorted(ts[i:end], last + step)) + i if last + step > ts[i] else max(j, i)) < end:
                    keep[j], last = True, ts[j]
                    j += 1
                    if step <= 0:
                        keep[i:end] = True
                        last = ts[end - 1]
                        break
                i = end
            yield batch.filter(pa.array(keep))

    walked = dealt(records.where(due), *keys).sortWithinPartitions(*keys, "ts_us", "file_offset").mapInArrow(walk, records.schema)
    return records.where(~due).unionByName(walked)


def bucket_decimate(records: DataFrame, interval_us: int, delta_us: int = DELTA_US, farthest: bool = True) -> DataFrame:
    """At most one data record per stream and bucket of a grid that starts at the first data time.

    A record more than ``delta_us`` past the bucket closes it, moves the grid on by one
    interval and is dropped itself.  Within ``delta_us`` of the bucket a stream's
    candidate is replaced by one farther from it (``farthest``, as recordings were
    decimated so far) or nearer.  One task walks a file; it holds a row per stream.
    """
    names = records.columns
    file, place = names.index("file_id"), names.index("ts_us")
    stream = [names.index("type_id"), names.index("instance_id")]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, current = None, 0
        held: dict[tuple, tuple[int, pa.RecordBatch]] = {}
        for batch in batches:
            out: list[pa.RecordBatch] = []
            files, ts = batch.column(file).to_pylist(), batch.column(place).to_pylist()
            ids = list(zip(*(batch.column(i).to_pylist() for i in stream)))
            for i in range(batch.num_rows):
                if at is None or files[i] != at[0]:
                    out += [row for _, row in held.values()]
                    held, at, current = {}, (files[i],), ts[i]
                off = ts[i] - current
                if off > delta_us:
                    out += [row for _, row in held.values()]
                    held, current = {}, current + interval_us
                elif abs(off) <= delta_us:
                    old = held.get(ids[i])
                    if old is None or (old[0] < abs(off) if farthest else abs(off) < old[0]):
                        held[ids[i]] = (abs(off), batch.slice(i, 1))
            yield from out
        yield from (row for _, row in held.values())

    due = F.col("record_type") == DATA
    walked = dealt(records.where(due), "file_id").sortWithinPartitions("file_id", *ORDER).mapInArrow(walk, records.schema)
    return records.where(~due).unionByName(walked)
