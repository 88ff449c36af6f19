"""Canonical relations and identifiers of recordings.

``records`` has one row per record: file_id, type_id, instance_id, stream_id,
record_type, ts_us (microseconds), timestamp (seconds), file_offset, record_size,
payload.  The canonical order is (ts_us, type_id, instance_id, file_offset).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

ORDER = ("ts_us", "type_id", "instance_id", "file_offset")
STREAM = ("type_id", "instance_id")
CONFIGURATION, STATE, DATA = "configuration", "state", "data"
#: Tested in this order when a type is given by its first letters.
RECORD_TYPES = (CONFIGURATION, STATE, DATA)
UNDEFINED_TYPE = 65535

# Fixed values of the file format: record type codes.
RECORD_TYPE_CODES = {"undefined": 0, "state": 1, "configuration": 2, "data": 3, "tags": 4}


@dataclass(frozen=True, order=True)
class StreamId:
    """A stream: its type and its instance; ordered by type, then instance."""

    type_id: int
    instance_id: int

    def __str__(self) -> str:
        return f"{self.type_id}-{self.instance_id}"

    @classmethod
    def parse(cls, text: str) -> StreamId | None:
        """``T-I`` as a stream, or None."""
        m = re.fullmatch(r"(\d+)-(\d+)", text)
        return cls(int(m[1]), int(m[2])) if m and int(m[1]) < UNDEFINED_TYPE and int(m[2]) > 0 else None


def stream_name(type_id: Column | str = "type_id", instance_id: Column | str = "instance_id") -> Column:
    """Columns of a stream as ``T-I``."""
    return F.concat_ws("-", F.col(type_id) if isinstance(type_id, str) else type_id, F.col(instance_id) if isinstance(instance_id, str) else instance_id)


def parsed_stream(name: Column) -> Column:
    """``T-I`` as a struct of type_id and instance_id; null for anything else."""
    part = F.regexp_extract(name, r"^(\d{1,5})-(\d{1,5})$", 0)
    ok = F.length(part) > 0
    return F.when(
        ok, F.struct(F.split_part(name, F.lit("-"), F.lit(1)).cast("int").alias("type_id"), F.split_part(name, F.lit("-"), F.lit(2)).cast("int").alias("instance_id"))
    )
