"""Combining recordings: unique stream ids, union, fuse, de-duplication, tags."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklode.model import ORDER, StreamId
from tracklode.operators.ordered import previous

#: Tags on which recordings that belong together must agree, where both have them.
RELATED_TAGS = ("capture_time_epoch", "session_id")


def unique_ids(streams_by_file: Sequence[tuple[int, Iterable[StreamId]]]) -> dict[tuple[int, StreamId], StreamId]:
    """A stream id for every (file, stream); a taken one moves to the next free instance.

    Files are served in their order, streams in theirs.
    """
    later: dict[int, dict[int, int]] = {}  # by type: a taken instance and one at or before the next free one
    out = {}
    for file_id, streams in streams_by_file:
        for s in sorted(streams):
            links, n, passed = later.setdefault(s.type_id, {}), s.instance_id, []
            while n in links:
                passed.append(n)
                n = links[n]
            # All that led here now lead past it, so a run of taken instances isn't walked again.
            for k in (*passed, n):
                links[k] = n + 1
            out[file_id, s] = StreamId(s.type_id, n)
    return out


def with_unique_ids(records: DataFrame) -> DataFrame:
    """Adds unique_instance, so that streams of different files don't collide."""
    rows = records.select("file_id", "type_id", "instance_id").distinct().collect()  # a few thousand streams a file at most
    by_file: dict[int, list[StreamId]] = {}
    for r in rows:
        by_file.setdefault(r["file_id"], []).append(StreamId(r["type_id"], r["instance_id"]))
    ids = unique_ids(sorted(by_file.items()))
    spark = records.sparkSession
    kinds = {c: records.schema[c].dataType.simpleString() for c in ("file_id", "type_id", "instance_id")}
    table = spark.createDataFrame(
        [(f, s.type_id, s.instance_id, u.instance_id) for (f, s), u in ids.items()],
        ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", unique_instance int",
    )
    return records.join(table, ["file_id", "type_id", "instance_id"])


def fused(records: DataFrame) -> DataFrame:
    """Adds fused_instance: the n-th stream of a type in each file becomes one stream."""
    streams = records.select("file_id", "type_id", "instance_id").distinct()
    nth = F.row_number().over(Window.partitionBy("file_id", "type_id").orderBy("instance_id"))
    return records.join(streams.withColumn("fused_instance", nth), ["file_id", "type_id", "instance_id"])


def drop_repeated_times(records: DataFrame, instance: str = "fused_instance") -> DataFrame:
    """Of each output stream and type, drop a record whose time equals that of the one before.

    Ties between files go by file order.
    """
    keys = ("type_id", instance, "record_type")
    order = ("ts_us", "file_id", "file_offset")
    rows = previous(records, keys, order, F.col("ts_us"), "_t")
    return rows.where(F.col("_t").isNull() | (F.col("_t") != F.col("ts_us"))).drop("_t")


def merged(records: DataFrame) -> DataFrame:
    """Fuse streams and drop repeats; sort by ORDER with file_id last to write it."""
    return drop_repeated_times(fused(records))


def canonical(records: DataFrame, precedence: bool = False) -> DataFrame:
    """Sorted in canonical order; ``precedence`` puts configuration, state, data before the offset."""
    kind = F.when(F.col("record_type") == "configuration", 0).when(F.col("record_type") == "state", 1).otherwise(2)
    return records.orderBy(*ORDER[:3], *([kind] if precedence else []), ORDER[3])


def related(tags: Sequence[Mapping[str, str]], names: Sequence[str] = RELATED_TAGS) -> bool:
    """Whether no two files give different values to one of ``names``."""
    return all(len({t[n] for t in tags if n in t}) <= 1 for n in names)


def first_tags(tags: Sequence[Mapping[str, str]]) -> dict[str, str]:
    """All tags; the first file that has one decides."""
    out: dict[str, str] = {}
    for t in tags:
        out = {**t, **out}
    return out


def merge_tags(into: Mapping[str, str], more: Mapping[str, str], private: bool = False) -> dict[str, str]:
    """Add tags; a conflicting private one is dropped, another kept as ``name_merged[-n]``."""
    out = dict(into)
    for name, value in more.items():
        if out.get(name, value) == value:
            out[name] = value
        elif not private:
            spare, n = f"{name}_merged", 0
            while out.get(spare, value) != value:
                n += 1
                spare = f"{name}_merged-{n}"
            out[spare] = value
    return out


def with_tags(base: Mapping[str, str], overrides: Mapping[str, str]) -> dict[str, str]:
    return {**base, **overrides}
