"""Edits while copying: blank or drop content, rewrite fields, override tags."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklode.functions.text import merged_map


def zeroed(records: DataFrame, types: Sequence[int], keep_size: bool = True) -> DataFrame:
    """Payloads of these stream types as zeros of the same length, or as nothing.

    Only the length of a blanked payload is read.
    """
    zeros = F.unhex(F.repeat(F.lit("00"), F.octet_length("payload").cast("int"))) if keep_size else F.lit(b"")
    blank = F.when(F.col("type_id").isin(list(types)), zeros).otherwise(F.col("payload").cast("binary"))
    return records.withColumn("payload", blank)


def edited(decoded: DataFrame, column: str, edits: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """Rewrite fields of a decoded struct."""
    value = F.col(column)
    for name, edit in edits.items():
        value = value.withField(name, edit(F.col(column)[name]))
    return decoded.withColumn(column, value)


def copied_fields(into: Column, source: Column, names: Sequence[str]) -> Column:
    """A struct with these fields taken from another, where that has them."""
    out = into
    for n in names:
        out = out.withField(n, F.coalesce(source[n], into[n]))
    return out


def overridden(streams: DataFrame, tags: Mapping[str, str], column: str = "user_tags") -> DataFrame:
    """Streams with tags set, whatever they were."""
    pairs = [F.lit(x) for kv in tags.items() for x in kv]
    return streams.withColumn(column, merged_map(F.col(column), F.create_map(*pairs))) if pairs else streams


def resolved_spec(inline: Column, layout: Column, configuration: Column) -> Column:
    """An image or audio spec: its own, else the record's layout's, else the last configuration's."""
    return F.coalesce(inline, layout, configuration)


def block_size(known: Column, total: Column, following: Column, announced: Column) -> Column:
    """A block's size: announced by the layout before it, else known, else what the rest leaves."""
    rest = total - following
    return F.coalesce(announced, known, F.when(rest >= 0, rest))
