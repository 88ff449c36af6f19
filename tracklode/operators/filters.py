"""Selection of records by time, stream, type and kind, with context pre-roll."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklode.model import CONFIGURATION, DATA, ORDER, RECORD_TYPES, STATE, StreamId

US = 1_000_000


@dataclass
class Stream:
    """What a stream filter may look at."""

    id: StreamId
    flavor: str = ""


def split_signed(text: str) -> list[tuple[str, str]]:
    """``+a,-b,~c`` as signed names; a name without a sign is included, ``~`` excludes."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        sign = "-" if part[0] in "-~" else "+"
        out.append((sign, part[1:].strip() if part[0] in "+-~" else part))
    return out


def name_parts(name: str) -> tuple[str, str, str]:
    """Type, mark and rest of a stream's name."""
    for i, c in enumerate(name):
        if not c.isdigit():
            return name[:i], c, name[i + 1 :]
    return name, "", ""


def matching(name: str, streams: Iterable[Stream]) -> set[StreamId]:
    """Streams that ``R-N``, ``R+N`` (N-th from 1), ``R`` or ``R-flavor`` names."""
    streams = sorted(streams, key=lambda s: s.id)
    head, mark, rest = name_parts(name)
    if not head:
        return set()
    own = [s for s in streams if s.id.type_id == int(head)]
    if mark == "+" and rest.isdigit():
        n = int(rest)
        return {own[n - 1].id} if 1 <= n <= len(own) else set()
    if mark == "-" and rest.isdigit():
        return {s.id for s in own if s.id.instance_id == int(rest)}
    if mark == "-" and rest:
        return {s.id for s in own if s.flavor == rest}
    return {s.id for s in own} if mark in ("", "-") else set()


def fold_streams(filters: Iterable[tuple[str, str]], streams: Iterable[Stream]) -> set[StreamId]:
    """Apply signed stream names in order.

    Starts from nothing if the first sign includes, from every stream if it excludes
    (or if there is no filter); the result holds existing streams only.
    """
    streams, filters = list(streams), list(filters)
    every = {s.id for s in streams}
    kept = set() if filters and filters[0][0] == "+" else set(every)
    for sign, name in filters:
        found = matching(name, streams)
        kept = kept | found if sign == "+" else kept - found
    return kept & every


def named_type(text: str) -> str | None:
    """The record type that starts with ``text``, the first in the fixed order."""
    return next((t for t in RECORD_TYPES if t.startswith(text.lower())), None)


def fold_types(filters: Iterable[tuple[str, str]]) -> set[str]:
    """Apply signed type prefixes in order; unknown names change nothing."""
    filters = list(filters)
    kept = set() if filters and filters[0][0] == "+" else set(RECORD_TYPES)
    for sign, text in filters:
        if kind := named_type(text):
            kept = kept | {kind} if sign == "+" else kept - {kind}
    return kept


@dataclass
class Bound:
    """A time in seconds; signed ones count from an end of the data."""

    seconds: float
    relative: bool = False

    @classmethod
    def parse(cls, text: str) -> Bound:
        return cls(float(text), text[:1] in "+-")

    def resolved(self, first: int, last: int) -> int:
        """Microseconds: below zero from the last data time, else from the first."""
        us = round(self.seconds * US)
        return us if not self.relative else (last if self.seconds < 0 else first) + us


@dataclass
class Selection:
    """What to take from a recording.

    ``after`` is exclusive, ``before`` inclusive.  ``around`` is (centre, whole width)
    and stands for both.
    """

    streams: list[tuple[str, str]] = field(default_factory=list)
    types: list[tuple[str, str]] = field(default_factory=list)
    after: Bound | None = None
    before: Bound | None = None
    around: tuple[Bound, float] | None = None
    first_only: bool = False
    skip: Column | None = None

    def text(self) -> str:
        """The selection as words of a command line."""
        parts = [f"{s} {n}" for s, n in [*self.streams, *self.types]]
        mark = lambda b: f"{b.seconds:+g}" if b.relative else f"{b.seconds:g}"
        if self.around:
            parts.append(f"--around {mark(self.around[0])} {self.around[1]:g}")
        if self.after:
            parts.append(f"--after {mark(self.after)}")
        if self.before:
            parts.append(f"--before {mark(self.before)}")
        if self.first_only:
            parts.append("--first-records")
        return " ".join(parts)


def with_flavor(records: DataFrame, streams: DataFrame) -> DataFrame:
    """Adds the flavor of each record's stream, for filters by ``R-flavor``."""
    return records.join(streams.select("file_id", "type_id", "instance_id", "flavor"), ["file_id", "type_id", "instance_id"], "left")


def named(name: str) -> Column:
    """``matching`` for one row; ``_nth`` is its stream's place among those of its type and file."""
    head, mark, rest = name_parts(name)
    if not head:
        return F.lit(False)
    own = F.col("type_id") == int(head)
    if mark == "+" and rest.isdigit():
        return own & F.col("_nth").eqNullSafe(F.lit(int(rest)))
    if mark == "-" and rest.isdigit():
        return own & (F.col("instance_id") == int(rest))
    if mark == "-" and rest:
        return own & F.col("flavor").eqNullSafe(F.lit(rest))
    return own if mark in ("", "-") else F.lit(False)


def of_named_streams(records: DataFrame, signed: Iterable[tuple[str, str]]) -> DataFrame:
    """Rows of the streams that signed names choose; the N-th of a type counts within each file.

    ``fold_streams`` as a predicate on each row: no list of streams comes to the driver or into
    the plan.
    """
    signed, names = list(signed), records.columns
    parts = [name_parts(name) for _, name in signed]
    if signed and signed[0][0] == "+":  # a condition that the source can answer
        records = records.where(F.col("type_id").isin(sorted({int(head) for (sign, _), (head, _, _) in zip(signed, parts) if sign == "+" and head})))
    keep = F.lit(not signed or signed[0][0] != "+")
    if wanted := [(int(head), int(rest)) for head, mark, rest in parts if head and mark == "+" and rest.isdigit()]:
        file = ["file_id"] if "file_id" in names else []
        keys = [*file, "type_id", "instance_id"]
        nth = F.row_number().over(Window.partitionBy(*file, "type_id").orderBy("instance_id"))
        placed = records.where(F.col("type_id").isin(sorted({t for t, _ in wanted}))).select(*keys).distinct().withColumn("_nth", nth).where(F.col("_nth").isin(sorted({n for _, n in wanted})))
        placed = placed.select(*(F.col(k).alias(f"_r_{k}") for k in keys), "_nth")  # a row a file and name
        on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
        records = records.join(placed, on, "left")
    if "flavor" not in names:
        records = records.withColumn("flavor", F.lit(""))
    for sign, name in signed:
        keep = keep | named(name) if sign == "+" else keep & ~named(name)
    return records.where(keep).select(*names)


def of_types(records: DataFrame, types: set[str]) -> DataFrame:
    return records.where(F.col("record_type").isin(sorted(types))) if len(types) < len(RECORD_TYPES) else records


def in_range(records: DataFrame, after: int | None, before: int | None) -> DataFrame:
    """after < ts_us <= before."""
    if after is not None:
        records = records.where(F.col("ts_us") > after)
    return records if before is None else records.where(F.col("ts_us") <= before)


def data_range(records: DataFrame) -> tuple[int, int] | None:
    """First and last time of DATA records."""
    r = records.where(F.col("record_type") == DATA).agg(F.min("ts_us").alias("a"), F.max("ts_us").alias("b")).first()
    return None if r["a"] is None else (r["a"], r["b"])


def time_bounds(chosen: Selection, records: DataFrame) -> tuple[int | None, int | None]:
    """Absolute bounds; relative ones come from data records of the chosen streams, whatever the types."""
    after, before = chosen.after, chosen.before
    wanted = [b for b in (after, before, chosen.around[0] if chosen.around else None) if b is not None]
    first, last = 0, 0
    if any(b.relative for b in wanted):
        found = data_range(records)
        if found is None:
            raise ValueError("relative times need data records")
        first, last = found
    if chosen.around:
        centre, half = chosen.around[0].resolved(first, last), round(abs(chosen.around[1]) * US / 2)
        return centre - half, centre + half
    return after and after.resolved(first, last), before and before.resolved(first, last)


def constrained_range(chosen: Selection, records: DataFrame) -> tuple[int, int] | None:
    """The range of the data that a selection leaves: the data's own, cut at the bounds; None without data."""
    found = data_range(records)
    if found is None:
        return None
    after, before = time_bounds(chosen, records)
    return found[0] if after is None else max(found[0], after), found[1] if before is None else min(found[1], before)


def up_to_damage(checked: DataFrame) -> DataFrame:
    """Rows of ``checked`` (with ok) before the first damaged one of each file, in reading order.

    One row a damaged file is broadcast, so a file's records aren't dealt to one task.
    """
    here = F.struct(*ORDER)
    bad = checked.where(~F.col("ok")).groupBy("file_id").agg(F.min(here).alias("_bad"))
    return checked.join(F.broadcast(bad), "file_id", "left").where(F.col("_bad").isNull() | (here < F.col("_bad"))).drop("_bad", "ok")


def first_records(records: DataFrame, keys: Iterable[str] = ("file_id", "type_id", "instance_id", "record_type")) -> DataFrame:
    """The first record of each stream and type.

    An aggregation with partial results, so no stream is gathered.
    """
    keys, names = list(keys), records.columns
    order = [c for c in ORDER if c not in keys]
    rest = [c for c in names if c not in keys and c not in order]
    best = records.groupBy(*keys).agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, "_r.*").select(*names)


def last_records(records: DataFrame, keys: Iterable[str] = ("file_id", "type_id", "instance_id", "record_type")) -> DataFrame:
    """The last record of each stream and type."""
    keys, names = list(keys), records.columns
    order = [c for c in ORDER if c not in keys]
    rest = [c for c in names if c not in keys and c not in order]
    best = records.groupBy(*keys).agg(F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, "_r.*").select(*names)


def preroll(records: DataFrame, after: int | None) -> DataFrame:
    """The latest configuration and state of each stream at or before ``after``.

    Nothing without ``after``, nor where no record of the file lies after it.
    """
    if after is None:
        return records.limit(0)
    context = records.where((F.col("ts_us") <= after) & F.col("record_type").isin(CONFIGURATION, STATE))
    later = records.where(F.col("ts_us") > after).select("file_id").distinct()
    return last_records(context).join(F.broadcast(later), "file_id", "left_semi")  # a row a file


def select_records(records: DataFrame, chosen: Selection, with_context: bool = True) -> DataFrame:
    """Context and records that a selection takes, in no particular order.

    Time, then streams and types, then first-only, then the skip predicate.
    """
    if chosen.streams:
        records = of_named_streams(records, chosen.streams)
    after, before = time_bounds(chosen, records)
    records_of = of_types(records, fold_types(chosen.types))
    if after is not None and before is not None and after > before:
        return records.limit(0)
    out = in_range(records_of, after, before)
    if chosen.first_only:
        out = first_records(out)
    if chosen.skip is not None:
        out = out.where(~chosen.skip)
    if not with_context or after is None:
        return out
    # Whether anything follows is asked of every stream chosen, of any type.
    lead = of_types(preroll(records, after), fold_types(chosen.types))
    return lead.select(*out.columns).unionByName(out)
