"""Scalars on text: sizes, durations and times for people, parsers, file names."""

from __future__ import annotations

import re
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

KIB = 1024
BYTE_SIZE = re.compile(r"\s*(\d+(?:\.\d+)?)\s*([kmgtpe]?)(?:i?b)?\s*", re.I)


def nearest_even(down: Column, eighths: Column, value: Column, tie: Column) -> Column:
    """``down`` or one more, as printing a double rounds.

    Eighths say how far past ``down`` the decimal value lies; at four the double itself
    decides, compared exactly with the tie (in two hundredths), and an exact tie goes to
    the even number.
    """
    exact = (value * float(1 << 52)).cast("long").cast("decimal(38,0)") * 200
    middle = tie.cast("decimal(38,0)") * (1 << 52)
    up = F.when(eighths > 4, 1).when(eighths < 4, 0).when(exact > middle, 1).when(exact < middle, 0).otherwise(down % 2)
    return down + up


def readable_size(size: Column) -> Column:
    """Bytes with a binary unit and three figures: ``512 B``, ``1.50 KiB``, ``100 MiB``.

    Cut to 160ths or 16ths before it is rounded, so 9.99 never becomes 10.0.
    """
    n = F.abs(size).cast("long")
    e = F.lit(0)
    for k in range(1, 7):
        e = F.when(n >= 1 << 10 * k, k).otherwise(e)
    unit = F.get(F.array(*(F.lit(u) for u in ("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB"))), e)
    whole = F.call_function("shiftright", n, e * 10)
    below = n - F.call_function("shiftleft", whole, e * 10)
    rest = F.call_function("shiftright", below, F.greatest(e - 1, F.lit(0)) * 10)  # of 1024
    fine, coarse = F.floor(rest * 160 / 1024), F.floor(rest * 16 / 1024)
    cents = F.floor(fine * 5 / 8)
    hundredths = nearest_even(whole * 100 + cents, fine * 5 % 8, whole + fine / 160, whole * 200 + cents * 2 + 1)
    tenths = F.floor(coarse * 5 / 8)
    tenths = tenths + F.when(coarse * 5 % 8 > 4, 1).when(coarse * 5 % 8 < 4, 0).otherwise(tenths % 2)
    two = F.format_string("%d.%02d", F.floor(hundredths / 100), hundredths % 100)
    one = F.format_string("%d.%d", whole + F.floor(tenths / 10), tenths % 10)
    plain = F.format_string("%d", whole)
    number = F.when((e == 0) | (whole >= 100), plain).when(whole >= 10, one).otherwise(two)
    return F.concat(F.when(size < 0, "-").otherwise(""), number, F.lit(" "), unit)


def readable_time(seconds: Column, digits: int = 3) -> Column:
    """Seconds with 3, 6 or 9 decimals; scientific where tiny (3 figures) or huge (9)."""
    digits = 3 if digits <= 3 else 6 if digits <= 6 else 9
    size = F.abs(seconds)
    plain = F.format_string(f"%.{digits}f", seconds)
    tiny = (size > 0) & (size < 10.0**-digits)
    return F.when(tiny, F.format_string("%.3e", seconds)).when(size >= 1e10, F.format_string("%.9e", seconds)).otherwise(plain)


#: Seconds of the parts of a long duration, and how each is written.
PARTS = ((31_557_600, "{} year, ", "{} years, "), (604_800, "{} week, ", "{} weeks, "), (86_400, "{} day, ", "{} days, "), (3600, "{}h ", "{}h "), (60, "{}m ", "{}m "))
SMALL = ((2e-3, "ms", 1e3), (2e-6, "us", 1e6), (2e-9, "ns", 1e9), (2e-12, "ps", 1e12), (2e-15, "fs", 1e15))


def duration_text(seconds: float) -> str:
    """A duration in the largest units that apply."""
    sign, rest = ("-", -seconds) if seconds < 0 else ("", seconds)
    if rest >= 1e9 * PARTS[0][0]:
        return f"{sign}{rest:.3f}s" if rest < 1e10 else f"{sign}{rest:.9e}s"
    out = ""
    for size, one, many in PARTS:
        if out or rest > size:
            n = int(rest / size)
            out += (one if n == 1 else many).format(n)
            rest -= n * size
    if out or rest == 0 or rest >= 1:
        return f"{sign}{out}{rest:.3f}s"
    for least, unit, factor in SMALL:
        if rest >= least:
            return f"{sign}{rest * factor:.0f}{unit}"
    return f"{sign}{rest * 1e15:.3f}fs" if rest >= 2e-18 else f"{sign}{rest * 1e15:g}fs"


def printable(text: str) -> str:
    """Control and non-ASCII bytes as escapes."""
    named = {10: "\\n", 13: "\\r", 9: "\\t", 8: "\\b", 27: "\\e"}
    return "".join(chr(b) if 32 <= b < 127 else named.get(b, f"\\x{b:02x}") for b in text.encode("utf-8"))


def byte_size(text: str) -> int | None:
    """``1.5MB`` and the like in bytes; None for anything else."""
    m = BYTE_SIZE.fullmatch(text)
    return int(float(m[1]) * KIB ** (" kmgtpe".index(m[2].lower() or " "))) if m else None


def typed(tags: Column, key: str, kind: str) -> Column:
    """A tag as bigint, int, double or boolean; null where it isn't one."""
    return F.try_element_at(tags, F.lit(key)).try_cast(kind)


def tag(tags: Column, key: str) -> Column:
    """A tag, empty where there is none."""
    return F.coalesce(F.try_element_at(tags, F.lit(key)), F.lit(""))


def tag_list(values: Column) -> Column:
    """A list of strings as the JSON that tags hold."""
    return F.to_json(values)


def parsed_tag_list(text: Column) -> Column:
    return F.from_json(text, "array<string>")


def natural_key(name: str) -> tuple:
    """Sorts file names so that numbers in them count as numbers."""
    return tuple((0, int(p), "") if p.isdigit() else (1, 0, p) for p in re.split(r"(\d+)", name.lower()) if p)


# --- columns of the above, and more -------------------------------------------------


@F.pandas_udf(T.StringType())
def readable_duration(seconds: pd.Series) -> pd.Series:
    """``duration_text`` of a column."""
    return seconds.map(duration_text, na_action="ignore").astype(object)


@F.pandas_udf(T.StringType())
def readable_text(text: pd.Series) -> pd.Series:
    """``printable`` of a column."""
    return text.map(printable, na_action="ignore").astype(object)


def natural_order(name: Column) -> Column:
    """A text that sorts as ``natural_key``, for numbers of up to 20 digits."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.ltrim(p, F.lit("0")), 20, "0")).otherwise(p)), "")


def readable_datetime(seconds: Column) -> Column:
    """Seconds since 1970 as date and time of the session's zone."""
    return datetime_text(F.timestamp_seconds(F.floor(seconds)))


def datetime_text(at: Column) -> Column:
    """Date and time; years of more than four figures have no sign before them."""
    return F.ltrim(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit("+"))


def split_trimmed(text: Column, mark: str, trim: bool = True, skip_empty: bool = True) -> Column:
    """Parts between marks, trimmed, without empty ones."""
    parts = F.split(text, re.escape(mark))
    parts = F.transform(parts, lambda p: F.trim(p, F.lit(" \t\n\r"))) if trim else parts
    return F.filter(parts, lambda p: p != "") if skip_empty else parts


def same_text(a: Column, b: Column) -> Column:
    """Whether two texts are equal but for case."""
    return F.lower(a) == F.lower(b)


def leading_number(text: Column) -> Column:
    """The number below 2^32 that a text starts with; null if there is none."""
    n = F.regexp_extract(text, r"^(\d+)", 1).try_cast("decimal(38,0)")
    return F.when(n < 1 << 32, n).cast("long")


def url_text(text: Column) -> Column:
    """A text with its percent codes and pluses decoded; null where a code is broken."""
    return F.try_url_decode(text)


def query_values(url: Column) -> Column:
    """The decoded name=value pairs of a URL's query, the last of a name deciding."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(url_text(F.substring_index(p, "=", 1)).alias("k"), F.when(p.contains("="), url_text(F.substring(p, F.instr(p, "=") + 1, F.length(p)))).otherwise("").alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def path_spec(text: str) -> dict[str, object]:
    """A path, a URI or a JSON object as handler, path chunks and extras."""
    import json
    from urllib.parse import parse_qsl, unquote

    if text.lstrip().startswith("{"):
        spec = json.loads(text)
        chunks = spec.pop("chunks", [])
        return {"handler": spec.pop("storage", "diskfile"), "chunks": chunks, "extras": spec}
    if m := re.fullmatch(r"([A-Za-z][\w+.-]+)://?([^?]*)(?:\?(.*))?", text):
        return {"handler": m[1], "chunks": [unquote(m[2])], "extras": dict(parse_qsl(m[3] or ""))}
    return {"handler": "diskfile", "chunks": [text], "extras": {}}


def merged_map(base: Column, more: Column) -> Column:
    """Two tag maps in one, the second deciding, under any session setting."""
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(more, k))
    return F.map_concat(kept, more)


def enum_names(number: Column, names: tuple[str, ...] | Mapping[int, str]) -> Column:
    """The name of a number; null where there is none."""
    pairs = names.items() if isinstance(names, Mapping) else enumerate(names)
    out = F.lit(None).cast("string")
    for n, name in pairs:
        out = F.when(number == n, F.lit(name)).otherwise(out)
    return out
