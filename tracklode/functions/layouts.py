"""Self-describing metadata: layout JSON, Spark types, and the packed binary form.

A layout is a list of named, typed pieces.  Pieces of fixed size stand at their offset
in one packed buffer; behind them stands one (offset, length) pair for each variable
piece, then the variable data.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element types by their names in a layout, with struct codes.
SCALARS = {
    "Bool": ("?", T.BooleanType()), "char": ("b", T.ByteType()), "int8_t": ("b", T.ByteType()), "uint8_t": ("B", T.ShortType()), "int16_t": ("h", T.ShortType()),
    "uint16_t": ("H", T.IntegerType()), "int32_t": ("i", T.IntegerType()), "uint32_t": ("I", T.LongType()), "int64_t": ("q", T.LongType()),
    "uint64_t": ("Q", T.DecimalType(20, 0)), "float": ("f", T.FloatType()), "double": ("d", T.DoubleType()),
}
SHAPED = re.compile(r"(Point|Matrix)([234])D([dfi])")
SHAPE_SCALARS = {"d": "double", "f": "float", "i": "int32_t"}
PIECE = re.compile(r"(?:DataPiece)?(Value|Array|Vector|StringMap|String|Enum)(?:<(.*)>)?")


@lru_cache(maxsize=4096)
def coded(name: str) -> tuple[re.Match | None, struct.Struct]:
    """The shape of an element type, and how it is packed."""
    if m := SHAPED.fullmatch(name):
        n = int(m[2])
        return m, struct.Struct(f"<{n * n if m[1] == 'Matrix' else n}{SCALARS[SHAPE_SCALARS[m[3]]][0]}")
    return None, struct.Struct("<" + SCALARS[name][0])


@dataclass(frozen=True)
class Element:
    """An element type: how many scalars, of which kind, and what they form."""

    name: str

    @property
    def shape(self) -> re.Match | None:
        return SHAPED.fullmatch(self.name)

    @property
    def code(self) -> str:
        if m := self.shape:
            n = int(m[2])
            return f"{n * n if m[1] == 'Matrix' else n}{SCALARS[SHAPE_SCALARS[m[3]]][0]}"
        return SCALARS[self.name][0]

    @property
    def size(self) -> int:
        return coded(self.name)[1].size

    def spark_type(self) -> T.DataType:
        if self.name == "string":
            return T.StringType()
        if m := self.shape:
            scalar = SCALARS[SHAPE_SCALARS[m[3]]][1]
            if m[1] == "Matrix":
                return T.ArrayType(T.ArrayType(scalar))
            return T.StructType([T.StructField(c, scalar) for c in "xyzw"[: int(m[2])]])
        return SCALARS[self.name][1]

    def value(self, data: bytes, at: int):
        m, form = coded(self.name)
        got = form.unpack_from(data, at)
        if m:
            n = int(m[2])
            return [list(got[i * n : i * n + n]) for i in range(n)] if m[1] == "Matrix" else dict(zip("xyzw", got))
        return got[0]

    def pack(self, value) -> bytes:
        if m := self.shape:
            flat = [x for row in value for x in row] if m[1] == "Matrix" else [value[c] for c in "xyzw"[: int(m[2])]]
            return struct.pack("<" + self.code, *flat)
        return struct.pack("<" + self.code, value)


def packed_text(value: str) -> bytes:
    raw = value.encode("utf-8")
    return struct.pack("<I", len(raw)) + raw


def text_at(data: bytes, at: int) -> tuple[str, int]:
    """A counted string and where it ends; cut at the buffer's end."""
    if at + 4 > len(data):
        return "", len(data)
    n = struct.unpack_from("<I", data, at)[0]
    return data[at + 4 : at + 4 + n].decode("utf-8", "replace"), min(len(data), at + 4 + n)


@dataclass
class Piece:
    """One named field of a layout."""

    name: str
    kind: str
    element: Element | None
    place: int = 0
    count: int = 1
    required: bool = False
    default: object = None
    tags: Mapping[str, str] = field(default_factory=dict)
    properties: Mapping[str, object] = field(default_factory=dict)

    @property
    def fixed(self) -> bool:
        return self.kind in ("Value", "Enum", "Array")

    @property
    def size(self) -> int:
        return self.element.size * (self.count if self.kind == "Array" else 1) if self.fixed else 0

    def spark_type(self) -> T.DataType:
        if self.kind == "String":
            return T.StringType()
        own = self.element.spark_type()
        if self.kind in ("Array", "Vector"):
            if self.kind == "Array" and self.element.name == "char":
                return T.StringType()
            return T.ArrayType(own)
        return T.MapType(T.StringType(), own) if self.kind == "StringMap" else own

    def matches(self, other: Piece) -> bool:
        return (self.kind, self.size, self.name, self.element) == (other.kind, other.size, other.name, other.element)

    def read(self, fixed: bytes, variable: bytes | None):
        """The value, or None where the buffer doesn't hold it."""
        if self.fixed:
            if self.place + self.size > len(fixed):
                return None
            if self.kind != "Array":
                return self.element.value(fixed, self.place)
            if self.element.name == "char":
                return fixed[self.place : self.place + self.count].split(b"\0")[0].decode("utf-8", "replace")
            return [self.element.value(fixed, self.place + i * self.element.size) for i in range(self.count)]
        if variable is None:
            return None
        if self.kind == "String":
            return variable.decode("utf-8", "replace")
        if self.kind == "Vector":
            if self.element.name == "string":
                return list(self.texts(variable))
            return [self.element.value(variable, i) for i in range(0, len(variable) - self.element.size + 1, self.element.size)]
        out, at = {}, 0
        while at < len(variable):
            key, at = text_at(variable, at)
            if self.element.name == "string":
                out[key], at = text_at(variable, at)
            elif at + self.element.size <= len(variable):
                out[key], at = self.element.value(variable, at), at + self.element.size
            else:
                break
        return out

    @staticmethod
    def texts(variable: bytes) -> Iterator[str]:
        at = 0
        while at < len(variable):
            value, at = text_at(variable, at)
            yield value

    def pack(self, value) -> bytes:
        if self.kind in ("Value", "Enum"):
            return self.element.pack(value)
        if self.kind == "Array":
            if self.element.name == "char":
                return value.encode("utf-8")[: self.count].ljust(self.count, b"\0")
            return b"".join(self.element.pack(v) for v in value[: self.count]).ljust(self.size, b"\0")
        if self.kind == "String":
            return value.encode("utf-8")
        own = packed_text if self.element.name == "string" else self.element.pack
        if self.kind == "Vector":
            return b"".join(map(own, value))
        return b"".join(packed_text(k) + own(v) for k, v in sorted(value.items()))


@dataclass
class Layout:
    """A layout, read from its JSON."""

    pieces: list[Piece]

    @classmethod
    def parse(cls, text: str) -> Layout:
        pieces, at, nth = [], 0, 0
        for p in json.loads(text)["data_layout"]:
            m = PIECE.fullmatch(p["type"])
            element = None if m[1] == "String" else Element(m[2])
            piece = Piece(p["name"], m[1], element, 0, p.get("size", 1), p.get("required", False), p.get("default"), p.get("tags", {}), p.get("properties", {}))
            if piece.fixed:
                piece.place = p.get("offset", at)
                at = piece.place + piece.size
            else:
                piece.place = p.get("index", nth)
                nth += 1
            pieces.append(piece)
        return cls(pieces)

    def text(self) -> str:
        out = []
        for p in self.pieces:
            row: dict = {"name": p.name, "type": f"DataPiece{p.kind}" + (f"<{p.element.name}>" if p.element else "")}
            row["offset" if p.fixed else "index"] = p.place
            if p.kind == "Array":
                row["size"] = p.count
            if p.tags:
                row["tags"] = dict(p.tags)
            if p.required:
                row["required"] = True
            if p.default is not None:
                row["default"] = p.default
            if p.properties:
                row["properties"] = dict(p.properties)
            out.append(row)
        return json.dumps({"data_layout": out})

    @cached_property
    def fixed_size(self) -> int:
        return sum(p.size for p in self.pieces)

    @cached_property
    def n_variable(self) -> int:
        return sum(not p.fixed for p in self.pieces)

    def schema(self) -> T.StructType:
        """The Spark type; units, descriptions and limits become field metadata."""
        return T.StructType([T.StructField(p.name, p.spark_type(), True, {**p.tags, **p.properties}) for p in self.pieces])

    def read(self, data: bytes) -> dict:
        """All pieces of a block; None for what isn't there."""
        base = self.fixed_size + 8 * self.n_variable
        out = {}
        for p in self.pieces:
            variable = None
            if not p.fixed and self.fixed_size + 8 * p.place + 8 <= len(data):
                start, n = struct.unpack_from("<II", data, self.fixed_size + 8 * p.place)
                if base + start + n <= len(data):
                    variable = data[base + start : base + start + n]
            out[p.name] = p.read(data, variable)
        return out

    def size_in(self, data: bytes) -> int | None:
        """Bytes that the block takes; None if its index is broken."""
        base = end = self.fixed_size + 8 * self.n_variable
        if base > len(data):
            return None
        for i in range(self.n_variable):
            start, n = struct.unpack_from("<II", data, self.fixed_size + 8 * i)
            if base + start + n > len(data):
                return None
            end = max(end, base + start + n)
        return end

    def pack(self, values: Mapping[str, object]) -> bytes:
        fixed, index, variable = bytearray(self.fixed_size), [], b""
        for p in sorted(self.pieces, key=lambda p: p.place):
            value = values.get(p.name, p.default)
            if p.fixed:
                if value is not None:
                    fixed[p.place : p.place + p.size] = p.pack(value)
            else:
                data = p.pack(value) if value is not None else b""
                index.append((len(variable), len(data)))
                variable += data
        return bytes(fixed) + b"".join(struct.pack("<II", *i) for i in index) + variable

    def mapped(self, expected: Layout) -> dict[str, Piece | None]:
        """For each expected piece the one here of equal kind, size, name and element type."""
        return {e.name: next((p for p in self.pieces if p.matches(e)), None) for e in expected.pieces}

    def serves(self, expected: Layout) -> bool:
        """Whether every required piece is mapped."""
        found = self.mapped(expected)
        return all(found[e.name] for e in expected.pieces if e.required)


def decoded(block: Column, layout_json: str) -> Column:
    """A binary block as the struct of its layout; an Arrow UDF, as bytes need Python."""
    layout = Layout.parse(layout_json)

    @F.pandas_udf(layout.schema())
    def read(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([layout.read(b or b"") for b in data], columns=[p.name for p in layout.pieces])

    return read(block)


def evolved(value: Column, layout: Layout, expected: Layout) -> Column:
    """A decoded struct in the expected shape: missing pieces are their default."""
    found = layout.mapped(expected)
    out = []
    for e in expected.pieces:
        own = value[e.name] if found[e.name] else F.lit(None).cast(e.spark_type())
        default = F.lit(e.default).cast(e.spark_type()) if isinstance(e.default, (int, float, str, bool)) else None
        out.append((own if default is None else F.coalesce(own, default)).alias(e.name))
    return F.struct(*out)
