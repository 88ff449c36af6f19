"""Text forms of record formats: content blocks and their image and audio specs."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names used in recordings, in the order of their numbers.
CONTENT_TYPES = ("custom", "empty", "data_layout", "image", "audio")
IMAGE_FORMATS = ("undefined", "raw", "jpg", "png", "video", "jxl", "custom_codec")
PIXEL_FORMATS = (
    "undefined", "grey8", "bgr8", "depth32f", "rgb8", "yuv_i420_split", "rgba8", "rgb10", "rgb12", "grey10", "grey12", "grey16", "rgb32F", "scalar64F",
    "yuy2", "rgb_ir_4x4", "rgba32F", "bayer8_rggb", "raw10", "raw10_bayer_rggb", "raw10_bayer_bggr", "yuv_420_nv21", "yuv_420_nv12", "grey10packed",
    "bayer8_bggr", "bayer10_gbrg", "bayer8_gbrg",
)
AUDIO_FORMATS = ("undefined", "pcm", "opus")
SAMPLE_FORMATS = (
    "undefined", "int8", "uint8", "uint8alaw", "uint8mulaw", "int16le", "uint16le", "int16be", "uint16be", "int24le", "uint24le", "int24be", "uint24be",
    "int32le", "uint32le", "int32be", "uint32be", "float32le", "float32be", "float64le", "float64be",
)
#: Bytes per pixel of formats that store pixels in whole bytes, one after the other.
BYTES_PER_PIXEL = {
    "grey8": 1, "rgb_ir_4x4": 1, "bayer8_rggb": 1, "bayer8_bggr": 1, "bayer8_gbrg": 1, "grey10": 2, "grey12": 2, "grey16": 2, "bayer10_gbrg": 2,
    "rgb8": 3, "bgr8": 3, "depth32f": 4, "rgba8": 4, "rgb10": 6, "rgb12": 6, "scalar64F": 8, "rgb32F": 12, "rgba32F": 16,
}
RAW10 = ("raw10", "raw10_bayer_rggb", "raw10_bayer_bggr")
HALF_PLANES = {"yuv_i420_split": 3, "yuv_420_nv21": 2, "yuv_420_nv12": 2}

ATTRIBUTE = re.compile(r"(\w+)=(.*)")
SIZE = re.compile(r"(\d+)x(\d+)")


@dataclass
class Block:
    """A content block: its kind and attributes; ``size`` None where unknown."""

    kind: str
    format: str = ""
    size: int | None = None
    attributes: dict[str, str] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> Block:
        kind, *parts = text.split("/")
        block = cls(kind if kind in CONTENT_TYPES else "custom")
        for part in parts:
            if (m := ATTRIBUTE.fullmatch(part)) and m[1] == "size":
                block.size = int(m[2])
            elif m:
                block.attributes.setdefault(m[1], m[2])
            elif m := SIZE.fullmatch(part):
                block.attributes.update(width=m[1], height=m[2])
            elif part in SAMPLE_FORMATS and block.kind == "audio" and block.format:
                block.attributes["sample"] = part
            else:
                block.format = part
        return block

    def text(self) -> str:
        a = dict(self.attributes)
        out = [self.kind, *([self.format] if self.format else [])]
        if "width" in a:
            out.append(f"{a.pop('width')}x{a.pop('height')}")
        if "sample" in a:
            out.append(a.pop("sample"))
        out += [f"{k}={v}" for k, v in a.items()]
        return "/".join([*out, *([f"size={self.size}"] if self.size is not None else [])])


def parse_format(text: str) -> list[Block]:
    """``block+block`` as blocks; an empty text is one empty block."""
    return [Block.parse(b) for b in text.split("+")] if text else [Block("empty")]


def format_text(blocks: Sequence[Block]) -> str:
    return "+".join(b.text() for b in blocks)


def format_tags(tags: Mapping[str, str]) -> dict[tuple[str, int], list[Block]]:
    """Formats by (record type, version) from a stream's private tags ``RF:Type:version``."""
    found = {}
    for name, value in tags.items():
        if m := re.fullmatch(r"RF:(\w+):(\d+)", name):
            found[m[1].lower(), int(m[2])] = parse_format(value)
    return found


def block_sizes(sizes: Sequence[int | None], total: int) -> list[int | None]:
    """Each block's size in a record of ``total`` bytes.

    A known size stands; the one unknown block takes what the others leave; several
    unknown blocks stay unknown but for the last one that can be told.
    """
    unknown = [i for i, s in enumerate(sizes) if s is None]
    out = list(sizes)
    if len(unknown) == 1:
        rest = total - sum(s for s in sizes if s is not None)
        out[unknown[0]] = rest if rest >= 0 else None
    return out


# --- columns -----------------------------------------------------------------------


def default_stride(pixel: Column, width: Column) -> Column:
    """Bytes of a line of the first plane; null where the format is unknown."""
    whole = F.lit(None).cast("long")
    for name, n in BYTES_PER_PIXEL.items():
        whole = F.when(pixel == name, width * n).otherwise(whole)
    packed = F.ceil(width / 4) * 5  # four pixels in five bytes
    return (
        F.when(pixel.isin(*RAW10, "grey10packed"), packed)
        .when(pixel == "yuy2", F.ceil(width / 2) * 4)
        .when(pixel.isin(*HALF_PLANES), width)
        .otherwise(whole)
        .cast("long")
    )


def raw_image_size(pixel: Column, width: Column, height: Column, stride: Column, stride_2: Column) -> Column:
    """Bytes of a raw image over all planes; zero strides stand for the default."""
    first = F.when(stride > 0, stride).otherwise(default_stride(pixel, width))
    half = F.ceil(height / 2)
    own_2 = F.when(pixel == "yuv_i420_split", F.ceil(width / 2)).otherwise(width + width % 2)
    second = F.when(stride_2 > 0, stride_2).otherwise(own_2)
    more = F.when(pixel == "yuv_i420_split", second * half * 2).when(pixel.isin("yuv_420_nv21", "yuv_420_nv12"), second * half).otherwise(0)
    return F.when((width > 0) & (height > 0), first * height + more).cast("long")


def normalised_pixel(pixel: Column, grey16: bool = False) -> Column:
    """The format that frames of ``pixel`` are normalised to."""
    deep = "grey16" if grey16 else "grey8"
    return (
        F.when(pixel.isin("rgb8", "rgba8", "bgr8", "rgb10", "rgb12", "yuv_i420_split", "yuy2", "yuv_420_nv21", "yuv_420_nv12", "rgb32F", "rgba32F"), "rgb8")
        .when(pixel.isin("grey10", "grey12", "grey16", "raw10", "raw10_bayer_rggb", "raw10_bayer_bggr", "grey10packed", "bayer10_gbrg"), deep)
        .otherwise("grey8")
    )


def sample_bytes(sample: Column) -> Column:
    """Bytes of one sample, from the digits in its format's name."""
    return (F.regexp_extract(sample, r"(\d+)", 1).try_cast("int") / 8).cast("int")


def audio_block_size(sample: Column, channels: Column, stride: Column, count: Column) -> Column:
    """Bytes of ``count`` PCM frames; a zero stride stands for the packed one."""
    return count * F.when(stride > 0, stride).otherwise(sample_bytes(sample) * channels)


def sample_count(size: Column, stride: Column) -> Column:
    """Frames in ``size`` bytes; null unless they divide."""
    return F.when((stride > 0) & (size % stride == 0), (size / stride).cast("long"))


def resized(width: Column, height: Column, to_width: Column, to_height: Column, align: int = 1) -> Column:
    """Struct(width, height) of a resize; 0 means free, both given are taken as they are.

    A free side keeps the ratio, rounded half up and then up to ``align``.
    """

    def fit(value: Column) -> Column:
        return (F.ceil(F.floor(value + 0.5) / align) * align).cast("long")

    w = F.when(to_width > 0, to_width).when(to_height > 0, fit(to_height * width / height)).otherwise(width)
    h = F.when(to_height > 0, to_height).when(to_width > 0, fit(to_width * height / width)).otherwise(height)
    return F.struct(w.cast("long").alias("width"), h.cast("long").alias("height"))


def scaled(width: Column, height: Column, ratio: float, align_w: int = 1, align_h: int = 1) -> Column:
    """Struct(width, height) of a resize by a ratio; the height follows the aligned width."""
    w = F.ceil(F.floor(width * ratio + 0.5) / align_w) * align_w
    h = F.ceil(F.floor(w * height / width + 0.5) / align_h) * align_h
    return F.struct(w.cast("long").alias("width"), h.cast("long").alias("height"))
