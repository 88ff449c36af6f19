"""Image and audio payloads: frames to plain pixels, quality measures, WAV and PNG.

Bytes need Python here; everything is numpy over Arrow batches.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tracklode.functions.formats import BYTES_PER_PIXEL, RAW10


def lines(data: bytes, width_bytes: int, height: int, stride: int = 0) -> np.ndarray:
    """height x width_bytes bytes, without what a stride adds to a line."""
    stride = stride or width_bytes
    flat = np.frombuffer(data, np.uint8, (height - 1) * stride + width_bytes)
    return np.lib.stride_tricks.as_strided(flat, (height, width_bytes), (stride, 1))


def five_bytes(data: bytes, width: int, height: int, stride: int = 0) -> np.ndarray:
    """Four 10-bit pixels from every five bytes: the fifth holds the low bits."""
    groups = (width + 3) // 4
    raw = lines(data, groups * 5, height, stride).reshape(height, groups, 5).astype(np.uint16)
    low = (raw[:, :, 4:5] >> np.array([0, 2, 4, 6], np.uint16)) & 3
    return ((raw[:, :, :4] << 2) | low).reshape(height, groups * 4)[:, :width]


def yuyv(data: bytes, width: int, height: int, stride: int = 0) -> np.ndarray:
    """RGB from pairs of pixels that share their colour, in whole numbers."""
    pairs = (width + 1) // 2
    raw = lines(data, pairs * 4, height, stride).reshape(height, pairs, 4).astype(np.int32)
    y = raw[:, :, [0, 2]].reshape(height, pairs * 2)
    u, v = (np.repeat(raw[:, :, k], 2, axis=1) - 128 for k in (1, 3))
    c = (y - 16) * 298
    rgb = np.stack([(c + 409 * v + 128) >> 8, (c - 100 * u - 208 * v + 128) >> 8, (c + 516 * u + 128) >> 8], axis=2)
    return np.clip(rgb, 0, 255).astype(np.uint8)[:, :width]


def depth_grey(values: np.ndarray, low: float | None = None, high: float | None = None, nan: int = 0) -> np.ndarray:
    """Floats as 8 bits over a range, the image's own where none is given; NaN as ``nan``."""
    good = np.isfinite(values)
    if low is None or high is None:
        low, high = (values[good].min(), values[good].max()) if good.any() else (0.0, 1.0)
    span = high - low if high > low else 1.0
    out = np.clip((np.where(good, values, low) - low) / span * 255, 0, 255).astype(np.uint8)
    return np.where(good, out, np.uint8(nan))


def percentile_range(values: np.ndarray, low: float = 5, high: float = 95, most: int = 5000) -> tuple[float, float]:
    """Percentiles of the positive finite values, of an even spread of ``most`` of them."""
    good = values[np.isfinite(values) & (values > 0)].ravel()
    if not len(good):
        return 0.0, 1.0
    if len(good) > most:
        good = good[(np.arange(most) * (len(good) / most)).astype(np.int64)]
    return float(np.percentile(good, low)), float(np.percentile(good, high))


def normalised(data: bytes, pixel: str, width: int, height: int, stride: int = 0, grey16: bool = False, nan: int = 0) -> np.ndarray:
    """A raw frame as 8-bit grey, 16-bit grey or 8-bit RGB."""
    deep = {"grey10": 10, "grey12": 12, "grey16": 16, "bayer10_gbrg": 10}
    if pixel in ("grey8", "bayer8_rggb", "bayer8_bggr", "bayer8_gbrg", "rgb_ir_4x4"):
        return lines(data, width, height, stride)
    if pixel in deep or pixel in RAW10 or pixel == "grey10packed":
        bits = deep.get(pixel, 10)
        x = lines(data, width * 2, height, stride).copy().view("<u2") if pixel in deep else five_bytes(data, width, height, stride)
        if grey16:
            return (x << (16 - bits)).astype(np.uint16)
        return (x >> (bits - 8)).astype(np.uint8)
    if pixel in ("rgb8", "bgr8", "rgba8"):
        x = lines(data, width * BYTES_PER_PIXEL[pixel], height, stride).reshape(height, width, -1)
        return x[:, :, [2, 1, 0]] if pixel == "bgr8" else x[:, :, :3]
    if pixel in ("rgb10", "rgb12"):
        x = lines(data, width * 6, height, stride).copy().view("<u2").reshape(height, width, 3)
        return (x >> (int(pixel[3:]) - 8)).astype(np.uint8)
    if pixel == "yuy2":
        return yuyv(data, width, height, stride)
    if pixel in ("yuv_i420_split", "yuv_420_nv12", "yuv_420_nv21"):
        return lines(data, width, height, stride)
    if pixel in ("depth32f", "scalar64F"):
        kind = "<f4" if pixel == "depth32f" else "<f8"
        return depth_grey(lines(data, width * BYTES_PER_PIXEL[pixel], height, stride).copy().view(kind), nan=nan)
    if pixel in ("rgb32F", "rgba32F"):
        x = lines(data, width * BYTES_PER_PIXEL[pixel], height, stride).copy().view("<f4").reshape(height, width, -1)[:, :, :3]
        return np.stack([depth_grey(x[:, :, k], nan=nan) for k in range(3)], axis=2)
    raise ValueError(f"no way to read {pixel}")


def with_palette(classes: np.ndarray, palette: np.ndarray) -> np.ndarray:
    """RGB of an image of class numbers; numbers past the palette wrap around."""
    return palette[classes.astype(np.int64) % len(palette)]


#: Decoders of compressed images by format name; ``register_decoder`` adds to them.
DECODERS: dict[str, Callable[[bytes], np.ndarray]] = {}


def register_decoder(name: str, decoder: Callable[[bytes], np.ndarray]) -> None:
    DECODERS[name] = decoder


def decode_image(data: bytes, name: str) -> np.ndarray:
    if name == "png":
        return png_pixels(data)
    if name not in DECODERS:
        raise LookupError(f"no decoder for {name} images is registered")
    return DECODERS[name](data)


def png_bytes(pixels: np.ndarray) -> bytes:
    """8- or 16-bit grey, RGB or RGBA pixels as a PNG."""
    depth = 16 if pixels.dtype == np.uint16 else 8
    colour = 0 if pixels.ndim == 2 else {3: 2, 4: 6}[pixels.shape[2]]
    raw = pixels.astype(">u2").view(np.uint8) if depth == 16 else pixels
    rows = np.ascontiguousarray(raw).reshape(pixels.shape[0], -1)
    body = b"".join(b"\0" + r.tobytes() for r in rows)

    def part(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], depth, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(body)) + part(b"IEND", b"")


def png_pixels(data: bytes) -> np.ndarray:
    """The pixels of a PNG without interlacing or palette."""
    at, packed, head = 8, b"", b""
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        head = data[at + 8 : at + 8 + n] if kind == b"IHDR" else head
        packed += data[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        at += 12 + n
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", head)
    if interlaced or colour == 3:
        raise ValueError("an interlaced or palette PNG")
    channels = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    step = channels * depth // 8
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * step)
    out, above = np.zeros((height, width * step), np.uint8), np.zeros(width * step, np.uint8)
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:]
        if kind == 2:
            line = line + above
        elif kind:
            own = np.zeros(width * step, np.uint8)
            for x in range(width * step):
                a, b, c = int(own[x - step]) if x >= step else 0, int(above[x]), int(above[x - step]) if x >= step else 0
                near = a + b - c
                guess = (a, 0, (a + b) // 2, min((abs(near - a), 0, a), (abs(near - b), 1, b), (abs(near - c), 2, c))[2])[kind - 1]
                own[x] = (int(line[x]) + guess) & 255
            line = own
        out[y] = above = line
    pixels = out.view(">u2").astype(np.uint16) if depth == 16 else out
    return pixels.reshape(height, width) if channels == 1 else pixels.reshape(height, width, channels)


def psnr(a: np.ndarray, b: np.ndarray) -> float:
    """Peak signal to noise of two 8-bit images; 100 where they are equal."""
    error = np.mean((a.astype(np.float64) - b.astype(np.float64)) ** 2)
    return 100.0 if error == 0 else float(10 * np.log10(255.0**2 / error))


def psnr_column(a: Column, b: Column) -> Column:
    """PSNR of two equally long byte payloads; null where they differ in length."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        pairs = ((np.frombuffer(p or b"", np.uint8), np.frombuffer(q or b"", np.uint8)) for p, q in zip(x, y))
        return pd.Series([psnr(p, q) if len(p) == len(q) > 0 else None for p, q in pairs], dtype="float64")

    return run(a, b)


def psnr_arrays(a: Column, b: Column) -> Column:
    """PSNR of two arrays of numbers from 0 to 255, without Python."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0).cast("double"), lambda s, x: s + x)
    error = total / F.size(a)
    return F.when(error == 0, F.lit(100.0)).otherwise(10 * F.log10(F.lit(255.0**2) / error))


def differing(a: bytes, b: bytes) -> tuple[int, int]:
    """Bytes and bits in which two payloads of one length differ."""
    x = np.bitwise_xor(np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8))
    return int((x != 0).sum()), int(np.bitwise_count(x).sum())


# WAV format codes by sample format.
WAV_CODES = {"int": 1, "uint": 1, "float": 3, "uint8alaw": 6, "uint8mulaw": 7}


def wav_bytes(data: bytes, sample: str, channels: int, rate: int) -> bytes:
    """PCM blocks as a WAV file."""
    bits = int("".join(c for c in sample if c.isdigit()) or 8)
    code = WAV_CODES.get(sample, WAV_CODES["float" if sample.startswith("float") else "int"])
    if sample.endswith("be"):
        data = np.frombuffer(data, np.uint8).reshape(-1, bits // 8)[:, ::-1].tobytes()
    frame = channels * bits // 8
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, code, channels, rate, rate * frame, frame, bits, b"data", len(data))
    return head + data


def image_name(stream_id: str, number: int, ts: float, ending: str) -> str:
    return f"{stream_id}-{number:05d}-{ts:.3f}.{ending}"
