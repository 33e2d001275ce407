"""Baseline JPEG encoding of slices, whole images as numpy arrays: no image library is needed.

Colour is kept at full resolution and the code tables are built for each image from its own symbol counts.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The standard's example quantisation tables for brightness and colour, row by row.
BRIGHTNESS = (
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
)
COLOUR = (
    17, 18, 24, 47, 99, 99, 99, 99,
    18, 21, 26, 66, 99, 99, 99, 99,
    24, 26, 56, 99, 99, 99, 99, 99,
    47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
)
QUALITY = 75
LONGEST = 16  # bits of a code

#: Diagonal by diagonal, in alternating direction.
ZIGZAG = np.array([i * 8 + j for i, j in sorted(np.ndindex(8, 8), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))])
_K = np.arange(8)
DCT = np.cos(np.pi * _K[:, None] * (2 * _K + 1) / 16) / 2
DCT[0] /= np.sqrt(2)


def scaled(table: tuple[int, ...], quality: int) -> np.ndarray:
    """The table at a quality of 1 to 100; 50 is the table itself."""
    percent = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(table) * percent + 50) // 100, 1, 255)


def code_lengths(counts: np.ndarray) -> dict[int, int]:
    """Code length of each symbol that occurs, ``LONGEST`` at most, by package-merge.

    A stand-in that never occurs takes the last of the longest codes, which would be all ones and is not allowed.
    """
    single = sorted([(0, (-1,))] + [(int(n), (s,)) for s, n in enumerate(counts) if n])
    packages: list = []
    for _ in range(LONGEST):
        row = sorted(single + packages)
        packages = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(row[::2], row[1::2])]
    lengths: dict[int, int] = {}
    for _, symbols in row[: 2 * len(single) - 2]:
        for s in symbols:
            lengths[s] = lengths.get(s, 0) + 1
    return lengths


def code_table(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Codes and lengths by symbol, and the table as it is written: symbols a length, then the symbols in order."""
    lengths = code_lengths(counts)
    order = sorted(lengths, key=lambda s: (lengths[s], s < 0, s))
    codes, sizes, code, last = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    for s in order:
        code <<= lengths[s] - last
        last = lengths[s]
        if s >= 0:
            codes[s], sizes[s] = code, last
        code += 1
    real = [s for s in order if s >= 0]
    return codes, sizes, bytes(sum(lengths[s] == n for s in real) for n in range(1, LONGEST + 1)) + bytes(real)


def _size(v: np.ndarray) -> np.ndarray:
    """Bits of the absolute value."""
    return np.ceil(np.log2(np.abs(v) + 1)).astype(np.int64)


def _rest(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bits that follow a size: the value, or for a negative one what it lies above the smallest of its size."""
    return np.where(v < 0, v + (1 << size) - 1, v)


def _blocks(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Quantised coefficients of 8 x 8 blocks, in zigzag order."""
    h, w = plane.shape
    cells = plane.reshape(h // 8, 8, w // 8, 8).swapaxes(1, 2).reshape(-1, 8, 8)
    return np.rint((DCT @ cells @ DCT.T).reshape(-1, 64) / table).astype(np.int64)[:, ZIGZAG]


def _segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body


def encode(image: np.ndarray, quality: int = QUALITY) -> bytes:
    """A JFIF file of an image ``(height, width)`` or ``(height, width, 3)`` with values 0 to 255; others are clipped."""
    image = np.clip(np.rint(image), 0, 255).astype(float)
    if image.ndim == 3 and image.shape[2] == 1:
        image = image[:, :, 0]
    if image.ndim not in (2, 3) or (image.ndim == 3 and image.shape[2] != 3) or not image.size or max(image.shape) > 65535:
        raise ValueError(f"not an image of one or three channels: {image.shape}")
    if not 1 <= quality <= 100:
        raise ValueError("quality is 1 to 100")
    height, width = image.shape[:2]
    image = np.pad(image, [(0, -height % 8), (0, -width % 8)] + [(0, 0)] * (image.ndim - 2), "edge")
    tables = [scaled(BRIGHTNESS, quality), scaled(COLOUR, quality)]
    if image.ndim == 2:
        planes = [image]
    else:
        y = image @ (0.299, 0.587, 0.114)
        planes = [y, (image[:, :, 2] - y) / 1.772 + 128, (image[:, :, 0] - y) / 1.402 + 128]
    parts = [_blocks(p - 128, tables[min(i, 1)]) for i, p in enumerate(planes)]
    steps = [np.diff(p[:, 0], prepend=0) for p in parts]
    coefficients = np.stack(parts, 1).reshape(-1, 64)  # interleaved: one block of each channel
    dc = np.stack(steps, 1).reshape(-1)

    # symbols, each at a place block * 128 + position; runs of 16 zeros come just before the coefficient behind them
    block, at = np.nonzero(coefficients[:, 1:])
    value = coefficients[block, at + 1]
    first = np.diff(block, prepend=-1) != 0
    run = at - np.where(first, 0, np.concatenate([[0], at[:-1] + 1]))
    long = np.repeat(np.arange(len(at)), run >> 4)
    size = _size(value)
    last = np.zeros(len(coefficients), np.int64)
    np.maximum.at(last, block, at + 1)
    short = np.flatnonzero(last < 63)
    dc_size = _size(dc)
    place = np.concatenate([np.arange(len(dc)) * 128, block[long] * 128 + at[long] + 1, block * 128 + at + 1, short * 128 + 127])
    kind = np.repeat([0, 1, 2, 3], [len(dc), len(long), len(at), len(short)])
    symbol = np.concatenate([dc_size, np.full(len(long), 0xF0), (run & 15) << 4 | size, np.zeros(len(short), np.int64)])
    extra = np.concatenate([_rest(dc, dc_size), np.zeros(len(long), np.int64), _rest(value, size), np.zeros(len(short), np.int64)])
    width_of = np.concatenate([dc_size, np.zeros(len(long), np.int64), size, np.zeros(len(short), np.int64)])
    first_codes = code_table(np.bincount(dc_size, minlength=256))
    other = code_table(np.bincount(symbol[kind > 0], minlength=256))
    code = np.where(kind == 0, first_codes[0][symbol], other[0][symbol])
    length = np.where(kind == 0, first_codes[1][symbol], other[1][symbol])
    order = np.lexsort((kind, place))
    fields = np.stack([code[order], extra[order]], 1).reshape(-1)
    sizes = np.stack([length[order], width_of[order]], 1).reshape(-1)
    which = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(which)) - 1
    bits = (fields[which] >> left & 1).astype(np.uint8)
    data = np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes().replace(b"\xff", b"\xff\x00")

    n = len(planes)
    out = b"\xff\xd8" + _segment(0xE0, b"JFIF\0" + struct.pack(">HBHHBB", 0x0101, 0, 1, 1, 0, 0))
    for i, t in enumerate(tables[: min(n, 2)]):
        out += _segment(0xDB, bytes([i]) + bytes(t[ZIGZAG].tolist()))
    out += _segment(0xC0, struct.pack(">BHHB", 8, height, width, n) + b"".join(bytes([i + 1, 0x11, min(i, 1)]) for i in range(n)))
    out += _segment(0xC4, b"\x00" + first_codes[2]) + _segment(0xC4, b"\x10" + other[2])
    out += _segment(0xDA, bytes([n]) + b"".join(bytes([i + 1, 0]) for i in range(n)) + bytes([0, 63, 0]))
    return out + data + b"\xff\xd9"


def jpeg(pixels: str | Column, height: str | Column, width: str | Column, quality: int = QUALITY) -> Column:
    """A JPEG file of a flattened row-major array of one or three values a pixel; a null argument gives null."""

    @F.pandas_udf("binary")
    def run(pixels: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
        out = []
        for p, h, w in zip(pixels, height, width, strict=True):
            known = p is not None and not pd.isna(h) and not pd.isna(w)
            out.append(encode(np.asarray(p, float).reshape(int(h), int(w), -1), quality) if known else None)
        return pd.Series(out, dtype=object)

    return run(*(F.col(c) if isinstance(c, str) else c for c in (pixels, height, width)))
