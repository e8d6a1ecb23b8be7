"""Difference hashes of image bytes: decoded in Arrow batches, reduced to 9 x 8 grey by a separable Lanczos filter.

PGM, PPM (8 bits a sample) and PNG (8 bits, no interlace) are decoded here, other formats by Pillow where it is installed.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from stallwise.session import ship_package

#: Grey of red, green and blue in 65536ths; the hash's size; the filter's lobes. Fixed values.
GREY = (19595, 38470, 7471)
WIDTH, HEIGHT, LOBES = 9, 8, 3
MOST_PIXELS = 1 << 28


def _netpbm(data: bytes) -> np.ndarray | None:
    m = re.match(rb"P([56])(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)\s", data)
    if m is None:
        return None
    w, h, top, planes = int(m[2]), int(m[3]), int(m[4]), 1 if m[1] == b"5" else 3
    if not (0 < w * h <= MOST_PIXELS and 0 < top < 256) or len(data) - m.end() < w * h * planes:
        return None
    raw = np.frombuffer(data, np.uint8, w * h * planes, m.end()).reshape(h, w, planes)
    return raw if top == 255 else (np.minimum(raw, top).astype(np.int64) * 255 // top).astype(np.uint8)


def _png(data: bytes) -> np.ndarray | None:
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, head, palette, packed = 8, None, None, []
    while at + 12 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size] or b"\0" * 4)[0]:
            return None
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    if head is None or head[2] != 8 or head[6] != 0 or head[3] not in (0, 2, 3, 4, 6) or not 0 < head[0] * head[1] <= MOST_PIXELS:
        return None
    w, h, planes = head[0], head[1], {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[head[3]]
    rows = zlib.decompressobj().decompress(b"".join(packed), h * (w * planes + 1))
    if len(rows) != h * (w * planes + 1):
        return None
    lines, above, out = np.frombuffer(rows, np.uint8).reshape(h, -1), np.zeros(w * planes, np.uint8), np.empty((h, w * planes), np.uint8)
    for y in range(h):
        above = out[y] = _unfiltered(int(lines[y, 0]), lines[y, 1:], above, planes)
    image = out.reshape(h, w, planes)
    if head[3] == 3:
        return None if palette is None or image.max() >= len(palette) else palette[image[:, :, 0]]
    return image[:, :, : planes - 1] if planes in (2, 4) else image


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, planes: int) -> np.ndarray:
    """A PNG line without its filter, by the format's rules."""
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        return np.cumsum(line.reshape(-1, planes), axis=0, dtype=np.uint8).reshape(-1)
    if kind not in (3, 4):
        raise ValueError("no such filter")
    done, up = [0] * planes + line.tolist(), [0] * planes + above.tolist()
    for i in range(planes, len(done)):
        a, b, c = done[i - planes], up[i], up[i - planes]
        if kind == 3:
            guess = (a + b) // 2
        else:
            guess = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
        done[i] = (done[i] + guess) & 255
    return np.array(done[planes:], np.uint8)


def _other(data: bytes) -> np.ndarray | None:
    try:
        import io

        from PIL import Image
    except ImportError:
        return None
    return np.asarray(Image.open(io.BytesIO(data)).convert("RGB"))


def grey(pixels: np.ndarray) -> np.ndarray:
    """Height x width of one or three planes as 8-bit grey."""
    if pixels.shape[2] == 1:
        return pixels[:, :, 0]
    return ((pixels.astype(np.int64) @ np.array(GREY) + 0x8000) >> 16).astype(np.uint8)


def weights(size: int, out: int) -> np.ndarray:
    """An ``out`` x ``size`` matrix of a Lanczos filter that is widened when it reduces; rows sum to about 2^22."""
    scale = size / out
    wide = max(scale, 1.0)
    centre = (np.arange(out) + 0.5) * scale
    low = np.maximum((centre - LOBES * wide + 0.5).astype(np.int64), 0)[:, None]
    high = np.minimum((centre + LOBES * wide + 0.5).astype(np.int64), size)[:, None]
    at = np.arange(size)[None, :]
    x = (at + 0.5 - centre[:, None]) / wide
    w = np.where((at >= low) & (at < high) & (np.abs(x) < LOBES), np.sinc(x) * np.sinc(x / LOBES), 0.0)
    return np.rint(w / w.sum(axis=1, keepdims=True) * (1 << 22)).astype(np.int64)


def reduced(image: np.ndarray, width: int = WIDTH, height: int = HEIGHT) -> np.ndarray:
    """8-bit grey at another size, columns first, rounded to 8 bits after each direction."""
    rounded = lambda x: np.clip((x + (1 << 21)) >> 22, 0, 255)
    block = max(1, (1 << 22) // max(1, image.shape[1]))
    across, flat = weights(image.shape[1], width).T, []
    for y in range(0, image.shape[0], block):
        flat.append(rounded(image[y : y + block].astype(np.int64) @ across))
    return rounded(weights(image.shape[0], height) @ np.concatenate(flat)).astype(np.uint8)


def hash_of(data: bytes | None) -> str | None:
    """16 hex digits, a bit for each pixel that is brighter than its right neighbour; None for what is no whole image."""
    if not data:
        return None
    try:
        for decode in (_netpbm, _png, _other):
            pixels = decode(bytes(data))
            if pixels is not None:
                small = reduced(grey(pixels))
                return np.packbits(small[:, :-1] > small[:, 1:]).tobytes().hex()
    except (ValueError, OSError, zlib.error, struct.error, SyntaxError):
        pass
    return None


def image_hash_of_bytes(content: Column) -> Column:
    """The difference hash of a binary column's images, null for damaged bytes."""
    ship_package(SparkSession.active())

    @F.pandas_udf("string")
    def hashed(content: pd.Series) -> pd.Series:
        return content.map(hash_of, na_action="ignore").astype(object).where(lambda s: s.notna(), None)

    return hashed(content)
