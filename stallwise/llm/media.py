"""Media columns: Netpbm and BMP images decoded to numpy, area-resized, tiled as NPY and hashed.

Images are values of a binary column, so a store, a scan and a decode are ordinary Spark stages and each
row is independent: no shuffle, and a lost executor only redoes its own rows.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.session import ship_package

#: Bytes of one square of samples; payloads are padded to a multiple of it.
BLOCK = 576
WIDTH = 24


# -- formats -----------------------------------------------------------------------------------------


def encode_pgm(samples: np.ndarray) -> bytes:
    h, w = samples.shape
    return b"P5\n%d %d\n255\n" % (w, h) + np.ascontiguousarray(samples).tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """An 8-bit palette BMP, rows bottom-up and padded to four bytes."""
    h, w = samples.shape
    stride = (w + 3) // 4 * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, :w] = samples[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1)
    palette[:, 3] = 0
    start = 14 + 40 + 1024
    head = b"BM" + struct.pack("<IHHI", start + rows.size, 0, 0, start)
    info = struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, rows.size, 0, 0, 256, 0)
    return head + info + palette.tobytes() + rows.tobytes()


def _netpbm_header(data: bytes, fields: int) -> tuple[list[int], int]:
    """The header's numbers and where the raster starts; ``#`` comments run to the end of a line."""
    values: list[int] = []
    at = 2
    while len(values) < fields:
        while at < len(data) and (data[at : at + 1].isspace() or data[at : at + 1] == b"#"):
            if data[at : at + 1] == b"#":
                end = data.find(b"\n", at)
                at = len(data) if end < 0 else end
            at += 1
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("netpbm header ends early")
        values.append(int(data[at:end]))
        at = end
    return values, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as (height, width) or (height, width, 3); bitmaps give 0 for black and 255 for white."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a netpbm image")
    bitmap, colour, plain = kind in (b"P1", b"P4"), kind in (b"P3", b"P6"), kind in (b"P1", b"P2", b"P3")
    head, at = _netpbm_header(data, 2 if bitmap else 3)
    w, h = head[:2]
    shape = (h, w, 3) if colour else (h, w)
    count = int(np.prod(shape))
    if kind == b"P4":
        packed = np.frombuffer(data, np.uint8, h * ((w + 7) // 8), at).reshape(h, -1)
        return (1 - np.unpackbits(packed, axis=1)[:, :w]) * np.uint8(255)
    if kind == b"P1":
        bits = np.frombuffer(data[at - 1 :].translate(None, b" \t\r\n\x0b\x0c"), np.uint8)[:count]
        return ((1 - (bits - 48)) * 255).astype(np.uint8).reshape(shape)
    wide = head[2] > 255
    if plain:
        out = np.array(data[at - 1 :].split()[:count], dtype=np.int64).astype(np.uint16 if wide else np.uint8)
    else:
        out = np.frombuffer(data, ">u2" if wide else np.uint8, count, at).astype(np.uint16 if wide else np.uint8)
    return out.reshape(shape)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits; a grey palette gives (height, width)."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    start, size = struct.unpack_from("<II", data, 10)
    w, h, _, bits, packing = struct.unpack_from("<iiHHI", data, 18)
    if packing not in (0, 3) or bits not in (1, 4, 8, 24, 32):
        raise ValueError("unsupported BMP")
    stride = (w * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(h), start).reshape(abs(h), stride)
    if h > 0:
        rows = rows[::-1]
    if bits >= 24:
        return np.ascontiguousarray(rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1])
    if bits == 8:
        index = rows[:, :w]
    elif bits == 4:
        index = np.stack([rows >> 4, rows & 15], axis=2).reshape(abs(h), -1)[:, :w]
    else:
        index = np.unpackbits(rows, axis=1)[:, :w]
    used = struct.unpack_from("<I", data, 46)[0] or 1 << bits
    palette = np.frombuffer(data, np.uint8, used * 4, 14 + size).reshape(-1, 4)
    if (palette[:, 0] == palette[:, 1]).all() and (palette[:, 1] == palette[:, 2]).all():
        return palette[:, 0][index]
    return palette[:, 2::-1][index]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


# -- features ----------------------------------------------------------------------------------------


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell's area, fractions of samples included, by an integral image."""
    grey = image.mean(axis=2) if image.ndim == 3 else image
    h, w = grey.shape
    total = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(grey, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])
    at = lambda n, m: np.linspace(0, n, m + 1)
    ys, xs = at(h, height), at(w, width)

    def between(a: np.ndarray, p: np.ndarray) -> np.ndarray:
        low = np.minimum(p.astype(int), a.shape[0] - 2)
        part = (p - low)[:, None]
        return a[low] * (1 - part) + a[low + 1] * part

    corner = between(between(total, ys).T, xs).T
    cell = corner[1:, 1:] - corner[:-1, 1:] - corner[1:, :-1] + corner[:-1, :-1]
    return cell / (h / height * w / width)


def difference_hash(image: np.ndarray) -> str:
    """64 bits: whether each of 8 by 8 cells is darker than its right neighbour, as 16 hex digits."""
    small = area_resize(image, 8, 9)
    bits = np.round(small[:, 1:], 6) > np.round(small[:, :-1], 6)
    return np.packbits(bits).tobytes().hex()


def npy_tile(image: np.ndarray, side: int = WIDTH) -> bytes:
    """The image resized to a square of 8-bit samples, as the bytes of an NPY file."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(image, side, side)), 0, 255).astype(np.uint8))
    return out.getvalue()


# -- Spark -------------------------------------------------------------------------------------------


def _payload_image(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    payload = data + b"\xff" * (-len(data) % BLOCK or (BLOCK if not data else 0))
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    form = encode_bmp if zlib.crc32(payload) & 1 else encode_pgm
    return len(data), form(samples)


def _chunks(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose ``column`` holds about ``most`` bytes, so that long texts stay bounded."""
    start = held = 0
    for i, value in enumerate(batch.column(column)):
        n = value.as_buffer().size if value.is_valid else 0
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in _chunks(whole, "_text"):
            made = [_payload_image(t) for t in batch.column("_text").to_pylist()]
            keys = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*keys, pa.array([n for n, _ in made], pa.int64()), pa.array([m for _, m in made], pa.binary())],
                [*batch.schema.names[:-1], "n_bytes", "media"],
            )


def store_texts_as_media(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keys``, ``n_bytes`` and ``media``: each text's padded UTF-8 bytes as an 8-bit image.

    Half of the payloads, by their checksum, are binary PGM and half are 8-bit BMP. A null or empty text
    gives one block of padding. The image holds every byte, and equal texts give equal images.
    """
    ship_package(docs.sparkSession)
    picked = docs.select(*keys, F.col(text).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(_store, f"{fields}, n_bytes long, media binary")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in _chunks(whole, "media"):
            rows = []
            for data in batch.column("media").to_pylist():
                if data is None:
                    rows.append((None,) * 8)
                    continue
                image = decode(data)
                payload = image.tobytes()
                rows.append((image.shape[0], image.shape[1], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), hashlib.sha256(data).hexdigest(), difference_hash(image), npy_tile(image)))
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            names = ["height", "width", "payload_bytes", "payload_sha256", "tail_crc32", "media_sha256", "dhash", "tile"]
            keys = [n for n in batch.schema.names if n != "media"]
            columns = [batch.column(n) for n in keys] + [pa.array(col, kind) for col, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, [*keys, *names])


def media_features(media: DataFrame) -> DataFrame:
    """Decode column ``media`` and describe each image; every other column is carried along.

    Adds height, width, payload_bytes, payload_sha256, tail_crc32 (of the decoded samples), media_sha256 (of
    the stored bytes), dhash and tile (an NPY file). A null image gives nulls. A value that is neither
    Netpbm nor BMP fails the job: it is damage, not a case.
    """
    ship_package(media.sparkSession)
    made = ("height", "width", "payload_bytes", "payload_sha256", "tail_crc32", "media_sha256", "dhash", "tile")
    media = media.select(*[c for c in media.columns if c not in made and c != "media"], "media")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema.fields[:-1])
    schema = "height int, width int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, dhash string, tile binary"
    return media.mapInArrow(_read, f"{fields}, {schema}" if fields else schema)
