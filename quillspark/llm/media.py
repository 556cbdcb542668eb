"""Media columns: Netpbm and BMP images as numpy arrays, area resizing, NPY tiles and difference hashes.

Texts stand in for media where a corpus has none: a text's UTF-8 bytes, filled up with 255 to rows
of 576, are the samples of a PGM image.

Defined results: a null or empty text gives one row of 255s; null doc_ids are kept as null; equal
texts get equal values; an empty table gives an empty result; columns other than doc_id and text are
ignored. Files that no decoder reads give nulls and an error in decode_media, and stop nothing.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

ROW = 576
TILE = (16, 16)


def write_netpbm(image: np.ndarray) -> bytes:
    """Binary PGM (rows, columns) or PPM (rows, columns, 3) of 8-bit samples."""
    kind = b"P5" if image.ndim == 2 else b"P6"
    return kind + b"\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + np.ascontiguousarray(image, np.uint8).tobytes()


def read_netpbm(data: bytes) -> np.ndarray:
    """P2, P3, P5 or P6 with comments, 8-bit or 16-bit samples; samples below a smaller maximum stay as they are."""
    gap = rb"(?:\s|#[^\n]*\n)+"
    head = re.match(rb"P([2356])" + gap + rb"(\d+)" + gap + rb"(\d+)" + gap + rb"(\d+)\s", data)
    if not head:
        raise ValueError("not a Netpbm grey or colour image")
    kind, width, height, most = (int(x) for x in head.groups())
    bands = 3 if kind in (3, 6) else 1
    n = width * height * bands
    if kind < 4:
        values = np.array(re.sub(rb"#[^\n]*", b"", data[head.end() :]).split()[:n], np.uint32)
    else:
        values = np.frombuffer(data, ">u2" if most > 255 else np.uint8, count=n, offset=head.end())
    if len(values) < n or not 0 < most < 65536:
        raise ValueError("truncated Netpbm image")
    return values.astype(np.uint16 if most > 255 else np.uint8).reshape((height, width, 3) if bands == 3 else (height, width))


def write_bmp(image: np.ndarray) -> bytes:
    """Uncompressed 24-bit (rows, columns, 3; red first) or 8-bit grey (rows, columns) BMP, bottom row first."""
    height, width = image.shape[:2]
    grey = image.ndim == 2
    rows = image[::-1] if grey else image[::-1, :, ::-1]
    flat = np.ascontiguousarray(rows, np.uint8).reshape(height, -1)
    flat = np.pad(flat, ((0, 0), (0, -flat.shape[1] % 4)))
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).copy() if grey else np.zeros((0, 4), np.uint8)
    palette[:, 3] = 0
    start = 54 + palette.size
    head = struct.pack("<2sIHHI", b"BM", start + flat.size, 0, 0, start)
    info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8 if grey else 24, 0, flat.size, 2835, 2835, len(palette), 0)
    return head + info + palette.tobytes() + flat.tobytes()


def read_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 8-bit (through its palette), 24-bit or 32-bit BMP; grey if all three channels agree in the palette."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP image")
    start, size, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    colours = struct.unpack_from("<I", data, 46)[0] or 256
    if packed or bits not in (8, 24, 32) or width <= 0 or not height:
        raise ValueError("unsupported BMP image")
    stride = -(-width * bits // 32) * 4
    rows = np.frombuffer(data, np.uint8, count=stride * abs(height), offset=start).reshape(abs(height), stride)
    rows = rows[:, : width * bits // 8]
    rows = rows[::-1] if height > 0 else rows
    if bits == 8:
        palette = np.frombuffer(data, np.uint8, count=4 * colours, offset=14 + size).reshape(-1, 4)[:, 2::-1]
        image = palette[rows]
        return image[:, :, 0] if (palette == palette[:, :1]).all() else image
    return rows.reshape(abs(height), width, bits // 8)[:, :, 2::-1]


def read_image(data: bytes) -> np.ndarray:
    return read_bmp(data) if data[:2] == b"BM" else read_netpbm(data)


def grey(image: np.ndarray) -> np.ndarray:
    return image.astype(np.float64) if image.ndim == 2 else image.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell, parts of pixels weighted by area, from the integral image."""
    whole = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    np.cumsum(np.cumsum(image, axis=0, dtype=np.float64), axis=1, out=whole[1:, 1:])

    def edges(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.arange(m + 1) * n / m
        low = np.minimum(at.astype(int), n - 1)
        return at, low, at - low

    y, y0, fy = edges(image.shape[0], height)
    x, x0, fx = edges(image.shape[1], width)
    rows = whole[y0] * (1 - fy)[:, None] + whole[y0 + 1] * fy[:, None]
    cells = rows[:, x0] * (1 - fx) + rows[:, x0 + 1] * fx
    sums = cells[1:, 1:] - cells[:-1, 1:] - cells[1:, :-1] + cells[:-1, :-1]
    return sums / (np.diff(y)[:, None] * np.diff(x))


def difference_hash(image: np.ndarray) -> str:
    """64 bits, row by row: whether each cell of an 8 by 9 reduction is darker than the next."""
    small = np.round(area_resize(grey(image), 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_tile(image: np.ndarray, shape: tuple[int, int] = TILE) -> bytes:
    out = io.BytesIO()
    np.save(out, np.clip(np.round(area_resize(grey(image), *shape)), 0, 255).astype(np.uint8))
    return out.getvalue()


def decode_media(files: DataFrame, column: str = "content", shape: tuple[int, int] = TILE) -> DataFrame:
    """files and height, width, tile (NPY bytes), dhash, media_error; null data or unreadable files have nulls and an error."""

    @F.pandas_udf("height int, width int, tile binary, dhash string, media_error string")
    def of(data: pd.Series) -> pd.DataFrame:
        out = []
        for x in data:
            try:
                image = read_image(bytes(x))
                out.append((*image.shape[:2], npy_tile(image, shape), difference_hash(image), None))
            except (TypeError, ValueError, struct.error) as e:
                out.append((None, None, None, None, str(e) or "unreadable"))
        return pd.DataFrame(out, columns=["height", "width", "tile", "dhash", "media_error"])

    return files.withColumn("_media", of(F.col(column))).select(*files.columns, "_media.*")


def store(text: str) -> tuple[int, bytes]:
    """Bytes of a text, and its PGM image."""
    data = text.encode()
    rows = max(1, -(-len(data) // ROW))
    samples = np.full(rows * ROW, 255, np.uint8)
    samples[: len(data)] = np.frombuffer(data, np.uint8)
    return len(data), write_netpbm(samples.reshape(rows, ROW))


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature (difference hash,
    a colon, and the CRC-32 of the NPY tile)."""
    d = texts(docs)

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in frames:
            out = []
            for text in b["text"]:
                n, media = store(text)
                image = read_image(media)
                payload = image.tobytes()
                feature = f"{difference_hash(image)}:{zlib.crc32(npy_tile(image)):08x}"
                out.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            columns = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pd.concat([b[["doc_id"]].reset_index(drop=True), pd.DataFrame(out, columns=columns)], axis=1)

    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInPandas(of, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
