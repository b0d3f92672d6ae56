"""Media columns: Netpbm and BMP decoded to numpy arrays, resized by area over integral images, written as NPY tiles with
difference hashes."""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolwright.llm.common import text_slices, utf8

WIDTH, TILE, THUMB = 64, 256, 32


class MediaError(ValueError):
    """Bytes that are no whole Netpbm or BMP image."""


def _header(data: bytes, n: int) -> tuple[list[int], int]:
    """n whole numbers after the magic, comments skipped, and where the samples begin."""
    at, out = 2, []
    while len(out) < n:
        while at < len(data) and (data[at : at + 1].isspace() or data[at] == 35):
            at = data.find(b"\n", at) + 1 or len(data) if data[at] == 35 else at + 1
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise MediaError("header")
        out.append(int(data[at:end]))
        at = end
    return out, at + 1


def _netpbm(data: bytes) -> np.ndarray:
    kind = data[1] - 48
    bits, channels = kind in (1, 4), 3 if kind in (3, 6) else 1
    (width, height, *rest), at = _header(data, 2 if bits else 3)
    top = rest[0] if rest else 1
    if not width or not height or not 0 < top < 65536:
        raise MediaError("size")
    n = width * height * channels
    if kind == 1:
        values = np.frombuffer(bytes(c - 48 for c in data[at - 1 :] if c in b"01"), np.uint8)[:n]
    elif kind < 4:
        values = np.array(data[at - 1 :].split()[:n], np.int64)
    elif kind == 4:
        row = (width + 7) // 8
        packed = np.frombuffer(data, np.uint8, offset=at)[: row * height]
        values = np.unpackbits(packed.reshape(-1, row), axis=1)[:, :width].ravel() if len(packed) == row * height else packed
    else:
        size = 1 + (top > 255)
        values = np.frombuffer(data[at : at + n * size], ">u2" if size == 2 else np.uint8)
    if len(values) != n:
        raise MediaError("samples are missing")
    if bits:
        values = (1 - values) * 255
    out = values.astype(np.uint16 if top > 255 else np.uint8)
    return out.reshape((height, width, 3) if channels == 3 else (height, width))


def _masked(values: np.ndarray, mask: int) -> np.ndarray:
    """The bits of a mask, widened to 0 to 255."""
    if not mask:
        return np.zeros(values.shape, np.uint8)
    low = (mask & -mask).bit_length() - 1
    return ((values.astype(np.int64) & mask) >> low) * 255 // (mask >> low)


def _bmp(data: bytes) -> np.ndarray:
    if len(data) < 54:
        raise MediaError("header")
    start, size, width, height, _, depth, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed not in (0, 3) or depth not in (1, 4, 8, 16, 24, 32) or packed == 3 and depth not in (16, 32) or width <= 0 or not height:
        raise MediaError("kind")
    row = (width * depth + 31) // 32 * 4
    body = np.frombuffer(data[start : start + row * abs(height)], np.uint8)
    if len(body) != row * abs(height):
        raise MediaError("samples are missing")
    rows = body.reshape(abs(height), row)
    rows = rows[::-1] if height > 0 else rows
    if depth in (24, 32) and packed == 0:
        return np.ascontiguousarray(rows[:, : width * depth // 8].reshape(abs(height), width, depth // 8)[:, :, 2::-1])
    if depth > 8:
        masks = struct.unpack_from("<III", data, 54) if packed == 3 else (0x7C00, 0x3E0, 0x1F)
        values = np.ascontiguousarray(rows[:, : width * depth // 8]).view("<u2" if depth == 16 else "<u4")
        return np.stack([_masked(values, m) for m in masks], axis=-1).astype(np.uint8)
    bits = np.unpackbits(rows, axis=1).reshape(abs(height), -1, depth)[:, :width]
    index = bits @ (1 << np.arange(depth)[::-1])
    colours = (struct.unpack_from("<I", data, 46)[0] or 1 << depth) * 4
    table = np.frombuffer(data[14 + size : 14 + size + colours], np.uint8)
    if len(table) % 4 or index.max() >= len(table) // 4:
        raise MediaError("palette")
    table = table.reshape(-1, 4)[:, 2::-1]
    out = table[index]
    return np.ascontiguousarray(out[..., 0] if (table[:, :1] == table).all() else out)


def _pam(data: bytes) -> np.ndarray:
    head, mark, body = data.partition(b"\nENDHDR\n")
    fields = dict(x.split(None, 1) for x in head.splitlines()[1:] if x.strip() and not x.startswith(b"#") and len(x.split()) > 1)
    width, height, channels, top = (int(fields.get(k, b"0")) for k in (b"WIDTH", b"HEIGHT", b"DEPTH", b"MAXVAL"))
    if not mark or min(width, height) < 1 or channels not in (1, 2, 3, 4) or not 0 < top < 65536:
        raise MediaError("header")
    n, size = width * height * channels, 1 + (top > 255)
    values = np.frombuffer(body[: n * size], ">u2" if size == 2 else np.uint8)
    if len(values) != n:
        raise MediaError("samples are missing")
    out = values.astype(np.uint16 if size == 2 else np.uint8).reshape(height, width, channels)
    return np.ascontiguousarray(out[..., :3] if channels > 2 else out[..., 0])  # alpha goes


def decode(data: bytes) -> np.ndarray:
    """The samples of a Netpbm (P1 to P7) or BMP (1 to 32 bits, no run lengths) image: rows x columns, or x 3 for colour.
    Samples keep the values of the file, so a file whose largest value is 15 gives 0 to 15. Alpha is left out. Bytes that
    are no whole image raise MediaError, whatever is wrong with them."""
    try:
        if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
            return _netpbm(data)
        if data[:2] == b"P7":
            return _pam(data)
        if data[:2] == b"BM":
            return _bmp(data)
    except MediaError:
        raise
    except (ValueError, TypeError, IndexError, OverflowError, struct.error) as e:
        raise MediaError(str(e)) from e
    raise MediaError("neither Netpbm nor BMP")


def encode_pgm(samples: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % samples.shape[::-1] + samples.tobytes()


def grey(samples: np.ndarray) -> np.ndarray:
    return samples if samples.ndim == 2 else samples @ np.array([0.299, 0.587, 0.114])


def area_resize(samples: np.ndarray, height: int, width: int) -> np.ndarray:
    """Each target pixel is the mean over its share of the source, parts of pixels included, read off the integral image."""
    h, w = samples.shape
    integral = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(samples, axis=0, dtype=np.float64), axis=1, out=integral[1:, 1:])

    def cut(table: np.ndarray, n: int, m: int) -> np.ndarray:  # the integral at m + 1 even cuts, linear in between
        at = np.arange(m + 1) * (n / m)
        low = np.minimum(at.astype(np.int64), n - 1)
        part = (at - low)[:, None]
        return table[low] * (1 - part) + table[low + 1] * part

    grid = cut(cut(integral, h, height).T, w, width).T
    sums = grid[1:, 1:] - grid[:-1, 1:] - grid[1:, :-1] + grid[:-1, :-1]
    return sums / (h / height * (w / width))


def difference_hash(samples: np.ndarray) -> str:
    """64 bits: is each of 8 x 9 area means greater than its left neighbour."""
    small = np.round(area_resize(grey(samples), 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy(samples: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, samples, allow_pickle=False)
    return out.getvalue()


def tiles(samples: np.ndarray, side: int = TILE) -> list[bytes]:
    """The image as NPY tiles of at most side x side, by rows."""
    return [npy(samples[y : y + side, x : x + side]) for y in range(0, samples.shape[0], side) for x in range(0, samples.shape[1], side)]


def join_tiles(parts: list[bytes], columns: int) -> np.ndarray:
    read = [np.load(io.BytesIO(p)) for p in parts]
    return np.concatenate([np.concatenate(read[i : i + columns], axis=1) for i in range(0, len(read), columns)])


MEDIA_SCHEMA = "height int, width int, dhash string, thumbnail binary, tiles array<binary>, error string"


def features(media: DataFrame, column: str = "media", side: int = TILE, thumb: int = THUMB) -> DataFrame:
    """`media` with the struct column `image`: size, difference hash, a thumb x thumb area thumbnail and the tiles as NPY.

    Bytes that are no image, null or empty ones give nulls and `error`. Other columns are carried; one named `image` is
    replaced. Rows are independent, so repeated rows and empty tables need no rule.
    """
    @F.pandas_udf(MEDIA_SCHEMA)
    def of(values: pd.Series) -> pd.DataFrame:
        rows = []
        for data in values:
            try:
                s = decode(bytes(data or b""))
                rows.append((*s.shape[:2], difference_hash(s), npy(np.round(area_resize(grey(s), thumb, thumb)).astype(np.uint8)), tiles(s, side), None))
            except MediaError as e:
                rows.append((None, None, None, None, None, str(e)))
        return pd.DataFrame(rows, columns=["height", "width", "dhash", "thumbnail", "tiles", "error"])

    return media.withColumn("image", of(column))


_IMAGES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("tiles", pa.list_(pa.binary())), ("feature", pa.string())])
_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_tiles", pa.int64())])


def store_text(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, tiles, feature): every text as a greyscale image 64 samples wide, stored as NPY tiles.

    The payload is the UTF-8 text (null: empty) and bytes 0 up to a positive multiple of 64. It passes through a PGM file and
    its decoder; tiles hold at most 256 rows each; feature is difference hash and mean. n_bytes has no padding. A null
    doc_id is carried, repeated rows give repeated rows, no rows give none, other columns are not read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_slices(batch):
                rows = []
                for doc, text in zip(batch.column("doc_id")[a:b].to_pylist(), utf8(batch.column("text")[a:b]), strict=True):
                    payload = text + bytes(-len(text) % WIDTH or (0 if text else WIDTH))
                    samples = decode(encode_pgm(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)))
                    rows.append((doc, len(text), tiles(samples), f"{difference_hash(samples)}:{float(samples.mean()):.4f}"))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _IMAGES, strict=True)], schema=_IMAGES)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, tiles array<binary>, feature string")


def read_back(images: DataFrame) -> DataFrame:
    """What store_text() stored, read from its tiles: size, SHA-256 and the CRC-32 of the last 64 bytes of the payload, and
    size and SHA-256 of the stored form (the tiles end to end)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, n, parts, feature in zip(*(batch.column(c) for c in ("doc_id", "n_bytes", "tiles", "feature")), strict=True):
                parts = parts.as_py()
                back, media = join_tiles(parts, 1).tobytes(), b"".join(parts)
                rows.append((doc.as_py(), n.as_py(), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature.as_py(), len(parts)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _DIGESTS, strict=True)], schema=_DIGESTS)

    return images.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_tiles long")
