"""Media columns: Netpbm and BMP images decoded to numpy arrays, area-resized, written as NPY tiles.

* `decode_image` reads Netpbm (P1 to P6, 8 or 16 bits, comments) and BMP (1, 4, 8, 16, 24 and 32 bits,
  uncompressed, with bit fields or without, bottom-up or top-down) into an array of height x width
  (grey) or x 3 (colour).
* `area_resize` averages over areas with an integral image, in any ratio; the image of running sums is
  made band by band of rows, and only what the areas' edges need of it is kept.
* `write_tiles` cuts an array into bands of rows, each an NPY file; tiles follow one another.
* `difference_hash` compares neighbours of a 9 x 8 area-resized grey image: 64 bits, 16 hex digits.

A payload of bytes can be stored losslessly as a grey image 64 samples wide: as PGM, decoded, written
as NPY tiles, and read back from the tiles.

Defined cases: a null or empty text is a payload of 64 zero bytes; repeated and equal rows give equal
values; bytes that are no image of these formats, or are cut short, give nulls in `media_columns`
with the reason in `error`; an empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

WIDTH = 64
TILE_ROWS = 4096


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, nums = data[:2], 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        while True:
            while data[at : at + 1].isspace():
                at += 1
            if data[at : at + 1] != b"#":
                break
            at = data.index(b"\n", at)
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        nums.append(int(data[at:end]))
        at = end
    w, h, most = (*nums, 1)[:3]
    bands = 3 if kind in (b"P3", b"P6") else 1
    # a sample takes a bit, a digit, a byte or two: no header can ask for more than the data have
    if not (w > 0 and h > 0 and 0 < most < 65536) or w * h * bands > len(data) * (8 if kind == b"P4" else 1):
        raise ValueError("bad Netpbm header, or data cut short")
    kind_of = np.dtype(">u2" if most > 255 else "u1")
    if kind == b"P4":
        row = (w + 7) // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, row * h, at + 1).reshape(h, row), axis=1)[:, :w]
        return 1 - bits
    if kind in (b"P5", b"P6"):
        a = np.frombuffer(data, kind_of, w * h * bands, at + 1)
    elif kind == b"P1":
        a = 1 - np.array([c - 48 for c in b"".join(x.split(b"#")[0] for x in data[at:].split(b"\n")) if c in b"01"][: w * h], np.uint8)
    else:
        a = np.array(b" ".join(x.split(b"#")[0] for x in data[at:].split(b"\n")).split()[: w * h * bands], np.int64)
        if a.size and not 0 <= a.min() <= a.max() <= most:
            raise ValueError("a Netpbm sample is out of range")
    if a.size != w * h * bands:
        raise ValueError("Netpbm data cut short")
    a = a.astype(np.uint16 if most > 255 else np.uint8)
    return a.reshape((h, w, 3) if bands == 3 else (h, w))


def _bmp(data: bytes) -> np.ndarray:
    offset, size, w, h, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    rows, row = abs(h), (w * bits + 31) // 32 * 4
    if packed not in (0, 3) or w <= 0 or h == 0 or bits not in (1, 4, 8, 16, 24, 32) or (packed == 3 and bits not in (16, 32)):
        raise ValueError("this kind of BMP is not supported")
    if rows * row > len(data):
        raise ValueError("BMP data cut short")
    a = np.frombuffer(data, np.uint8, row * rows, offset).reshape(rows, row)
    if bits <= 8:
        used = struct.unpack_from("<I", data, 46)[0] if size >= 40 else 0
        colours = np.frombuffer(data, np.uint8, 4 * (used or 1 << bits), 14 + size).reshape(-1, 4)[:, 2::-1]
        index = a[:, :w] if bits == 8 else (np.unpackbits(a, axis=1)[:, :w] if bits == 1 else np.stack((a >> 4, a & 15), 2).reshape(rows, -1)[:, :w])
        a = colours[index]
        a = a[:, :, 0] if (colours[:, 0] == colours[:, 1]).all() and (colours[:, 1] == colours[:, 2]).all() else a
    elif bits == 16 or packed == 3:
        masks = struct.unpack_from("<III", data, 54) if packed == 3 else (0x7C00, 0x3E0, 0x1F)
        a = np.stack([_field(a.view("<u2" if bits == 16 else "<u4")[:, :w], m, bits) for m in masks], 2)
    else:
        a = a[:, : w * bits // 8].reshape(rows, w, bits // 8)[:, :, 2::-1]
    return np.ascontiguousarray(a[::-1] if h > 0 else a)


def _field(samples: np.ndarray, mask: int, bits: int) -> np.ndarray:
    """The masked bits of the samples, as 0 to 255."""
    low = mask & -mask
    if not mask or mask >> bits or (mask // low) & (mask // low + 1):
        raise ValueError("a BMP colour mask is not one run of bits")
    most = mask // low
    return ((samples.astype(np.uint64) & np.uint64(mask)) // np.uint64(low) * np.uint64(255) // np.uint64(most)).astype(np.uint8)


def decode_image(data: bytes) -> np.ndarray:
    if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
        return _netpbm(data)
    if data[:2] == b"BM":
        return _bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def encode_pgm(a: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (a.shape[1], a.shape[0]) + a.astype(np.uint8).tobytes()


def area_resize(a: np.ndarray, height: int, width: int, band: int = 65536) -> np.ndarray:
    """Means over equal areas, from an integral image interpolated at fractional edges."""

    def along(x: np.ndarray, n: int) -> np.ndarray:
        edge = np.arange(n + 1) * (x.shape[0] / n)
        low = np.minimum(edge.astype(np.int64), x.shape[0] - 1)
        at, held = np.zeros((n + 1, *x.shape[1:])), np.zeros(x.shape[1:])
        for i in range(0, x.shape[0], band):
            total = np.cumsum(x[i : i + band], axis=0, dtype=np.float64) + held
            here = np.flatnonzero((low > i) & (low <= i + len(total)))  # sums of the rows before row `low`
            at[here] = total[low[here] - 1 - i]
            held = total[-1]
        part = (edge - low).reshape(-1, *[1] * (x.ndim - 1))
        return np.diff(at + part * x[low], axis=0) * (n / x.shape[0])

    return np.swapaxes(along(np.swapaxes(along(a, height), 0, 1), width), 0, 1)


def difference_hash(a: np.ndarray) -> str:
    small = area_resize(a, 8, 9)
    small = small if a.ndim == 2 else small @ np.array([0.299, 0.587, 0.114])
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def write_tiles(a: np.ndarray, rows: int = TILE_ROWS) -> bytes:
    out = io.BytesIO()
    for i in range(0, a.shape[0], rows):
        np.save(out, np.ascontiguousarray(a[i : i + rows]), allow_pickle=False)
    return out.getvalue()


def read_tiles(data: bytes) -> np.ndarray:
    file, tiles = io.BytesIO(data), []
    while file.tell() < len(data):
        tiles.append(np.load(file, allow_pickle=False))
    return np.concatenate(tiles)


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH), b"\0")


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, media = [], []
        for t in batch.column(1).to_pylist():
            n, payload = payload_of(t)
            picture = decode_image(encode_pgm(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)))
            sizes.append(n)
            media.append(write_tiles(picture))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text's padded bytes as NPY tiles of 8-bit samples."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(tidy(_store), f"doc_id {dict(d.dtypes)['doc_id']}, n_bytes long, media binary")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for m in batch.column(2).to_pylist():
            a = read_tiles(m)
            payload = a.tobytes()
            rows.append((len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), sha256(m).hexdigest(), difference_hash(a)))
        cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def features(stored: DataFrame) -> DataFrame:
    """What store_texts stored, read back: digests and the difference hash."""
    kind = dict(stored.dtypes)["doc_id"]
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(tidy(_read_back), f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def _columns(height: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(1).to_pylist():
                try:
                    a = decode_image(data or b"")
                    small = np.rint(area_resize(a, height, width)).astype(a.dtype)
                    rows.append((a.shape[0], a.shape[1], write_tiles(small), difference_hash(a), None))
                except (ValueError, IndexError, OverflowError, MemoryError, struct.error) as e:
                    rows.append((None, None, None, None, str(e)))
            cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["id", "height", "width", "tile", "dhash", "error"])

    return run


def media_columns(images: DataFrame, id_col: str = "id", data_col: str = "data", height: int = 32, width: int = 32) -> DataFrame:
    """id, height, width, tile (the image area-resized, as NPY), dhash, error of each image."""
    d = images.select(F.col(id_col).alias("id"), F.col(data_col).alias("data"))
    return d.mapInArrow(tidy(_columns(height, width)), f"id {dict(d.dtypes)['id']}, height int, width int, tile binary, dhash string, error string")
