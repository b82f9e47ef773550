"""Media columns: Netpbm and BMP to numpy arrays, area-resized, written as NPY tiles with difference hashes.

Decoders take P1 to P6 (plain and raw, comments, maxval up to 65535) and
uncompressed BMP of 8, 24 and 32 bits, bottom-up or top-down. Resizing averages
exact areas, partial pixels included, from an integral image. A difference hash
compares neighbours in a 9 x 8 thumbnail. A text payload is stored as a raw
greyscale image 64 samples wide, so that any byte string has a lossless image.

Defined results: null text counts as empty and has one row of 64 zero bytes;
a null or malformed image decodes to None (the query's own images never are), as does
one with a sample above its maxval; equal texts, repeated rows among them, give equal
values; a text of any length is one image; further columns are ignored.
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

from .common import scratch, texts

WIDTH, TILE = 64, 32


def _header(data: bytes, count: int) -> tuple[list[int], int]:
    """The numbers of a Netpbm header after its magic, and where samples begin (one white space after the last)."""
    out, i = [], 2
    while len(out) < count:
        while data[i : i + 1].isspace():
            i += 1
        if data[i : i + 1] == b"#":
            while data[i : i + 1] not in (b"\n", b"\r", b""):
                i += 1
            continue
        j = i
        while data[j : j + 1].isdigit():
            j += 1
        if j == i:
            raise ValueError("bad Netpbm header")
        out.append(int(data[i:j]))
        i = j
    return out, i + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 to an array (height, width) or (height, width, 3); bitmaps become 0 (black) and 255."""
    kind = data[1] - 48
    if data[:1] != b"P" or not 1 <= kind <= 6:
        raise ValueError("not Netpbm")
    bitmap, channels = kind in (1, 4), 3 if kind in (3, 6) else 1
    head, at = _header(data, 2 if bitmap else 3)
    w, h, top = head[0], head[1], 1 if bitmap else head[2]
    if not 0 < top < 65536 or w < 1 or h < 1:
        raise ValueError("bad Netpbm header")
    n = w * h * channels
    if kind == 4:
        row = (w + 7) // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, row * h, at).reshape(h, row), axis=1)[:, :w]
        return np.where(bits == 1, 0, 255).astype(np.uint8)
    if kind in (5, 6):
        flat = np.frombuffer(data, np.uint8 if top < 256 else ">u2", n, at)
        if top not in (255, 65535) and flat.max() > top:
            raise ValueError("a sample above maxval")
    else:
        body = b"\n".join(line.split(b"#")[0] for line in data[at - 1 :].splitlines())
        digits = [b - 48 for b in body if b in b"01"] if kind == 1 else [int(x) for x in body.split()]
        if len(digits) < n or not all(0 <= x <= top for x in digits[:n]):
            raise ValueError("too few samples, or one above maxval")
        flat = np.array(digits[:n], np.uint8 if top < 256 else np.uint16)
        if kind == 1:
            flat = np.where(flat == 1, 0, 255).astype(np.uint8)
    return flat.reshape((h, w, 3) if channels == 3 else (h, w))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits to (height, width, 3) in red, green, blue."""
    if data[:2] != b"BM":
        raise ValueError("not BMP")
    at, _, w, h, _, depth, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if packing not in (0, 3) or depth not in (8, 24, 32) or w < 1 or h == 0:
        raise ValueError("unsupported BMP")
    step, rows = (w * depth // 8 + 3) // 4 * 4, abs(h)
    raw = np.frombuffer(data, np.uint8, step * rows, at).reshape(rows, step)[:, : w * depth // 8]
    raw = raw[::-1] if h > 0 else raw
    if depth == 8:
        size = struct.unpack_from("<I", data, 14)[0]
        colours = np.frombuffer(data, np.uint8, (at - 14 - size) // 4 * 4, 14 + size).reshape(-1, 4)
        return colours[raw][:, :, 2::-1]
    return raw.reshape(rows, w, depth // 8)[:, :, 2::-1]


def decode_image(data: bytes | None) -> np.ndarray | None:
    """Any image that the two decoders read; None for null or malformed bytes."""
    try:
        return None if data is None else decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)
    except (ValueError, IndexError, OverflowError, struct.error):
        return None


def encode_pgm(payload: bytes, width: int = WIDTH) -> bytes:
    """A raw greyscale image of 8-bit samples; the payload's length is a multiple of width."""
    return b"P5\n%d %d\n255\n" % (width, len(payload) // width) + payload


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over exact areas, in float64: the integral image is read at fractional corners by linear interpolation."""
    grey = image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])
    h, w = grey.shape
    s = np.zeros((h + 1, w + 1))
    s[1:, 1:] = grey
    s = s.cumsum(0).cumsum(1)

    def at(a: np.ndarray, n: int, m: int) -> np.ndarray:
        x = np.arange(m + 1) * (n / m)
        i = np.minimum(x.astype(np.int64), n - 1)
        f = (x - i)[:, None]
        return a[i] * (1 - f) + a[i + 1] * f

    corners = at(at(s, h, height).T, w, width).T
    return np.diff(np.diff(corners, axis=0), axis=1) * (height * width / (h * w))


def difference_hash(image: np.ndarray) -> str:
    """64 bits, as 16 hex digits: is a cell of the 8 x 9 thumbnail brighter than the one to its left?"""
    t = np.round(area_resize(image, 8, 9), 6)
    return np.packbits(t[:, 1:] > t[:, :-1]).tobytes().hex()


def tile(image: np.ndarray, size: int = TILE) -> bytes:
    """An NPY file of the resized 8-bit tile."""
    to = io.BytesIO()
    np.save(to, np.clip(np.rint(area_resize(image, size, size)), 0, 255).astype(np.uint8))
    return to.getvalue()


def image_tiles(media: DataFrame, column: str = "media", size: int = TILE) -> DataFrame:
    """For rows (id, media binary): id, height, width, tile (NPY bytes), feature (difference hash); nulls where undecodable."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [decode_image(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([None if x is None else x.shape[0] for x in found], pa.int64()), pa.array([None if x is None else x.shape[1] for x in found], pa.int64()),
                pa.array([None if x is None else tile(x, size) for x in found], pa.binary()), pa.array([None if x is None else difference_hash(x) for x in found], pa.string()),
            ], ["id", "height", "width", "tile", "feature"])

    return media.selectExpr("cast(id as long) id", f"`{column}` media").mapInArrow(run, "id long, height long, width long, tile binary, feature string")


def text_media(docs: DataFrame, digest: bool = True) -> DataFrame:
    """Each text as a stored image: sizes, checks and features of what is read back from it; digest=False returns the image and its tile too."""
    extra = "" if digest else ", media binary, tile binary"
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string"

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 512):
                b = big.slice(at, 512)
                bodies = b.column(1).cast(pa.binary()).to_pylist()
                media = [encode_pgm(x + bytes(-len(x) % WIDTH or WIDTH * (not x))) for x in bodies]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in bodies], pa.int64()), pa.array(media, pa.binary()), pa.array([tile(decode_netpbm(x)) for x in media], pa.binary())], ["doc_id", "n_bytes", "media", "tile"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 512):
                b = big.slice(at, 512)
                rows = []
                for n, media, npy in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                    image = decode_netpbm(media)
                    back = image.tobytes()
                    row = (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(image), hashlib.sha256(npy).hexdigest())
                    rows.append(row if digest else (*row, media, npy))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.binary()]
                names = [x.split()[0] for x in (schema + extra).split(", ")]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False))], names)

    path = scratch(docs.sparkSession, "media")
    texts(docs).mapInArrow(store, "doc_id long, n_bytes long, media binary, tile binary").write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path).select("doc_id", "n_bytes", "media", "tile").mapInArrow(run, schema + extra)
