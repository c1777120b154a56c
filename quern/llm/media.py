"""Media columns: Netpbm and BMP bytes decoded to arrays, resized, tiled and hashed.

Images are decoded to numpy arrays of 8-bit samples, resized to any size by
area averages from integral images, and written as NPY tiles with difference
hashes. All of it is one map over the rows; no image leaves its task. Bytes
that are no whole image of these formats raise ValueError with the reason.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

WIDTH, SMALL, SIDE = 64, 32, 16
_NPY = re.compile(rb"'descr': '\|u1', 'fortran_order': False, 'shape': \(([\d, ]+)\)")
_TOKEN = re.compile(rb"(?:\s|#[^\n\r]*+[\n\r])*+(\d{1,9})(?![^\s#])")


def encode_pnm(samples: np.ndarray) -> bytes:
    """A grey (h x w) or RGB (h x w x 3) array of 8-bit samples as binary PGM or PPM."""
    kind = b"P5" if samples.ndim == 2 else b"P6"
    return kind + b"\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + np.ascontiguousarray(samples, np.uint8).tobytes()


def decode_pnm(data: bytes) -> np.ndarray:
    """PBM, PGM or PPM, plain or binary, as an array of 8-bit samples (16-bit ones keep their high byte)."""
    if not re.match(rb"P[1-6]\s", data):
        raise ValueError("not a Netpbm image")
    kind, at, header = data[1] - 48, 2, []
    while len(header) < (2 if kind in (1, 4) else 3):
        if not (found := _TOKEN.match(data, at)):
            raise ValueError("a Netpbm header that is cut off or no number")
        header.append(int(found[1]))
        at = found.end()
    w, h = header[:2]
    top = header[2] if len(header) > 2 else 1
    if w < 1 or h < 1 or not 1 <= top <= 65535:
        raise ValueError("a Netpbm image needs positive width, height and maximum")
    bands = 3 if kind in (3, 6) else 1
    n = w * h * bands
    least = {1: n, 4: -(-w // 8) * h, 5: n, 6: n}.get(kind, 2 * n - 1) * (2 if kind > 4 and top > 255 else 1)
    if len(data) - at < least:
        raise ValueError("fewer Netpbm samples than width and height ask for")
    if kind == 4:
        row = -(-w // 8)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, row * h, at + 1).reshape(h, row), axis=1)[:, :w]
        values = 1 - bits.astype(np.uint8)
    elif kind == 1:
        digits = re.sub(rb"#[^\n\r]*+|[^01]", b"", data[at:])[:n]
        if len(digits) < n:
            raise ValueError("fewer Netpbm samples than width and height ask for")
        values = 49 - np.frombuffer(digits, np.uint8)
    elif kind in (2, 3):
        plain = re.sub(rb"#[^\n\r]*+", b"", data[at:]).split()[:n]
        if len(plain) < n or not all(map(bytes.isdigit, plain)):
            raise ValueError("fewer Netpbm samples than width and height ask for, or such that are no numbers")
        values = np.array(plain, np.int64)
    else:
        values = np.frombuffer(data, np.uint8 if top < 256 else ">u2", n, at + 1)
    if values.size and values.max() > top:
        raise ValueError("a Netpbm sample above the maximum")
    if top != 255:
        values = (values.astype(np.int64) * 255 + top // 2) // top
    return values.astype(np.uint8).reshape((h, w, 3) if bands == 3 else (h, w))


_GREYS = b"".join(bytes((i, i, i, 0)) for i in range(256))


def encode_bmp(samples: np.ndarray) -> bytes:
    """Grey as an 8-bit palette BMP, RGB as 24 bits; rows bottom up, padded to four bytes."""
    h, w = samples.shape[:2]
    bits = 8 if samples.ndim == 2 else 24
    rows = samples if bits == 8 else samples[:, :, ::-1].reshape(h, w * 3)
    body = np.zeros((h, rows.shape[1] + -rows.shape[1] % 4), np.uint8)
    body[:, : rows.shape[1]] = rows[::-1]
    body = body.tobytes()
    palette = _GREYS if bits == 8 else b""
    begin = 54 + len(palette)
    head = b"BM" + struct.pack("<IHHI", begin + len(body), 0, 0, begin)
    return head + struct.pack("<IiiHHIIiiII", 40, w, h, 1, bits, 0, len(body), 2835, 2835, len(palette) // 4, 0) + palette + body


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits; grey palettes give a grey array."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP image, or one whose header is cut off")
    (begin,) = struct.unpack_from("<I", data, 10)
    size, w, h, _, bits, packed = struct.unpack_from("<IiiHHI", data, 14)
    if packed or bits not in (8, 24, 32) or w < 1 or not h:
        raise ValueError("only uncompressed BMP of 8, 24 or 32 bits")
    row = -(-w * bits // 32) * 4
    if begin < 14 + size or len(data) < begin + row * abs(h):
        raise ValueError("fewer BMP rows than the height asks for")
    rows = np.frombuffer(data, np.uint8, row * abs(h), begin).reshape(abs(h), row)[:, : w * bits // 8]
    rows = rows[::-1] if h > 0 else rows
    if bits > 8:
        return rows.reshape(abs(h), w, bits // 8)[:, :, 2::-1].copy()
    (colours,) = struct.unpack_from("<I", data, 46)
    n = colours or 256
    if n > 256 or len(data) < 14 + size + 4 * n:
        raise ValueError("a BMP palette that is cut off or too large")
    if n == 256 and data.startswith(_GREYS, 14 + size):
        return rows.copy()
    palette = np.zeros((256, 3), np.uint8)
    palette[:n] = np.frombuffer(data, np.uint8, n * 4, 14 + size).reshape(-1, 4)[:, 2::-1]
    grey = (palette[:, :1] == palette).all()
    return palette[:, 0][rows] if grey else palette[rows]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_pnm(data)


def encode(samples: np.ndarray, form: str = "pgm") -> bytes:
    return encode_bmp(samples) if form == "bmp" else encode_pnm(samples)


def area_resize(samples: np.ndarray, height: int, width: int, block: int = 4096) -> np.ndarray:
    """Exact area averages in a height x width grid, from integral images (float64).

    Each cell is a difference of the integral at its corners, which lie between
    samples where sizes don't divide. The integral is formed `block` rows at a
    time and kept only at the rows asked for, so that tall images need no more memory.
    """
    h, w = samples.shape[:2]
    image = samples.reshape(h, w, -1)
    ys, xs = np.arange(height + 1) * (h / height), np.arange(width + 1) * (w / width)
    at, part = np.minimum(xs.astype(int), w), xs - np.floor(xs)
    lines = np.zeros((height + 1, width + 1, image.shape[2]))
    above = np.zeros((w + 1, image.shape[2]))
    for begin in range(0, h, block):
        rows = image[begin : begin + block].astype(np.float64)
        integral = np.zeros((len(rows) + 1, w + 1, image.shape[2]))
        integral[1:, 1:] = rows.cumsum(0).cumsum(1)
        integral += above
        last = begin + block >= h
        k = np.flatnonzero((ys >= begin) & ((ys < begin + len(rows)) | last))
        y = np.minimum(ys[k] - begin, len(rows))
        low = np.minimum(y.astype(int), len(rows) - 1)
        line = integral[low] + (y - low)[:, None, None] * (integral[low + 1] - integral[low])
        left = line[:, at]
        lines[k] = left + part[:, None] * (line[:, np.minimum(at + 1, w)] - left)
        above = integral[-1]
    cells = lines[1:, 1:] - lines[:-1, 1:] - lines[1:, :-1] + lines[:-1, :-1]
    cells *= height * width / (h * w)
    return cells if samples.ndim == 3 else cells[:, :, 0]


def shrunk(samples: np.ndarray, size: int) -> np.ndarray:
    """The image in 8-bit samples with at most `size` of them a side, in its proportions; small ones as they are."""
    h, w = samples.shape[:2]
    scale = max(h, w) / size
    if scale <= 1:
        return samples
    small = area_resize(samples, max(1, round(h / scale)), max(1, round(w / scale)))
    return np.clip(np.rint(small), 0, 255).astype(np.uint8)


def grey(samples: np.ndarray) -> np.ndarray:
    return samples if samples.ndim == 2 else samples.astype(float) @ np.array([0.299, 0.587, 0.114])


def difference_hash(samples: np.ndarray) -> str:
    """64 bits as hex: whether each cell of a 9 x 8 grid of area averages is brighter than its left neighbour."""
    cells = np.round(area_resize(grey(samples), 8, 9), 9)
    return np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()


@lru_cache(maxsize=64)
def _npy_header(shape: tuple[int, ...]) -> bytes:
    out = io.BytesIO()
    np.save(out, np.empty(shape, np.uint8), allow_pickle=False)
    return out.getvalue()[: -max(1, int(np.prod(shape)))]


def tiles(samples: np.ndarray, side: int) -> Iterator[tuple[int, int, bytes]]:
    """Row, column and NPY bytes of each `side` x `side` tile; those at the border are smaller."""
    for r in range(0, samples.shape[0], side):
        for c in range(0, samples.shape[1], side):
            tile = np.ascontiguousarray(samples[r : r + side, c : c + side], np.uint8)
            yield r // side, c // side, _npy_header(tile.shape) + tile.tobytes()


def media_tiles(images: DataFrame, key: str, data: str, size: int = 256, side: int = 64) -> DataFrame:
    """The images of a binary column as tiles: key, tile_row, tile_column, npy, tile_hash, image_hash, error.

    Each image is resized to at most `size` samples a side first. A null or
    broken image gives one row with the reason in `error` and null elsewhere.
    Repeated rows repeat their tiles; an empty table gives an empty one.
    """
    names = ["tile_row", "tile_column", "npy", "tile_hash", "image_hash", "error"]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string(), pa.string()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = []
                try:
                    image = shrunk(decode(batch.column(1)[i].as_py() or b""), size)
                    whole = difference_hash(image)
                    for r, c, npy in tiles(image, side):
                        found.append((r, c, npy, difference_hash(image[r * side :, c * side :][:side, :side]), whole, None))
                except ValueError as why:
                    found = [(None, None, None, None, None, str(why)[:200])]
                keys = batch.column(0).take(pa.array([i] * len(found)))
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, k) for c, k in zip(zip(*found), kinds))], ["key", *names])

    kind = images.schema[key].dataType.simpleString()
    schema = f"key {kind}, tile_row int, tile_column int, npy binary, tile_hash string, image_hash string, error string"
    return images.select(F.col(key).alias("key"), F.col(data).alias("data")).mapInArrow(each, schema)


def read_tile(npy: bytes) -> np.ndarray:
    """The array of an NPY tile of 8-bit samples, as `tiles` writes them."""
    if npy[:8] != b"\x93NUMPY\x01\x00":
        raise ValueError("not an NPY tile")
    (n,) = struct.unpack_from("<H", npy, 8)
    said = _NPY.search(npy[10 : 10 + n])
    if not said:
        raise ValueError("an NPY tile of another kind of samples")
    return np.frombuffer(npy, np.uint8, offset=10 + n).reshape([int(x) for x in said[1].split(b",") if x.strip()])


def from_tiles(parts: list[tuple[int, int, bytes]]) -> np.ndarray:
    """The image of which `parts` are all tiles."""
    rows: dict[int, list[np.ndarray]] = {}
    for r, _, npy in sorted(parts, key=lambda p: p[:2]):
        rows.setdefault(r, []).append(read_tile(npy))
    return np.concatenate([np.concatenate(row, axis=1) for _, row in sorted(rows.items())])


def tiled_feature(samples: np.ndarray, size: int = SMALL, side: int = SIDE) -> tuple[str, int, str, int]:
    """Difference hash, number of tiles, their SHA-256 and the BMP's size of an image's reduced copy.

    The copy (`size` x `size`, by area averages) goes through BMP bytes and
    back, is written as NPY tiles, and is hashed from what the tiles hold.
    """
    small = np.clip(np.rint(area_resize(samples, size, size)), 0, 255).astype(np.uint8)
    stored = encode_bmp(small)
    parts = list(tiles(decode_bmp(stored), side))
    sha = hashlib.sha256(b"".join(npy for _, _, npy in parts)).hexdigest()
    return difference_hash(from_tiles(parts)), len(parts), sha, len(stored)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The UTF-8 bytes filled up with zeros to a positive multiple of WIDTH, and their own number."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH), b"\0"), len(raw)


def text_media(docs: DataFrame, form: str = "pgm", with_media: bool = False) -> DataFrame:
    """Each text of `docs` stored as a grey image WIDTH samples wide, and what is read back from it.

    doc_id, n_bytes, payload_bytes, payload_sha256 and tail_crc32 (of the last
    WIDTH bytes) come from the decoded samples, media_bytes and media_sha256
    from the stored form; feature, n_tiles, tiles_sha256 and thumb_bytes from
    the reduced copy and its tiles (see tiled_feature). A null or empty text is
    one row of zeros. Equal texts give equal values; repeated rows repeat.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_tiles", "tiles_sha256", "thumb_bytes", *["media"] * with_media]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.binary()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                payload, n = payload_of(text.as_py())
                stored = encode(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH), form)
                samples = decode(stored)
                back = samples.tobytes()
                sha = hashlib.sha256
                row = (doc_id, n, len(back), sha(back).hexdigest(), zlib.crc32(back[-WIDTH:]), len(stored), sha(stored).hexdigest(), *tiled_feature(samples))
                rows.append((*row, stored) if with_media else row)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names) if rows else pa.RecordBatch.from_arrays([pa.array([], k) for k in kinds[: len(names)]], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_tiles int, tiles_sha256 string, thumb_bytes long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(each, schema + ", media binary" * with_media)


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(documents(spark, sf_dir))
