"""Media columns: Netpbm and BMP images to NPY tiles with difference hashes.

``decode`` reads P1 to P6 (plain and raw, maxima to 65535, comments) and uncompressed BMP of 1,
4, 8, 24 and 32 bits (bottom-up or top-down) into a numpy array of height x width x channels.
An image larger than ``box`` pixels on a side is reduced to fit, never enlarged, by area
averaging: each new pixel is the mean over its exact rectangle of old ones, read off an
integral image at fractional corners. The result is cut into tiles of ``tile`` pixels (those
at the right and lower edge keep what is left), each stored as the bytes of an NPY file. The
difference hash compares neighbours of the grey image reduced to 9 x 8: 64 bits.

Defined cases. A null or undecodable value gives one row with its ``status`` and no tile; all
other rows have status ``ok``. Images without pixels don't exist (``empty``). Samples above 8
bits are scaled to 8; plain samples that aren't numbers from 0 to the maximum are a ``bad
sample``. An image of more than ``max_pixels`` is ``out of range``: the bound, a parameter, is
what a task's memory must hold. BMP of 32 bits with colour masks are read if each mask is a byte.
Repeated rows give repeated tiles. Extra columns don't matter.
"""

from __future__ import annotations

import io
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorframe.llm.shared import filesystem, write_bytes

#: Largest side after reduction, side of a tile, and most pixels of an image that is decoded by default.
BOX, TILE, MAX_PIXELS = 64, 32, 1 << 28


class Undecodable(ValueError):
    """Why a value is no image; the message is the row's status."""


def _netpbm(data: bytes, max_pixels: int) -> np.ndarray:
    kind = data[1] - 48
    fields, at = [], 2
    for _ in range(2 if kind in (1, 4) else 3):
        m = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*(\d+)").match(data, at)
        if not m:
            raise Undecodable("bad header")
        digits = m[1].lstrip(b"0") or b"0"
        fields.append(int(digits) if len(digits) < 12 else 10**12)  # far out of range
        at = m.end()
    width, height, most = *fields[:2], fields[2] if len(fields) > 2 else 1
    if not width or not height:
        raise Undecodable("empty")
    if width * height > max_pixels or not 0 < most < 65536:
        raise Undecodable("out of range")
    channels = 3 if kind in (3, 6) else 1
    n = width * height * channels
    if kind == 4:
        row = -(-width // 8)
        raw = np.frombuffer(data, np.uint8, offset=at + 1, count=-1) if len(data) > at + 1 else np.zeros(0, np.uint8)
        if len(raw) < row * height:
            raise Undecodable("truncated")
        return np.where(np.unpackbits(raw[: row * height].reshape(height, row), axis=1)[:, :width, None], 0, 255).astype(np.uint8)
    if kind >= 5:
        size = 2 if most > 255 else 1
        if len(data) < at + 1 + n * size:
            raise Undecodable("truncated")
        out = np.frombuffer(data, ">u2" if size == 2 else np.uint8, count=n, offset=at + 1)
    elif kind == 1:
        body = re.sub(rb"#[^\n\r]*", b"", data[at:])
        out = np.frombuffer(re.sub(rb"[^01]", b"", body), np.uint8)[:n] ^ 49  # 1 is black
    else:
        words = re.sub(rb"#[^\n\r]*", b"", data[at:]).split(None, n)[:n]
        if not all(w.isdigit() and len(w.lstrip(b"0")) < 6 for w in words):
            raise Undecodable("bad sample")
        out = np.array(words, dtype=np.int64)
        if len(out) and out.max() > most:
            raise Undecodable("bad sample")
    if len(out) < n:
        raise Undecodable("truncated")
    if most != 255:
        out = (np.minimum(out, most).astype(np.uint32) * 255 + most // 2) // most
    return out.astype(np.uint8).reshape(height, width, channels)


def _bmp(data: bytes, max_pixels: int) -> np.ndarray:
    if len(data) < 54:
        raise Undecodable("bad header")
    start, header, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    colours = struct.unpack_from("<I", data, 46)[0]
    if header < 40 or bits not in (1, 4, 8, 24, 32) or packed not in (0, 3) or (packed == 3 and bits != 32):
        raise Undecodable("unsupported")
    if width <= 0 or not height:
        raise Undecodable("empty")
    rows = abs(height)
    if width * rows > max_pixels:
        raise Undecodable("out of range")
    stride = (width * bits + 31) // 32 * 4
    if len(data) < start + stride * rows:
        raise Undecodable("truncated")
    raw = np.frombuffer(data, np.uint8, count=stride * rows, offset=start).reshape(rows, stride)
    if bits >= 24:
        step = bits // 8
        out = raw[:, : width * step].reshape(rows, width, step)
        out = out[:, :, _masked_bytes(data) if packed == 3 else [2, 1, 0]]
    else:
        n = colours or 1 << bits
        if len(data) < 14 + header + 4 * n:
            raise Undecodable("truncated")
        palette = np.frombuffer(data, np.uint8, count=4 * n, offset=14 + header).reshape(n, 4)[:, 2::-1]
        per = 8 // bits
        index = (raw[:, :, None] >> (8 - bits * (1 + np.arange(per)))) & ((1 << bits) - 1)
        out = palette[np.minimum(index.reshape(rows, stride * per)[:, :width], n - 1)]
    return np.ascontiguousarray(out if height < 0 else out[::-1])


def _masked_bytes(data: bytes) -> list[int]:
    """Which of a pixel's four bytes are its red, green and blue."""
    if len(data) < 66:
        raise Undecodable("truncated")
    masks = struct.unpack_from("<3I", data, 54)
    if not set(masks) <= {0xFF << 8 * i for i in range(4)}:
        raise Undecodable("unsupported")
    return [(m.bit_length() - 1) // 8 for m in masks]


def decode(data: bytes, max_pixels: int = MAX_PIXELS) -> np.ndarray:
    """Height x width x channels (1 or 3) array of bytes."""
    if re.match(rb"P[1-6][\s#]", data):
        return _netpbm(data, max_pixels)
    if data[:2] == b"BM":
        return _bmp(data, max_pixels)
    raise Undecodable("unknown format")


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over exact rectangles, as floats, from an integral image at fractional corners."""
    h, w, c = image.shape
    total = np.zeros((h + 1, w + 1, c))
    np.cumsum(np.cumsum(image, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])

    def cut(a: np.ndarray, axis: int, old: int, new: int) -> np.ndarray:
        place = np.arange(new + 1) * (old / new)
        low = np.minimum(place.astype(np.int64), old - 1)
        part = (place - low).reshape([-1 if i == axis else 1 for i in range(3)])
        return np.diff(np.take(a, low, axis) * (1 - part) + np.take(a, low + 1, axis) * part, axis=axis)

    return cut(cut(total, 0, h, height), 1, w, width) * ((height / h) * (width / w))


def fit_box(image: np.ndarray, box: int = BOX) -> np.ndarray:
    """The image, reduced if a side is above ``box``."""
    h, w, _ = image.shape
    if max(h, w) <= box:
        return image
    scale = box / max(h, w)
    return np.clip(np.rint(area_resize(image, max(1, round(h * scale)), max(1, round(w * scale)))), 0, 255).astype(np.uint8)


def grey(image: np.ndarray) -> np.ndarray:
    return image.astype(np.float64) if image.shape[2] == 1 else image @ np.array([[0.299], [0.587], [0.114]])


def difference_hash(image: np.ndarray) -> int:
    """64 bits, row by row: whether each of 9 x 8 areas is darker than its right neighbour (signed)."""
    small = area_resize(grey(image), 8, 9)[:, :, 0]
    bits = np.packbits(small[:, :-1] + 1e-9 < small[:, 1:])
    return int.from_bytes(bits.tobytes(), "big", signed=True)


def npy(array: np.ndarray) -> bytes:
    np.save(out := io.BytesIO(), np.ascontiguousarray(array), allow_pickle=False)
    return out.getvalue()


def tiles(image: np.ndarray, tile: int = TILE) -> Iterator[tuple[int, int, np.ndarray]]:
    """Row, column and pixels of each tile."""
    for y in range(0, image.shape[0], tile):
        for x in range(0, image.shape[1], tile):
            yield y // tile, x // tile, image[y : y + tile, x : x + tile]


_SCHEMA = [("status", T.StringType()), ("width", T.IntegerType()), ("height", T.IntegerType()), ("channels", T.IntegerType()), ("image_hash", T.LongType()), ("tile_row", T.IntegerType()), ("tile_column", T.IntegerType()), ("tile_hash", T.LongType()), ("tile", T.BinaryType())]
_ARROW = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]


def media_tiles(media: DataFrame, id_column: str = "doc_id", column: str = "media", box: int = BOX, tile: int = TILE, max_pixels: int = MAX_PIXELS) -> DataFrame:
    """One row for each tile of the images in a binary column; see the module.

    (id, status, width, height, channels, image_hash, tile_row, tile_column, tile_hash, tile):
    sizes are those of the decoded image, ``tile`` an NPY file of the reduced one.
    """
    narrow = media.select(F.col(id_column).alias("doc_id"), F.col(column).alias("media"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows, out = [], []
                for n, value in enumerate(part.column("media")):
                    try:
                        if not value.is_valid:
                            raise Undecodable("null")
                        image = decode(value.as_buffer().to_pybytes(), max_pixels)
                    except Undecodable as why:
                        rows.append(n)
                        out.append((str(why), *[None] * 8))
                        continue
                    h, w, c = image.shape
                    whole = difference_hash(image)
                    for y, x, cut in tiles(fit_box(image, box), tile):
                        rows.append(n)
                        out.append(("ok", w, h, c, whole, y, x, difference_hash(cut), npy(cut)))
                columns = [pa.array(list(v), kind) for v, kind in zip(zip(*out), _ARROW)] if out else [pa.array([], kind) for kind in _ARROW]
                yield pa.record_batch([part.column("doc_id").take(pa.array(rows, pa.int64())), *columns], ["doc_id", *(n for n, _ in _SCHEMA)])

    return narrow.mapInArrow(run, T.StructType([narrow.schema["doc_id"], *(T.StructField(n, k) for n, k in _SCHEMA)]))


def write_tiles(tiled: DataFrame, uri: str) -> DataFrame:
    """Write each tile as <uri>/<id>/<row>-<column>.npy; (doc_id, file) of those written.

    A file is moved into place whole, so retried tasks leave the same files. Tiles of rows with
    the same id and place replace one another.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, files = [], []
            for i, y, x, tile in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tile_row", "tile_column", "tile"))):
                if tile is not None:
                    ids.append(i)
                    files.append(f"{uri}/{i}/{y}-{x}.npy")
                    write_bytes(files[-1], tile)
            yield pa.record_batch([pa.array(ids, batch.schema.field("doc_id").type), pa.array(files, pa.string())], ["doc_id", "file"])

    return tiled.select("doc_id", "tile_row", "tile_column", "tile").mapInArrow(run, T.StructType([tiled.schema["doc_id"], T.StructField("file", T.StringType())]))


def read_tile(uri: str) -> np.ndarray:
    """A tile back as an array."""
    fs, path = filesystem(uri)
    with fs.open_input_stream(path) as src:
        return np.load(io.BytesIO(src.read()), allow_pickle=False)


def _little(n: Column) -> Column:
    """A number as four bytes, the lowest first."""
    h = F.lpad(F.hex(n.cast("long")), 8, "0")
    return F.unhex(F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2)))


def text_as_image(text: Column, kind: Column, width: int = 48) -> Column:
    """The bytes of a text as pixels of an image: a stand-in for a media column, made in the JVM.

    By ``kind`` modulo 5: raw grey Netpbm, raw colour Netpbm, bitmap Netpbm, BMP of 24 bits, BMP
    of 8 bits. Rows are ``width`` pixels (a multiple of 8), the last one filled up with spaces.
    """
    bytes_ = F.encode(text, "UTF-8")
    n = F.octet_length(text)

    def rows(per_row: int) -> Column:
        return F.greatest(F.lit(1), F.ceil(n / F.lit(per_row))).cast("long")

    def padded(per_row: int) -> Column:
        return F.rpad(bytes_, (rows(per_row) * F.lit(per_row)).cast("int"), F.lit(b" "))

    def header(magic: str, per_row: int, rest: str) -> Column:
        return F.encode(F.concat(F.lit(f"{magic}\n{width} "), rows(per_row).cast("string"), F.lit(rest)), "UTF-8")

    def bmp(bits: int, per_row: int) -> Column:
        colours = 256 if bits == 8 else 0
        start = 54 + 4 * colours
        palette = b"".join(bytes([i, 255 - i, (7 * i) % 256, 0]) for i in range(colours))
        size = rows(per_row) * F.lit(per_row)
        info = struct.pack("<HHI", 1, bits, 0)
        return F.concat(F.lit(b"BM"), _little(size + F.lit(start)), F.lit(bytes(4)), F.lit(struct.pack("<IIi", start, 40, width)), _little(rows(per_row)), F.lit(info), _little(size), F.lit(struct.pack("<iiII", 2835, 2835, colours, 0)), F.lit(palette), padded(per_row))

    k = F.pmod(F.coalesce(kind, F.lit(0)), F.lit(5))
    return (
        F.when(k == 0, F.concat(header("P5", width, "\n255\n"), padded(width)))
        .when(k == 1, F.concat(header("P6", 3 * width, "\n255\n"), padded(3 * width)))
        .when(k == 2, F.concat(header("P4", width // 8, "\n"), padded(width // 8)))
        .when(k == 3, bmp(24, 3 * width))
        .otherwise(bmp(8, width))
    )
