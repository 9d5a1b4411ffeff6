"""Media columns: Netpbm and BMP pixels, area resizing, NPY tiles, difference hashes.

Codecs are small numpy functions over the bytes of one row and run inside Spark
tasks. 8-bit samples only: PGM (P5), PPM (P6) and BMP with 8 or 24 bits a pixel,
uncompressed.

``store_texts`` keeps any text as an image: its UTF-8 bytes, filled with 255 up to
a positive multiple of 576, are the samples of a binary PGM 24 pixels wide, so
what is stored can be read back byte for byte.

Defined results: null and empty texts are one tile of 576 times 255; equal texts
give equal values; repeated rows stay; long texts are resized in bands of rows,
so memory beyond the stored bytes is bounded; an empty table gives no rows;
columns other than doc_id and text are ignored. Damaged images raise ValueError.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.functions import pandas_udf
from pyspark.sql.pandas.types import to_arrow_schema

WIDTH, TILE, FILL = 24, 576, 255
#: Difference hashes compare 8 neighbours in each of 8 rows.
HASH_COLUMNS, HASH_ROWS = 9, 8
BAND = 1 << 15

STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string"


def write_netpbm(pixels: np.ndarray) -> bytes:
    """P5 for rows x columns, P6 for rows x columns x 3."""
    kind = b"P5" if pixels.ndim == 2 else b"P6"
    return b"%s\n%d %d\n255\n" % (kind, pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def read_netpbm(data: bytes) -> np.ndarray:
    if data[:2] not in (b"P5", b"P6"):
        raise ValueError("not a binary PGM or PPM")
    fields, at = [], 2
    while len(fields) < 3:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("damaged Netpbm header")
        fields.append(int(data[at:end]))
        at = end
    width, height, most = fields
    shape = (height, width) if data[:2] == b"P5" else (height, width, 3)
    if most != 255 or len(data) - at - 1 < int(np.prod(shape)):
        raise ValueError("only whole images of 8-bit samples can be read")
    return np.frombuffer(data, np.uint8, int(np.prod(shape)), at + 1).reshape(shape)


def write_bmp(pixels: np.ndarray) -> bytes:
    """8-bit grey with its palette, or 24-bit colour; rows from the bottom, padded to 4 bytes."""
    height, width, channels = *pixels.shape[:2], pixels.shape[2] if pixels.ndim == 3 else 1
    row = -(-width * channels // 4) * 4
    body = np.zeros((height, row), np.uint8)
    body[:, : width * channels] = (pixels[:, :, ::-1] if channels == 3 else pixels).reshape(height, -1)[::-1]
    palette = b"" if channels == 3 else np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).tobytes()
    offset = 54 + len(palette)
    head = struct.pack("<2sIHHI", b"BM", offset + body.size, 0, 0, offset)
    info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8 * channels, 0, body.size, 2835, 2835, 0 if channels == 3 else 256, 0)
    return head + info + palette + body.tobytes()


def read_bmp(data: bytes) -> np.ndarray:
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP")
    offset, size, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    used = struct.unpack_from("<I", data, 46)[0] or 256
    channels = bits // 8
    row, rows = -(-width * channels // 4) * 4, abs(height)
    if packed or bits not in (8, 24) or len(data) < offset + row * rows:
        raise ValueError("only whole, uncompressed BMP images of 8 or 24 bits can be read")
    body = np.frombuffer(data, np.uint8, row * rows, offset).reshape(rows, row)[:, : width * channels]
    body = body[::-1] if height > 0 else body
    if bits == 24:
        return body.reshape(rows, width, 3)[:, :, ::-1]
    palette = np.frombuffer(data, np.uint8, used * 4, 14 + size).reshape(used, 4)[:, 2::-1]
    colours = palette[body]
    return colours[:, :, 0] if (palette[:, :1] == palette).all() else colours


def decode(data: bytes) -> np.ndarray:
    return read_bmp(data) if data[:2] == b"BM" else read_netpbm(data)


def write_npy(pixels: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(pixels), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def _sampled(integral: np.ndarray, at: np.ndarray, axis: int) -> np.ndarray:
    """Linear between the entries of a running sum: a pixel counts by the part of it that is inside."""
    low = np.minimum(np.floor(at).astype(np.int64), integral.shape[axis] - 2)
    shape = [1] * integral.ndim
    shape[axis] = -1
    part = (at - low).reshape(shape)
    return np.take(integral, low, axis) * (1 - part) + np.take(integral, low + 1, axis) * part


def area_resize(pixels: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Mean of the area each target pixel covers, as float64, from the integral image.

    The integral image is built in bands of rows and kept only at the edges of
    the target pixels. Means are rounded to 1e-6 so that flat areas stay flat.
    """
    height, width = pixels.shape[:2]
    ys, xs = np.arange(rows + 1) * height / rows, np.arange(columns + 1) * width / columns
    edges = np.zeros((rows + 1, columns + 1, *pixels.shape[2:]))
    above = np.zeros((1, columns + 1, *pixels.shape[2:]))
    for top in range(0, height, BAND):
        band = pixels[top : top + BAND].astype(np.float64)
        across = np.concatenate([np.zeros_like(band[:, :1]), np.cumsum(band, axis=1)], axis=1)
        down = np.concatenate([above, above + np.cumsum(_sampled(across, xs, 1), axis=0)])
        inside = (ys >= top) & (ys <= top + len(band))
        edges[inside] = _sampled(down, ys[inside] - top, 0)
        above = down[-1:]
    sums = np.diff(np.diff(edges, axis=0), axis=1)
    return np.round(sums * (rows * columns / (height * width)), 6)


def difference_hash(pixels: np.ndarray) -> tuple[str, np.ndarray]:
    """64 bits as 16 hexadecimal digits: whether each cell is brighter than its right neighbour; and the tile."""
    grey = pixels if pixels.ndim == 2 else pixels.astype(np.float64).mean(axis=2)
    small = area_resize(grey, HASH_ROWS, HASH_COLUMNS)
    bits = small[:, :-1] > small[:, 1:]
    return np.packbits(bits).tobytes().hex(), np.floor(small + 0.5).astype(np.uint8)


def describe(data: bytes) -> dict:
    """Decode one image and give its size, hash and NPY tile."""
    pixels = decode(data)
    feature, tile = difference_hash(pixels)
    return {"height": pixels.shape[0], "width": pixels.shape[1], "channels": 1 if pixels.ndim == 2 else 3, "feature": feature, "tile": write_npy(tile)}


def describe_images(images: DataFrame, column: str = "image") -> DataFrame:
    """Add height, width, channels, feature and the NPY tile to rows with image bytes; null stays null, damaged images raise."""
    schema = "height int, width int, channels int, feature string, tile binary"
    @pandas_udf(schema)
    def described(data: pd.Series) -> pd.DataFrame:
        none = dict.fromkeys(("height", "width", "channels", "feature", "tile"))
        return pd.DataFrame([none if x is None else describe(bytes(x)) for x in data], columns=list(none)).astype({k: "Int32" for k in ("height", "width", "channels")})

    return images.withColumn("media", described(column))


def store_texts(docs: DataFrame, with_media: bool = False) -> DataFrame:
    """One row per document: figures of the stored PGM and, if asked for, the PGM and its tile themselves."""
    fields = STORED + (", media binary, tile binary" if with_media else "")
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    fields = fields.replace("doc_id long", f"doc_id {doc_type}")
    rows = docs.select("doc_id", "text")
    schema = docs.sparkSession.createDataFrame([], fields).schema

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_schema = to_arrow_schema(schema)
        for batch in batches:
            out: list[tuple] = []
            for i, text in enumerate(batch.column(1)):
                raw = (text.as_py() or "").encode()
                payload = raw + bytes([FILL]) * (-len(raw) % TILE or (0 if raw else TILE))
                media = write_netpbm(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH))
                pixels = decode(media)
                read = pixels.tobytes()
                feature, tile = difference_hash(pixels)
                tile = write_npy(tile)
                row = (len(raw), len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, hashlib.sha256(tile).hexdigest())
                out.append(row + ((media, tile) if with_media else ()))
            columns = [batch.column(0), *(pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * (len(out_schema) - 1), [f.type for f in out_schema][1:]))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, out_schema)], schema=out_schema)

    return rows.mapInArrow(stored, schema)
