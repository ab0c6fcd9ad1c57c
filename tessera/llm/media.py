"""Media columns: texts as 8-bit PNG images in a binary column, read back with all checks, and a hash of low frequencies.

The image is grey, 192 samples wide; its rows hold the payload byte for byte. A row's filter is the one of None, Sub and Up
with the least sum of absolute residuals; the reader takes all five filters of the format.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 192
IDAT_BYTES = 32 << 10
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Texts (or images) that one Arrow batch of the result holds at most, in bytes, besides a single larger one.
BATCH_BYTES = 8 << 20


class BadImage(ValueError):
    """The bytes are no image that read_png takes; the message says what is wrong."""


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def write_png(samples: np.ndarray, level: int = 4) -> bytes:
    """An 8-bit grey PNG of a (height, width) array of uint8."""
    height, width = samples.shape
    up = np.vstack([np.zeros((1, width), np.uint8), samples[:-1]])
    left = np.hstack([np.zeros((height, 1), np.uint8), samples[:, :-1]])
    tried = np.stack([samples, samples - left, samples - up])
    cost = np.abs(tried.view(np.int8).astype(np.int32)).sum(2)
    kind = cost.argmin(0)
    lines = np.hstack([kind[:, None].astype(np.uint8), tried[kind, np.arange(height)]])
    packed = zlib.compress(lines.tobytes(), level)
    body = [_chunk(b"IDAT", packed[i : i + IDAT_BYTES]) for i in range(0, len(packed), IDAT_BYTES)]
    return b"".join([SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)), *body, _chunk(b"IEND", b"")])


def _unfilter(lines: np.ndarray, width: int) -> np.ndarray:
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise BadImage("unknown filter")
    none = np.zeros(width, np.uint8)
    sub = kinds == 1
    out[sub] = np.cumsum(out[sub], 1, dtype=np.uint8)
    for y in np.flatnonzero(kinds > 1):
        above = out[y - 1] if y else none
        if kinds[y] == 2:
            out[y] += above
            continue
        row, a, c = out[y].tolist(), 0, 0
        for x, b in enumerate(above.tolist()):
            if kinds[y] == 3:
                guess = (a + b) // 2
            else:
                p = a + b - c
                pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
            a, c = (row[x] + guess) & 255, b
            row[x] = a
        out[y] = row
    return out


def read_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit grey PNG without interlace; BadImage if a length, a checksum or the format is wrong."""
    if data[:8] != SIGNATURE:
        raise BadImage("no PNG signature")
    at, header, packed, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise BadImage("cut off")
        n, kind = struct.unpack_from(">I4s", data, at)
        if at + 12 + n > len(data):
            raise BadImage("cut off")
        body = data[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise BadImage(f"checksum of {kind.decode('latin-1')}")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body) if n == 13 else None
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise BadImage(f"unknown critical chunk {kind.decode('latin-1')}")
        at += 12 + n
    if header is None or not ended:
        raise BadImage("no header or end")
    width, height, *form = header
    if form != [8, 0, 0, 0, 0] or not width or not height:
        raise BadImage("not 8-bit grey")
    try:
        inflate = zlib.decompressobj()
        lines = inflate.decompress(b"".join(packed), height * (width + 1) + 1)  # checks the Adler-32 at the end
    except zlib.error as e:
        raise BadImage(f"zlib: {e}") from None
    if len(lines) != height * (width + 1) or not inflate.eof:
        raise BadImage("wrong number of samples")
    return _unfilter(np.frombuffer(lines, np.uint8).reshape(height, width + 1), width)


@lru_cache(maxsize=4096)
def _low(n: int, side: int = 32, keep: int = 8) -> np.ndarray:
    """(keep, n): area averages to `side` samples, then the first `keep` cosine functions."""
    edge = np.linspace(0, n, side + 1)
    cover = np.clip(np.minimum(edge[1:, None], np.arange(1, n + 1)) - np.maximum(edge[:-1, None], np.arange(n)), 0, 1)
    cover /= cover.sum(1, keepdims=True)
    return np.cos(np.pi / side * (np.arange(side) + 0.5) * np.arange(keep)[:, None]) @ cover


def dct_hash(samples: np.ndarray) -> str:
    """16 hexadecimal digits: which of the 8 x 8 lowest cosine coefficients of the image, brought to 32 x 32, exceed their median (the constant one aside)."""
    height, width = samples.shape
    tall = _low(height) if height <= 4096 else _low.__wrapped__(height)
    low = np.round(tall @ samples.astype(np.float64) @ _low(width).T, 6).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


def payload(text: bytes) -> bytes:
    """text, then bytes 32 up to a positive multiple of WIDTH."""
    return text.ljust(max(WIDTH, -(-len(text) // WIDTH) * WIDTH), b" ")


def _flush(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _encode(schema: pa.Schema, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held = text.as_buffer().to_pybytes() if text.is_valid else b""
                image = write_png(np.frombuffer(payload(held), np.uint8).reshape(-1, WIDTH), level)
                rows.append((key, len(held), image))
                size += len(image)
                if size > BATCH_BYTES:
                    yield _flush(rows, schema)
                    rows, size = [], 0
            if rows:
                yield _flush(rows, schema)

    return run


def _features(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for *kept, media in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    if media is None:
                        raise BadImage("null")
                    samples = read_png(media)
                    read = samples.tobytes()
                    rows.append((*kept, len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-16:]), len(media), hashlib.sha256(media).hexdigest(), dct_hash(samples), None))
                except BadImage as e:
                    rows.append((*kept, None, None, None, None if media is None else len(media), None if media is None else hashlib.sha256(media).hexdigest(), None, str(e)))
            if rows:
                yield _flush(rows, schema)

    return run


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: int = 4) -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as a PNG. Null counts as empty; rows stay as they are, whatever the id; an empty table gives an empty one."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("n_bytes", pa.int64()), ("media", pa.binary())])
    return rows.mapInArrow(_encode(schema, level), f"doc_id {kind.simpleString()}, n_bytes long, media binary")


def media_features(df: DataFrame, keep: list[str], media_col: str = "media") -> DataFrame:
    """The columns `keep`, then what the stored images give when read back; a null or damaged image gives nulls and a media_error instead."""
    from pyspark.sql.pandas.types import to_arrow_type

    rows = df.select(*keep, media_col)
    kinds = [(f.name, f.dataType) for f in rows.schema.fields[:-1]]
    schema = pa.schema([*((n, to_arrow_type(t)) for n, t in kinds), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("media_error", pa.string())])
    held = "".join(f"`{n}` {t.simpleString()}, " for n, t in kinds)
    return rows.mapInArrow(_features(schema), held + "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_error string")
