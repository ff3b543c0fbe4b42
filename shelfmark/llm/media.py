"""Media columns: payloads as PNG images in binary columns, and their low-frequency hashes.

A payload becomes an 8-bit grey image 64 samples wide: signature, IHDR, IDAT (zlib over filtered rows)
and IEND chunks with checksums. Reading tests every checksum and undoes the filters with numpy. The
hash is the sign pattern of the 8 x 8 lowest cosine-transform terms of the image scaled to 32 x 32.

Edge cases. Null and empty texts give one row of zeros; payloads are padded with zeros to whole rows,
at least one; damaged bytes raise ValueError; each row, repeated ones too, gives a row, and an empty table none;
columns named as those that are added are replaced, any others pass through.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, mapped, packed

WIDTH = 64
#: Fixed value: the format's signature.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
_COSINES = np.cos(np.pi / 32 * np.arange(8)[:, None] * (np.arange(32)[None, :] + 0.5))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes, width: int = WIDTH) -> bytes:
    """A PNG whose samples are the payload, a positive multiple of `width` bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    left, up = np.zeros_like(rows), np.zeros_like(rows)
    left[:, 1:], up[1:] = rows[:, :-1], rows[:-1]
    tried = np.stack((rows, rows - left, rows - up))
    kind = np.abs(tried.view(np.int8).astype(np.int16)).sum(axis=2).argmin(axis=0)
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0] = kind
    lines[:, 1:] = tried[kind, np.arange(len(rows))]
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def _average(line: np.ndarray, up: np.ndarray) -> np.ndarray:
    a, out = 0, bytearray()
    for x, b in zip(line.tolist(), up.tolist(), strict=True):
        a = (x + (a + b >> 1)) & 255
        out.append(a)
    return np.frombuffer(bytes(out), np.uint8)


def _paeth(line: np.ndarray, up: np.ndarray) -> np.ndarray:
    a, c, out = 0, 0, bytearray()
    for x, b in zip(line.tolist(), up.tolist(), strict=True):
        p = a + b - c
        near = min((abs(p - v), i, v) for i, v in enumerate((a, b, c)))[2]
        a, c = (x + near) & 255, b
        out.append(a)
    return np.frombuffer(bytes(out), np.uint8)


def decode(data: bytes) -> np.ndarray:
    """The samples [row, column] of an 8-bit grey PNG without interlacing."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, body, ended = 8, None, [], False
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("cut chunk")
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        if at + 12 + n > len(data) or zlib.crc32(data[at + 4 : at + 8 + n]) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            head = struct.unpack_from(">IIBBBBB", data, at + 8)
        elif kind == b"IDAT":
            body.append(data[at + 8 : at + 8 + n])
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise ValueError(f"critical chunk {kind!r} isn't known")
        at += 12 + n
    if not head or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grey PNG")
    width, height = head[:2]
    try:
        raw = zlib.decompress(b"".join(body))
    except zlib.error as e:
        raise ValueError("IDAT is damaged") from e
    if len(raw) != height * (width + 1):
        raise ValueError("wrong number of samples")
    lines = np.frombuffer(raw, np.uint8).reshape(height, width + 1)
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if (kinds > 4).any():
        raise ValueError("unknown filter")
    sub = kinds == 1
    out[sub] = np.cumsum(out[sub], axis=1, dtype=np.uint8)
    zero = np.zeros(width, np.uint8)
    for i in np.flatnonzero(kinds > 1).tolist():
        up = out[i - 1] if i else zero
        out[i] = out[i] + up if kinds[i] == 2 else (_average if kinds[i] == 3 else _paeth)(out[i], up)
    return out


def cosine_hash(image: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest cosine terms are above their median (the constant term left out of it)."""
    for axis in (0, 1):
        n = image.shape[axis]
        edges = np.arange(33) * n // 32
        if n >= 32:
            image = np.add.reduceat(image, edges[:-1], axis=axis, dtype=np.float64) / np.diff(edges).reshape((-1, 1) if axis == 0 else (1, -1))
        else:
            image = np.take(image, edges[:-1], axis=axis).astype(np.float64)
    low = np.round(_COSINES @ image @ _COSINES.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def payload_of(text: bytes, width: int = WIDTH) -> bytes:
    return text + bytes(-len(text) % width or (0 if text else width))


def with_media(docs: DataFrame, text_col: str = "text", *, media: str = "media", feature: str = "media_hash") -> DataFrame:
    """docs with two binary columns: the text as a PNG, and the hash of the image read back."""
    names = [c for c in docs.columns if c not in (media, feature)]
    rows = docs.select(packed(docs, (media, feature)), column(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images = [encode(payload_of((t or "").encode())) for t in batch["text"].to_pylist()]
            hashes = [cosine_hash(decode(x)) for x in images]
            yield pa.RecordBatch.from_arrays([batch["_row"], pa.array(images, pa.binary()), pa.array(hashes, pa.binary())], names=["_row", "media", "hash"])

    made = mapped(rows, run, rows.select("_row").withColumns({"media": F.lit(b""), "hash": F.lit(b"")}).schema)
    return made.select(*[F.col("_row")[c].alias(c) for c in names], F.col("media").alias(media), F.col("hash").alias(feature))


def digests(stored: DataFrame, id_col: str = "doc_id", n_bytes: str = "n_bytes", *, media: str = "media", feature: str = "media_hash") -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of stored images, read back."""
    schema = stored.select(id_col, n_bytes).withColumns({"payload_bytes": F.lit(0).cast("long"), "payload_sha256": F.lit(""), "tail_crc32": F.lit(0).cast("long"), "media_bytes": F.lit(0).cast("long"), "media_sha256": F.lit(""), "feature": F.lit("")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for image, code in zip(batch[media].to_pylist(), batch[feature].to_pylist(), strict=True):
                payload = decode(image).tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(image), hashlib.sha256(image).hexdigest(), code.hex()))
            made = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([batch[id_col], batch[n_bytes], *(pa.array(list(v), f) for v, f in zip(made, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], names=schema.names)

    return mapped(stored.select(id_col, n_bytes, media, feature), run, schema)
