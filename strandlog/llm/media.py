"""Texts as lossless PNG images in a binary column, read back chunk by chunk, with a perceptual hash.

``encode_png`` stores a payload as 8-bit grey samples, 64 to a row; ``decode_png`` walks the chunks of stored bytes, tests
every chunk's CRC, inflates the image data and undoes all five PNG row filters with numpy; ``cosine_hash`` keeps the signs
of the low-frequency coefficients of a two-dimensional cosine transform.

Edge cases: a null or empty text is one row of 64 zero samples; equal texts give equal bytes and values; a text may have
any length (one image is held at a time); a damaged chunk raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandlog.llm.common import Scratch, lean, slices

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples to a row.
WIDTH = 64
#: Side of the reduced image and of the kept block of coefficients.
SIDE, LOW = 32, 8


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def pad(text: str | None, unit: int = WIDTH) -> tuple[bytes, int]:
    """The text's UTF-8 bytes with zero bytes up to a positive multiple of ``unit``, and their number without them."""
    raw = (text or "").encode()
    return raw + bytes(max(unit, -(-len(raw) // unit) * unit) - len(raw)), len(raw)


def encode_png(payload: bytes, width: int = WIDTH, level: int = 2) -> bytes:
    """A grey PNG. A row like the one above is filtered by it and a row of one value by its left neighbours, which leaves
    zeros; other rows stay plain, since text deflates best so."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    filtered = np.zeros((len(rows), width + 1), np.uint8)
    filtered[:, 1:] = rows
    above = np.append(False, (rows[1:] == rows[:-1]).all(axis=1))
    even = (rows == rows[:, :1]).all(axis=1) & ~above
    filtered[above, 0], filtered[above, 1:] = 2, 0
    filtered[even, 0], filtered[even, 2:] = 1, 0
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(filtered, level)) + _chunk(b"IEND", b"")


def unfilter(kinds: np.ndarray, rows: np.ndarray, bpp: int = 1) -> np.ndarray:
    """Undo the PNG row filters: none, left, up, average and Paeth (``bpp`` bytes to a sample).

    Runs of rows of one kind are done at once: sums along rows or columns, or, for the kinds that look both ways, along the
    diagonals of the run, whose samples don't depend on each other.
    """
    if len(kinds) and kinds.max() > 4:
        raise ValueError(f"row filter {kinds.max()}")
    out = rows.copy()
    width = rows.shape[1] // bpp
    edges = [0, *(np.flatnonzero(kinds[1:] != kinds[:-1]) + 1).tolist(), len(kinds)]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        kind = int(kinds[lo]) if hi > lo else 0
        if kind == 0:
            continue
        run = out[lo:hi].reshape(hi - lo, width, bpp)
        above = out[lo - 1].reshape(width, bpp) if lo else np.zeros((width, bpp), np.uint8)
        if kind == 1:
            np.cumsum(run, axis=1, dtype=np.uint8, out=run)
        elif kind == 2:
            run[0] += above
            np.cumsum(run, axis=0, dtype=np.uint8, out=run)
        else:
            # a frame of the row above and a zero column on the left gives every sample its three neighbours
            frame = np.zeros((hi - lo + 1, width + 1, bpp), np.int32)
            frame[0, 1:], frame[1:, 1:] = above, run
            for d in range(width + hi - lo - 1):
                y = np.arange(max(0, d - width + 1), min(hi - lo - 1, d) + 1) + 1
                x = d - (y - 1) + 1
                left, up, corner = frame[y, x - 1], frame[y - 1, x], frame[y - 1, x - 1]
                if kind == 3:
                    guess = (left + up) >> 1
                else:
                    far = [np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)]
                    guess = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], up, corner))
                frame[y, x] = (frame[y, x] + guess) & 255
            run[:] = frame[1:, 1:]
    return out


def decode_png(stored: bytes) -> np.ndarray:
    """The samples of an 8-bit grey PNG, rows by columns."""
    if stored[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, shape, packed, ended = 8, None, [], False
    while at < len(stored) and not ended:
        size, kind = struct.unpack_from(">I4s", stored, at)
        body = stored[at + 8 : at + 8 + size]
        if len(body) != size or struct.unpack_from(">I", stored, at + 8 + size)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            width, height, depth, colour, method, filters, interlace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, method, filters, interlace) != (8, 0, 0, 0, 0):
                raise ValueError("not a plain 8-bit grey image")
            shape = (height, width)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if shape is None or not ended:
        raise ValueError("a chunk is missing")
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    rows = raw.reshape(shape[0], shape[1] + 1)
    return unfilter(rows[:, 0], rows[:, 1:])


def _cosines(n: int, low: int) -> np.ndarray:
    k, x = np.mgrid[:low, :n]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n)) * np.sqrt(2 / n)


_DCT = _cosines(SIDE, LOW)


def reduced(samples: np.ndarray, side: int = SIDE) -> np.ndarray:
    """Means over a grid of side by side cells; a short image's rows are repeated."""
    rows = np.add.reduceat(samples.astype(np.float64), np.arange(0, samples.shape[1], samples.shape[1] // side), axis=1)
    edges = np.arange(side) * len(rows) // side
    ends = np.maximum(edges + 1, np.append(edges[1:], len(rows)))
    sums = np.vstack([np.zeros(rows.shape[1]), np.cumsum(rows, axis=0)])
    return (sums[ends] - sums[edges]) / (ends - edges)[:, None]


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest coefficients exceed their median (the constant term does not count)."""
    low = (_DCT @ reduced(samples) @ _DCT.T).round(6).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes()


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the binary column ``media`` with the PNG of each row's whole text; other columns are ignored."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                padded = [pad(x) for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array([n for _, n in padded], pa.int64()), pa.array([encode_png(p) for p, _ in padded], pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, n_bytes long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, hash binary"


def media_features(media: DataFrame) -> DataFrame:
    """Read every stored image back: digests of the samples and of the stored form, and the cosine hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n, stored in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("media").to_pylist(), strict=True):
                samples = decode_png(stored)
                payload, bits = samples.tobytes(), cosine_hash(samples)
                rows.append({"doc_id": doc_id, "n_bytes": n, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]), "media_bytes": len(stored), "media_sha256": hashlib.sha256(stored).hexdigest(), "feature": bits.hex(), "hash": bits})
            if rows:
                yield pa.RecordBatch.from_pylist(rows)

    return media.mapInArrow(lean(run), FEATURES)


def media_digest(docs: DataFrame) -> DataFrame:
    """Store all texts as a media table in the shared folder, then compute features from the stored bytes."""
    return media_features(Scratch(docs.sparkSession).cut(to_media(docs), "media"))
