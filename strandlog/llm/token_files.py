"""Token-ID shards: independent zstandard frames, a checksum for each, and a trailing seek table.

A shard is a run of zstandard frames. Each frame holds the ids of whole documents (a document longer than a frame's
target size has a frame of its own), so a reader that wants some documents decompresses their frames only. Behind the data
frames stands a skippable frame with the document directory (doc ids and token counts, itself compressed) and, last, the
skippable frame with the seek table of zstandard's seekable format: for each frame its compressed and decompressed size
and the low 32 bits of XXH64 of its content. Any zstandard tool can decompress a shard; one that knows the format can seek.

Shards are written by executors straight to the shared store (any URI that pyarrow.fs opens) under a name of their own for
each attempt; the manifest names those of the attempts that ended well, and what a lost attempt left is never read. The
order of documents over all shards is ascending by doc_id (null first; equal ids by the hash of the text).

Defined results: a null or empty text has the end id alone; repeated rows are as many documents, equal ones dealt over
shards by the partition that they come from; ties in the order are between equal rows only; an empty table gives one empty
shard; a text longer than a frame has a frame of its own; other columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from strandlog.llm.common import lean, slices
from strandlog.llm.tokens import tokenizer
from strandlog.scratch import scratch_path

# Fixed values of the seekable format.
SEEK_MAGIC = 0x8F92EAB1
SKIPPABLE = 0x184D2A5E
DIRECTORY = 0x184D2A50
CHECKSUMS = 0x80

#: Uncompressed bytes after which a frame is closed.
FRAME_BYTES = 1 << 18
#: Text bytes that a shard is planned to hold.
SHARD_TEXT = 24 << 20

MANIFEST = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType())])


class ShardWriter:
    """Writes one shard to a file object; ids come as little-endian bytes of ``width`` bytes an id."""

    def __init__(self, sink, width: int = 2, level: int = 1):
        self.sink, self.width, self.packer = sink, width, zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.parts: list[bytes] = []
        self.size = self.n_docs = self.n_ids = 0
        self.seek: list[tuple[int, int, int]] = []
        self.directory: list[tuple[int, int | None, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.size and self.size + len(ids) > FRAME_BYTES:
            self._close_frame()
        self.directory.append((len(self.seek), doc_id, len(ids) // self.width))
        self.parts.append(ids)
        self.size += len(ids)
        self.n_docs += 1
        self.n_ids += len(ids) // self.width

    def _close_frame(self) -> None:
        raw = b"".join(self.parts)
        packed = self.packer.compress(raw)
        self.sink.write(packed)
        self.seek.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.parts, self.size = [], 0

    def finish(self) -> None:
        if self.parts:
            self._close_frame()
        frame, ids, counts = zip(*self.directory, strict=True) if self.directory else ((), (), ())
        table = [np.asarray(frame, "<u4").tobytes(), np.asarray([x is None for x in ids], "u1").tobytes(), np.asarray([x or 0 for x in ids], "<i8").tobytes(), np.asarray(counts, "<u4").tobytes()]
        packed = self.packer.compress(struct.pack("<IB", len(ids), self.width) + b"".join(table))
        self.sink.write(struct.pack("<II", DIRECTORY, len(packed)) + packed)
        rows = [*self.seek, (len(packed) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)]
        body = b"".join(struct.pack("<III", *x) for x in rows) + struct.pack("<IBI", len(rows), CHECKSUMS, SEEK_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(body)) + body)


class ShardReader:
    """Opens a shard by its seek table; ``read`` decompresses and checks one frame, ``select`` those of given documents."""

    def __init__(self, source):
        self.source, size = source, source.size()
        rows, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or not flags & CHECKSUMS:
            raise ValueError("no seek table with checksums")
        body = self._at(size - 9 - 12 * rows, 12 * rows)
        self.frames = [struct.unpack_from("<III", body, 12 * k) for k in range(rows)]
        self.offsets = np.cumsum([0, *(f[0] for f in self.frames)])
        where = int(self.offsets[rows - 1])
        magic, length = struct.unpack("<II", self._at(where, 8))
        if magic != DIRECTORY or where + 8 + length + 8 + 12 * rows + 9 != size:
            raise ValueError("no document directory")
        raw = zstandard.ZstdDecompressor().decompress(self._at(where + 8, length))
        n, self.width = struct.unpack_from("<IB", raw)
        at = 5
        self.frame = np.frombuffer(raw, "<u4", n, at)
        null = np.frombuffer(raw, "u1", n, at + 4 * n)
        ids = np.frombuffer(raw, "<i8", n, at + 5 * n)
        self.counts = np.frombuffer(raw, "<u4", n, at + 13 * n).astype(np.int64)
        self.doc_ids = [None if z else int(x) for x, z in zip(ids, null, strict=True)]
        self.n_frames = rows - 1

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(int(offset))
        return self.source.read(int(size))

    def read(self, k: int) -> bytes:
        packed, size, check = self.frames[k]
        raw = zstandard.ZstdDecompressor().decompress(self._at(self.offsets[k], packed), max_output_size=size)
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def documents(self, frames: list[int] | None = None) -> Iterator[tuple[int, int | None, bytes]]:
        """(place in the shard, doc_id, ids) of every document of the given frames."""
        first = np.searchsorted(self.frame, np.arange(self.n_frames + 1))
        for k in range(self.n_frames) if frames is None else frames:
            raw, at = self.read(k), 0
            for place in range(first[k], first[k + 1]):
                size = int(self.counts[place]) * self.width
                yield place, self.doc_ids[place], raw[at : at + size]
                at += size

    def select(self, doc_ids: set[int]) -> dict[int, bytes]:
        """The ids of the wanted documents, from their frames only."""
        frames = sorted({int(f) for f, d in zip(self.frame, self.doc_ids, strict=True) if d in doc_ids})
        return {d: ids for _, d, ids in self.documents(frames) if d in doc_ids}


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int, spaced: bool, shard_text: int = SHARD_TEXT) -> DataFrame:
    """Encode all ``docs`` (doc_id, text; null text: empty) and write them to shards under ``path``; the manifest is returned.

    The rows are dealt by ranges of (doc_id, hash of the text), so a shard holds neighbouring ids, rows of one id may fill
    many shards, and no shard depends on another. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long"), F.col("text"), F.xxhash64("text").alias("salt"), F.spark_partition_id().alias("part"))
    size = docs.select(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    n = max(spark.sparkContext.defaultParallelism, -(-size // shard_text)) if size > 1 << 20 else 1
    dealt = keyed.repartitionByRange(int(n), F.col("doc_id").asc_nulls_first(), "salt", "part").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "salt")
    end = np.asarray([end_id], "<u2").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, base = open_store(path)
        store.create_dir(base, recursive=True)
        shard = task.partitionId()
        name = f"{base}/ids-{shard:06d}-{task.taskAttemptId()}.zst"
        enc, rows = tokenizer(vocabulary, spaced), None
        with store.open_output_stream(name, compression=None) as sink:
            rows = ShardWriter(sink)
            for batch in batches:
                for part in slices(batch, "text", 1 << 20):
                    ids = part.column("doc_id").to_pylist()
                    for doc_id, tokens in zip(ids, enc.encode(part.column("text").to_pylist()), strict=True):
                        rows.add(doc_id, tokens + end)
            rows.finish()
        scheme = path.split(":", 1)[0] + "://" if ":" in path else ""
        yield pa.RecordBatch.from_pylist([{"shard": shard, "path": scheme + name, "n_docs": rows.n_docs, "n_ids": rows.n_ids}], pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    manifest = dealt.select("doc_id", "text").mapInArrow(lean(write), MANIFEST).collect()  # a line for each shard
    return spark.createDataFrame(sorted(manifest, key=lambda r: r.shard), MANIFEST)


def read_token_files(manifest: DataFrame, frames_at_once: int = 1) -> DataFrame:
    """Every document of the shards in a manifest: doc_id, start (ids of all documents before it), n_tokens, ids (unsigned 32-bit)."""
    spark = manifest.sparkSession
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as shards
    shards = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))
    shards = shards.repartition(max(1, min(manifest.count(), 4096)), "shard").select("path", "before")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, name = open_store(path)
                with store.open_input_file(name) as source:
                    reader = ShardReader(source)
                    starts = before + np.concatenate([[0], np.cumsum(reader.counts)])
                    for k in range(reader.n_frames):
                        rows = list(reader.documents([k]))
                        ids = [np.frombuffer(r[2], f"<u{reader.width}").astype("<u4").tobytes() for r in rows]
                        yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), pa.array([int(starts[r[0]]) for r in rows], pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], schema=schema)

    return shards.mapInArrow(lean(read), "doc_id long, start long, n_tokens long, ids binary")


def token_file_digest(spark: SparkSession, docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write all documents, read the files back, and return doc_id, start, n_tokens, ids_crc32."""
    manifest = write_token_files(docs, scratch_path(spark, "token-files"), vocabulary, end_id=1, spaced=False)
    read = read_token_files(manifest)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
