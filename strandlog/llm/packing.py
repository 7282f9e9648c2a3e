"""Packing token streams into windows by Karmarkar-Karp multiway differencing.

Documents are tokenised where they lie and cut: pieces of exactly the capacity are windows of their own; what is left of
each document (cut once more into pieces of a quarter of the capacity, so that they combine finely) goes to the block of its task. A block of a bounded
number of pieces is partitioned into k = ceil(tokens / capacity) windows by differencing: every piece starts as a
partition with one filled window; the two partitions with the largest imbalance are merged, the fullest window of one with
the emptiest of the other, until one is left. If its fullest window exceeds the capacity, k rises and the block is
partitioned again. No data moves between tasks. A window's name is made of the task's partition, block and place,
so a repeated task gives the same names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from strandlog.llm.common import lean, slices
from strandlog.llm.tokens import tokenizer

CAPACITY = 1024
#: Pieces that are partitioned at once.
BLOCK = 768

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


def differencing(sizes: list[int], k: int) -> np.ndarray:
    """The window (0 to k-1) of each piece, by Karmarkar-Karp's largest differencing method for k parts.

    A partition is kept as its window sums above the lowest, sorted, and the pieces of each window as linked lists.
    """
    heap: list[tuple[int, int, list[int], list[list[int]]]] = []
    for i, size in enumerate(sizes):
        # only filled windows are held: sums ascending, one list of pieces for each; the other k - len are empty
        heap.append((-size, i, [size], [[i]]))
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, a, parts_a = heapq.heappop(heap)
        _, _, b, parts_b = heapq.heappop(heap)
        free = k - len(a)  # empty windows of a
        sums, parts = [], []
        # fullest of b with the emptiest of a: first a's empty windows, then its lowest sums
        nb = len(b)
        for j in range(nb):  # b from the fullest down
            s, p = b[nb - 1 - j], parts_b[nb - 1 - j]
            if j < free:
                sums.append(s)
                parts.append(p)
            else:
                sums.append(s + a[j - free])
                parts.append(p + parts_a[j - free])
        used = max(0, nb - free)
        sums += a[used:]
        parts += parts_a[used:]
        order = sorted(range(len(sums)), key=sums.__getitem__)
        sums, parts = [sums[x] for x in order], [parts[x] for x in order]
        if len(sums) == k and sums[0]:
            low = sums[0]
            sums = [s - low for s in sums]
        heapq.heappush(heap, (-(sums[-1] - (sums[0] if len(sums) == k else 0)), tie, sums, parts))
        tie += 1
    out = np.zeros(len(sizes), np.int64)
    if heap:
        for w, members in enumerate(heap[0][3]):
            out[members] = w
    return out


def pack_block(sizes: list[int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """The window of each piece and the number of windows; none holds more than the capacity."""
    if not sizes:
        return np.zeros(0, np.int64), 0
    k = -(-sum(sizes) // capacity)
    while True:
        where = differencing(sizes, k)
        if np.bincount(where, sizes, k).max() <= capacity:
            return where, k
        k += 1 + k // 256


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens: whole windows, then quarters of one."""
    whole = [(s, capacity) for s in range(0, n - capacity + 1, capacity)]
    step = max(1, capacity // 4)
    return whole + [(s, min(step, n - s)) for s in range(len(whole) * capacity, n, step)]


def pack(docs: DataFrame, vocabulary: str, end_id: int, spaced: bool = True, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text; null text: empty) with their windows: the columns of PIECES.

    Every id of every document, with its end id, is in exactly one piece (``ids``: little-endian unsigned 32-bit integers);
    the pieces of a window fill it from offset 0 without gaps. Defined results: a null or empty text is one piece of the end
    id; repeated rows are packed as often as they stand there, and which of them lies in which window follows the order of
    the input's partitions; ties in size go by that order too; an empty table has no pieces; other columns are ignored.
    """
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, base, serial = tokenizer(vocabulary, spaced), TaskContext.get().partitionId() << 40, 0
        waiting: list[tuple] = []
        out: list[tuple] = []

        def flush() -> None:
            nonlocal serial
            where, k = pack_block([p[2] for p in waiting], capacity)
            filled = [0] * k
            for p, w in zip(waiting, where.tolist(), strict=True):
                out.append((*p[:4], base + serial + w, filled[w], p[4]))
                filled[w] += p[2]
            serial += k
            waiting.clear()

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)

        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                for doc_id, short in zip(part.column("doc_id").to_pylist(), enc.encode(part.column("text").to_pylist()), strict=True):
                    ids = np.frombuffer(short, "<u2").astype("<u4").tobytes() + end
                    n = len(ids) // 4
                    for start, length in cuts(n, capacity):
                        row = (doc_id, start, length, n, ids[4 * start : 4 * (start + length)])
                        if length == capacity:
                            out.append((*row[:4], base + serial, 0, row[4]))
                            serial += 1
                        else:
                            waiting.append(row)
                            if len(waiting) >= block:
                                flush()
                if out:
                    yield batch_of(out)
                    out.clear()
        flush()
        if out:
            yield batch_of(out)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), PIECES)



def with_checksums(rows: DataFrame) -> DataFrame:
    """``rows`` with the crc32 of the column ids in its place, as ids_crc32."""
    return rows.select(*[c for c in rows.columns if c != "ids"], F.crc32("ids").alias("ids_crc32"))
