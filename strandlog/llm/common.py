"""What the operators of this subpackage share: scratch tables, null-safe text columns, Arrow batches cut by bytes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strandlog.scratch import scratch_path


class Scratch:
    """Tables written to the shared folder to cut a plan; what only later steps of the same call read is dropped by hand."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete the files of a table that cut() returned."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for file in df.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(conf).delete(path, True)


#: Rows of a few numbers up to which a table is broadcast (about 50 MB as a hash table); beyond, both sides are shuffled.
BROADCAST_ROWS = 300_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``ids`` (doc_id; null is an id like others).

    The ids are written first, so that their number is known: a small table is broadcast and no text is moved.
    """
    known = Scratch(docs.sparkSession).cut(ids.select("doc_id").distinct(), "ids")
    side = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    return docs.alias("d").join(side.alias("i"), F.col("d.doc_id").eqNullSafe(F.col("i.doc_id")), "left_anti")


def row_key() -> Column:
    """What tells rows of a document table apart: rows of equal doc_id and text are one, all others have keys of their own."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text", F.col("doc_id").isNull(), F.col("text").isNull())


def by_row(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of ``docs`` with the row's key in the place of the doc_id."""
    return docs.select(row_key().alias("doc_id"), "text")


def without_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` without the rows whose row_key() is in ``keys`` (row); written first, as in without()."""
    known = Scratch(docs.sparkSession).cut(keys.select("row").distinct(), "rows")
    side = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    return docs.join(side.select(F.col("row").alias("row_without")), row_key() == F.col("row_without"), "left_anti")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n: the split of training and held-out rows."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(n)


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts have about ``most`` bytes; a longer text is a run of its own."""
    text = batch.column(column)
    if batch.num_rows == 0:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(text), 0).cast(pa.int64()))
    ends = np.cumsum(sizes)
    start, base = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(start, stop - start)
        start, base = stop, int(ends[stop - 1])


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, which gives freed memory back to the system at its end: Spark keeps its Python workers for later stages."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return task


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one that ``docs`` has no column of."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string array, and the offset of each text in them; a null is an empty text."""
    text = pc.fill_null(text.cast(pa.large_string()), "")
    if text.offset:
        text = pa.concat_arrays([text])
    if text.offset or len(text) == 0:
        text = pa.array(text.to_pylist(), pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[: len(text) + 1] if len(text) else np.zeros(1, np.int64)
    data = text.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[: offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    first = offsets[0] if len(offsets) else 0
    return raw[first:], offsets - first
