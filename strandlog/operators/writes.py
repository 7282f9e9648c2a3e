"""What writing means, as transformations: dense numbers, batches behind a head, deletions, expected revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandlog.operators import filters
from strandlog.schema import STREAM_KEYS, Stream

#: Values of the order column that one window task numbers.
SPAN = 1 << 20


def _is(stream: Stream) -> Column:
    return filters.in_stream(dict(zip(STREAM_KEYS, stream.key, strict=True)))


def without_stream(log: DataFrame, stream: Stream) -> DataFrame:
    """The log without a stream; links to its events are left dangling."""
    return log.where(~_is(stream))


def without_event(log: DataFrame, stream: Stream, revision: int) -> DataFrame:
    """The log without one event; the stream's later revisions move down by one."""
    own = _is(stream)
    moved = F.when(own & (F.col("stream_revision") > revision), F.col("stream_revision") - 1).otherwise(F.col("stream_revision"))
    return log.where(~(own & (F.col("stream_revision") == revision))).withColumn("stream_revision", moved.cast("int"))


def dense_numbers(df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """``df`` with ``name``: 1, 2, 3 ... by ``order`` (unique whole numbers) in each group of ``keys`` (may be none).

    Numbered in spans of the order column and put together by sums of the spans' counts, so no group needs one task.
    """
    cut = df.withColumn("_span", F.floor(F.col(order) / SPAN))
    inside = cut.withColumn("_row", F.row_number().over(Window.partitionBy(*keys, "_span").orderBy(order)))
    sizes = cut.groupBy(*keys, "_span").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("_before > 0").drop("_n")
    out = inside.join(offsets, [*keys, "_span"], "left")
    return out.withColumn(name, F.col("_row") + F.coalesce("_before", F.lit(0))).drop("_span", "_row", "_before")


def numbered_batch(batch: DataFrame, order: str, heads: DataFrame, last_position: int) -> DataFrame:
    """A batch for many streams with what a store assigns: positions behind the log's last, revisions behind each head."""
    rows = dense_numbers(dense_numbers(batch, [], order, "_n"), list(STREAM_KEYS), order, "_k")
    rows = rows.join(heads.withColumnRenamed("stream_revision", "_head"), list(STREAM_KEYS), "left")
    own = [c for c in batch.columns if c not in STREAM_KEYS]
    return rows.select((F.lit(last_position) + F.col("_n")).cast("long").alias("global_position"), *STREAM_KEYS, (F.coalesce("_head", F.lit(-1)) + F.col("_k")).cast("int").alias("stream_revision"), *own)


def check_expected(wanted: DataFrame, heads: DataFrame) -> DataFrame:
    """(stream keys, outcome) for streams with an ``expected`` revision: ok, or conflict if the head is another.

    ``expected`` is a number, or one of ``any``, ``no_stream`` and ``stream_exists``.
    """
    joined = wanted.join(heads, list(STREAM_KEYS), "left").withColumn("expected", F.col("expected").cast("string"))
    head, expected = F.col("stream_revision"), F.col("expected")
    ok = F.when(expected == "any", True).when(expected == "no_stream", head.isNull()).when(expected == "stream_exists", head.isNotNull())
    ok = ok.otherwise(expected == F.coalesce(head, F.lit(-1)).cast("string"))
    return joined.select(*STREAM_KEYS, F.when(ok, "ok").otherwise("conflict").alias("outcome"))


def safe_position(commits: DataFrame) -> DataFrame:
    """The position up to which nothing can be missing: the greatest of the commits before the first open one, else 0."""
    first_open = commits.where("is_open").agg(F.min("version").alias("first_open"))
    done = commits.crossJoin(F.broadcast(first_open)).where("first_open is null or version < first_open")  # one row
    return done.agg(F.coalesce(F.max("max_position"), F.lit(0)).cast("long").alias("safe_position"))


def moving_average(df: DataFrame, keys: list[str], order: str, value: str, rows: int = 100) -> DataFrame:
    """``df`` with ``average``: the mean of ``value`` over the last ``rows`` rows of each group."""
    last = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - rows, 0)
    return df.withColumn("average", F.avg(F.col(value).cast("double")).over(last))
