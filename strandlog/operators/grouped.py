"""Grouped reads: the first or last event of each group, as one aggregation with partial results before the shuffle."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, functions as F

from strandlog.errors import StreamNotFoundError
from strandlog.operators import filters
from strandlog.operators.links import resolve_links
from strandlog.operators.reads import select_log, select_stream, source_of, stream_exists
from strandlog.schema import Stream, is_descending


def first_of_each(df: DataFrame, keys: list[str], order: str, direction: Any) -> DataFrame:
    """The row with the least (backwards: greatest) ``order`` of each group; map tasks send one row a group."""
    pick = F.max_by if is_descending(direction) else F.min_by
    best = df.groupBy(*keys).agg(pick(F.struct(*df.columns), F.col(order)).alias("row"))
    return best.select("row.*")


def read_grouped(log: DataFrame, stream: Stream, options: Mapping[str, Any] | None = None, check: bool = True) -> DataFrame:
    """One event per type of a stream (by revision), or per (context, stream_name, type) of the log (by position).

    Where a stream filter names a stream_id, the groups of that (context, stream_name) are of the named streams, each
    stream a group of its own, even beside a wider filter. max_count has no effect; no row is given twice.
    """
    options = options or {}
    source, single = source_of(log, stream)
    if single:
        if check and not stream_exists(log, stream):
            raise StreamNotFoundError(stream)
        out = first_of_each(select_stream(source, stream, options), ["type"], "stream_revision", options.get("direction"))
    else:
        rows = select_log(source, options)
        exact = [f for f in filters.stream_filters(options) if "stream_id" in f]
        keys = ["context", "stream_name", "type"]
        if exact:
            pairs = {(f["context"], f["stream_name"]) for f in exact}
            of_pair = reduce(lambda a, b: a | b, [(F.col("context") == c) & (F.col("stream_name") == n) for c, n in sorted(pairs)])
            named = filters.any_of(filters.in_stream(f) for f in exact)
            rows = rows.where(~of_pair | named).withColumn("_id", F.when(of_pair, F.col("stream_id")))
            keys = [*keys, "_id"]
        out = first_of_each(rows, keys, "global_position", options.get("direction")).drop("_id")
    return resolve_links(out, log) if options.get("resolve_link_tos") else out
