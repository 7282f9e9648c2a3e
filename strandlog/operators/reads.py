"""Reads of the log: the whole log, one stream, a system view; each a pure DataFrame transformation."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from strandlog.errors import StreamNotFoundError
from strandlog.operators import filters
from strandlog.operators.links import resolve_links
from strandlog.schema import DEFAULT_COUNT, Stream, is_descending

#: System streams by name: a view of the log.
SYSTEM_VIEWS = {"$streams": lambda log: log.where(F.col("stream_revision") == 0)}


def ordered(df: DataFrame, column: str, direction: Any) -> DataFrame:
    return df.orderBy(F.col(column).desc() if is_descending(direction) else F.col(column).asc())


def _limited(df: DataFrame, options: Mapping[str, Any]) -> DataFrame:
    n = options.get("max_count")
    return df.limit(DEFAULT_COUNT if n is None else n)


def select_log(log: DataFrame, options: Mapping[str, Any]) -> DataFrame:
    """The log's events under stream filters, types and the position bound; a revision bound is ignored."""
    where = filters.all_of([filters.streams_predicate(options), filters.types_predicate(options), filters.bound("global_position", options.get("from_position"), options.get("direction"))])
    return log.where(where)


def select_stream(log: DataFrame, stream: Stream, options: Mapping[str, Any]) -> DataFrame:
    """One stream's events under types and the revision bound; stream filters and a position bound are ignored."""
    keys = dict(zip(("context", "stream_name", "stream_id"), stream.key, strict=True))
    where = filters.all_of([filters.in_stream(keys), filters.types_predicate(options), filters.bound("stream_revision", options.get("from_revision"), options.get("direction"))])
    return log.where(where)


def source_of(log: DataFrame, stream: Stream) -> tuple[DataFrame, bool]:
    """What a stream is read from, and whether it is one ordinary stream."""
    if stream.is_all:
        return log, False
    if stream.is_system:
        if stream.context not in SYSTEM_VIEWS:
            raise StreamNotFoundError(stream)
        return SYSTEM_VIEWS[stream.context](log), False
    return log, True


def exists(log: DataFrame, where: Column) -> bool:
    """Whether any row meets ``where``; reads no more than it must."""
    return not log.where(where).limit(1).isEmpty()


def stream_exists(log: DataFrame, stream: Stream) -> bool:
    return exists(select_stream(log, stream, {}), F.lit(True))


def read(log: DataFrame, stream: Stream, options: Mapping[str, Any] | None = None, check: bool = True) -> DataFrame:
    """Events of ``stream`` in order, at most ``max_count`` (1000).

    Options: max_count, direction, from_revision (one stream), from_position (log and system streams),
    filter={'streams': [...], 'event_types': [...]}, resolve_link_tos. A missing ordinary stream raises
    StreamNotFoundError, unless ``check`` is off; a type filter that matches nothing gives no rows.
    """
    options = options or {}
    source, single = source_of(log, stream)
    if single:
        if check and not stream_exists(log, stream):
            raise StreamNotFoundError(stream)
        column, rows = "stream_revision", select_stream(source, stream, options)
    else:
        column, rows = "global_position", select_log(source, options)
    page = _limited(ordered(rows, column, options.get("direction")), options)
    return resolve_links(page, log) if options.get("resolve_link_tos") else page


def subscription_read(log: DataFrame, options: Mapping[str, Any], runner_id: int, from_position: int, to_position: int) -> DataFrame:
    """A subscription's next chunk: always forwards, after ``from_position`` (exclusive), up to the safe position."""
    own = {k: options[k] for k in ("filter", "max_count") if k in options}
    rows = select_log(log, own).where((F.col("global_position") > from_position) & (F.col("global_position") <= to_position))
    return _limited(rows.orderBy("global_position"), own).withColumn("runner_id", F.lit(runner_id))


def subscription_feed(log: DataFrame, runners: list[dict[str, Any]], to_position: int) -> DataFrame:
    """One bag of rows for many subscriptions: each has its own filter, bound and limit, and its runner_id on the rows."""
    parts = [subscription_read(log, r.get("options", {}), r["runner_id"], r["from_position"], to_position) for r in runners]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stream_heads(log: DataFrame) -> DataFrame:
    """The highest revision of every stream."""
    return log.groupBy("context", "stream_name", "stream_id").agg(F.max("stream_revision").alias("stream_revision"))


def stream_revision(log: DataFrame, stream: Stream) -> int:
    """A stream's highest revision, -1 if there is none."""
    found = select_stream(log, stream, {}).agg(F.max("stream_revision")).first()[0]
    return -1 if found is None else found


def reload_event(log: DataFrame, event: Mapping[str, Any]) -> DataFrame:
    """The stored event with the key of ``event``, or no row."""
    keys = ("context", "stream_name", "type", "global_position")
    return log.where(filters.all_of(F.col(k) == F.lit(event[k]) for k in keys)).limit(1)


def present(positions: DataFrame, log: DataFrame) -> DataFrame:
    """Of ``positions`` (global_position), those that the log holds."""
    return positions.join(log.select("global_position"), "global_position", "left_semi")


def missing(positions: DataFrame, log: DataFrame) -> DataFrame:
    """Of ``positions`` (global_position), those that the log doesn't hold."""
    return positions.join(log.select("global_position"), "global_position", "left_anti")
