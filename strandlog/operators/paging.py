"""Keyset pagination, catalogue search and counts."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from strandlog.operators import catalog as cat
from strandlog.operators.reads import ordered, read, select_log, source_of
from strandlog.schema import DEFAULT_COUNT, Stream, is_descending

PER_PAGE = (10, 20, 50, 100, 1000)


def per_page(n: Any) -> int:
    """A page size that is allowed, 10 otherwise."""
    return int(n) if str(n).isdigit() and int(n) in PER_PAGE else PER_PAGE[0]


def _reversed(direction: Any) -> str:
    return "asc" if is_descending(direction) else "desc"


def paginated(log: DataFrame, stream: Stream, options: Mapping[str, Any] | None = None, check: bool = True) -> Iterator[DataFrame]:
    """Page after page of at most max_count events, each a DataFrame, until the stream or log is read.

    The cursor is always a row's own revision or position (the link's, where links are resolved).
    """
    options = dict(options or {})
    size = options.get("max_count") or DEFAULT_COUNT
    down = is_descending(options.get("direction"))
    _, single = source_of(log, stream)
    column, start = ("stream_revision", "from_revision") if single else ("global_position", "from_position")
    resolve = options.pop("resolve_link_tos", False)
    while True:
        page = read(log, stream, options, check=check)
        check = False
        edges = page.agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).first()
        if not edges.n:
            return
        if resolve:
            from strandlog.operators.links import resolve_links

            yield resolve_links(page, log)
        else:
            yield page
        after = edges.low - 1 if down else edges.high + 1
        if edges.n < size or after < (0 if single else 1):
            return
        options[start] = after


def events_page(log: DataFrame, stream: Stream, options: Mapping[str, Any]) -> DataFrame:
    """One page of the log or a system stream; newest first by default."""
    return read(log, stream, {"direction": "desc", "max_count": PER_PAGE[0], **options})


def next_page_id(log: DataFrame, stream: Stream, options: Mapping[str, Any]) -> DataFrame:
    """The position at which the page after this one starts: one row, or none if this is the last."""
    source, _ = source_of(log, stream)
    rows = ordered(select_log(source, options), "global_position", options.get("direction")).select("global_position")
    return rows.offset(options.get("max_count") or PER_PAGE[0]).limit(1)


def prev_page_id(log: DataFrame, stream: Stream, options: Mapping[str, Any]) -> DataFrame:
    """The position at which the page before this one starts: one row, or none if this is the first."""
    source, _ = source_of(log, stream)
    back = {**options, "direction": _reversed(options.get("direction"))}
    rows = ordered(select_log(source, back), "global_position", back["direction"]).select("global_position")
    before = rows.limit((options.get("max_count") or PER_PAGE[0]) + 1).offset(1)
    return ordered(before, "global_position", options.get("direction")).limit(1)


def total_count(log: DataFrame, stream: Stream, options: Mapping[str, Any]) -> DataFrame:
    """The exact number of events under the filters, as count_all."""
    source, _ = source_of(log, stream)
    return select_log(source, options).agg(F.count("*").alias("count_all"))


def estimated_count(log: DataFrame, stream: Stream, options: Mapping[str, Any], above: int = 10_000) -> tuple[int, bool]:
    """(count, exact): the first ``above`` rows are counted alone, and only then all of them; both counts are exact in Spark."""
    source, _ = source_of(log, stream)
    rows = select_log(source, options).select("global_position")
    n = rows.limit(above + 1).count()
    return (n if n <= above else rows.count()), True


def _search(rows: DataFrame, column: str, matches: Column, start: str | None, direction: Any, size: int) -> DataFrame:
    found = rows.where(matches).select(column).distinct()
    if start is not None:
        found = found.where(F.col(column) <= start if is_descending(direction) else F.col(column) >= start)
    return ordered(found, column, direction).limit(size)


def search_contexts(catalog: DataFrame, query: str = "", start: str | None = None, direction: Any = "asc", size: int = 10) -> DataFrame:
    """Contexts that contain ``query`` in any case (% and _ are wild), from ``start`` on."""
    return _search(cat.at_level(catalog, "context"), "context", F.col("context").ilike(f"%{query or ''}%"), start, direction, size)


def search_stream_names(catalog: DataFrame, context: str, query: str = "", start: str | None = None, direction: Any = "asc", size: int = 10) -> DataFrame:
    """A context's stream names that contain ``query`` in any case."""
    rows = cat.at_level(catalog, "stream_name").where(F.col("context") == context)
    return _search(rows, "stream_name", F.col("stream_name").ilike(f"%{query or ''}%"), start, direction, size)


def search_event_types(catalog: DataFrame, query: str = "", start: str | None = None, direction: Any = "asc", size: int = 10) -> DataFrame:
    """Event types of all streams that contain ``query`` in any case."""
    return _search(cat.at_level(catalog, "event_type"), "event_type", F.col("event_type").ilike(f"%{query or ''}%"), start, direction, size)


def search_stream_ids(log: DataFrame, context: str, stream_name: str, query: str = "", start: str | None = None, direction: Any = "asc", size: int = 10) -> DataFrame:
    """Stream ids of a (context, stream_name) that begin with ``query``, which is pushed to the scan."""
    heads = log.where((F.col("stream_revision") == 0) & (F.col("context") == context) & (F.col("stream_name") == stream_name))
    return _search(heads, "stream_id", F.col("stream_id").like(f"{query or ''}%"), start, direction, size)


def next_search_id(found: DataFrame, column: str, direction: Any, size: int = 10) -> DataFrame:
    """Where the next search page starts: ``found`` must hold one row more than the page."""
    return ordered(found, column, direction).offset(size).limit(1)
