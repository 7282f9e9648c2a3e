"""Options of a read as column predicates: (any of the stream filters) and (type in ...) and bounds."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Mapping
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, functions as F

from strandlog.schema import STREAM_KEYS, is_descending

log = logging.getLogger(__name__)


def stream_filters(options: Mapping[str, Any] | None, keys: tuple[str, ...] = STREAM_KEYS) -> list[dict[str, str]]:
    """The valid stream filters of ``options['filter']['streams']``: {context}, {context, stream_name} or all three.

    Other shapes are ignored, and so is a value that isn't a list; if none is valid there is no stream filter.
    """
    given = ((options or {}).get("filter") or {}).get("streams")
    out = []
    for f in given if isinstance(given, (list, tuple)) else []:
        named = [k for k in keys if isinstance(f, Mapping) and isinstance(f.get(k), str)]
        if named and isinstance(f, Mapping) and set(f) <= set(STREAM_KEYS) and named == list(keys[: len(named)]) and len([k for k in f if k in keys]) == len(named):
            out.append({k: f[k] for k in named})
        else:
            log.debug("stream filter %r is ignored", f)
    return out


def event_types(options: Mapping[str, Any] | None) -> list[str]:
    """The strings of ``options['filter']['event_types']``; anything else is no filter."""
    given = ((options or {}).get("filter") or {}).get("event_types")
    return [t for t in given if isinstance(t, str)] if isinstance(given, (list, tuple)) else []


def any_of(predicates: Iterable[Column]) -> Column | None:
    parts = list(predicates)
    return reduce(or_, parts) if parts else None


def all_of(predicates: Iterable[Column | None]) -> Column:
    return reduce(and_, [p for p in predicates if p is not None], F.lit(True))


def in_stream(keys: Mapping[str, str]) -> Column:
    return all_of(F.col(k) == F.lit(v) for k, v in keys.items())


def streams_predicate(options: Mapping[str, Any] | None) -> Column | None:
    return any_of(in_stream(f) for f in stream_filters(options))


def types_predicate(options: Mapping[str, Any] | None) -> Column | None:
    types = event_types(options)
    return F.col("type").isin(types) if types else None


def bound(column: str, value: Any, direction: Any) -> Column | None:
    """Inclusive: from ``value`` on in the direction of reading."""
    if value is None:
        return None
    return F.col(column) <= value if is_descending(direction) else F.col(column) >= value
