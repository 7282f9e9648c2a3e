"""Names and texts: catalogue table names, number formatting, storage encoding of path parts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def table_name(context: Column, stream_name: Column, event_type: Column) -> Column:
    """The catalogue's name of a level: its kind and the first six hex digits of the MD5 of its parts."""
    short = lambda *parts: F.substring(F.md5(F.concat_ws("-", *parts).cast("binary")), 1, 6)
    return (
        F.when(event_type.isNotNull(), F.concat(F.lit("event_types_"), short(context, stream_name, event_type)))
        .when(stream_name.isNotNull(), F.concat(F.lit("stream_names_"), short(context, stream_name)))
        .otherwise(F.concat(F.lit("contexts_"), short(context)))
    )


def thousands(number: Column) -> Column:
    """12345 as 12,345."""
    return F.format_number(number, 0)


def snake_case(text: Column) -> Column:
    """FooBar and fooBar as foo_bar."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, "([A-Z]+)([A-Z][a-z])", "$1_$2"), "([a-z\\d])([A-Z])", "$1_$2"))


def encoded(text: Column) -> Column:
    """A value for a partition folder: never empty, since an empty one reads back as null."""
    return F.concat(F.lit("v"), text)


def is_live(updated_at: Column, now: Column, interval_s: float) -> Column:
    """Whether a heartbeat that comes every ``interval_s`` seconds is recent (one second of grace)."""
    return updated_at > now - F.make_dt_interval(secs=F.lit(interval_s + 1.0))
