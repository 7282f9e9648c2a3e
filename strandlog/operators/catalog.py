"""The catalogue of contexts, stream names and event types, derived from the log by grouping sets."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from strandlog.functions.names import table_name
from strandlog.operators import filters

SCOPES = ("event_type", "stream_name", "context", "auto")


def partition_id(context: Column, stream_name: Column, event_type: Column) -> Column:
    """A level's id: a hash of its parts, so that it needs no counter and never changes."""
    return F.xxhash64(context, stream_name, event_type)


def partitions(log: DataFrame) -> DataFrame:
    """(id, context, stream_name, event_type, table_name): a row for each context, each name in it, each type in that.

    Distinct triples are taken first; the hierarchy is made of those few rows.
    """
    leaves = log.select("context", "stream_name", F.col("type").alias("event_type")).distinct()
    names = leaves.select("context", "stream_name", F.lit(None).cast("string").alias("event_type")).distinct()
    contexts = leaves.select("context", F.lit(None).cast("string").alias("stream_name"), F.lit(None).cast("string").alias("event_type")).distinct()
    rows = leaves.unionByName(names).unionByName(contexts)
    return rows.select(partition_id(F.col("context"), F.col("stream_name"), F.col("event_type")).alias("id"), "*", table_name(F.col("context"), F.col("stream_name"), F.col("event_type")).alias("table_name"))


def at_level(catalog: DataFrame, level: str) -> DataFrame:
    """The rows of one level: context, stream_name or event_type."""
    name, kind = F.col("stream_name"), F.col("event_type")
    where: dict[str, Column] = {"event_type": kind.isNotNull(), "stream_name": name.isNotNull() & kind.isNull(), "context": name.isNull() & kind.isNull()}
    return catalog.where(where[level])


def find_partitions(catalog: DataFrame, options: Mapping[str, Any] | None = None, scope: str = "event_type") -> DataFrame:
    """Catalogue rows of a scope that belong to what the filters match.

    Stream filters count by context and name (a stream_id in them is dropped); invalid ones are ignored.
    ``auto``: event_type if there are type filters, else stream_name if a filter names one, else context.
    """
    if scope not in SCOPES:
        raise ValueError(f"scope {scope!r}: one of {', '.join(SCOPES)}")
    streams = [{k: v for k, v in f.items() if k != "stream_id"} for f in filters.stream_filters(options)]
    types = filters.event_types(options)
    if scope == "auto":
        scope = "event_type" if types else "stream_name" if any("stream_name" in f for f in streams) else "context"
    where = filters.all_of([filters.any_of(filters.in_stream(f) for f in streams), F.col("event_type").isin(types) if types else None])
    leaves = at_level(catalog, "event_type").where(where)
    if scope == "event_type":
        return leaves
    keys = ["context", "stream_name"] if scope == "stream_name" else ["context"]
    return at_level(catalog, scope).join(leaves.select(*keys).distinct(), keys, "left_semi")


def lookup(catalog: DataFrame, context: str, stream_name: str | None = None, event_type: str | None = None) -> DataFrame:
    """The one catalogue row of a context, a name in it, or a type in that."""
    return catalog.where(F.col("context").eqNullSafe(F.lit(context)) & F.col("stream_name").eqNullSafe(F.lit(stream_name)) & F.col("event_type").eqNullSafe(F.lit(event_type)))


def find_by_ids(catalog: DataFrame, ids: list[int]) -> DataFrame:
    return catalog.where(F.col("id").isin(ids)) if ids else catalog.limit(0)


def name_taken(catalog: DataFrame, name: str) -> bool:
    return not catalog.where(F.col("table_name") == name).limit(1).isEmpty()
