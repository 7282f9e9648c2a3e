"""Typed access to the JSON payload of events, by type: a registry of schemas, and parsing into the variant type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def as_variant(text: Column) -> Column:
    """JSON text as a variant; text that is not JSON gives null."""
    return F.try_parse_json(text)


def get(text: Column, path: str, kind: str) -> Column:
    """The value at a path such as $.a.b of JSON text, null if it isn't there or of another type."""
    return F.try_variant_get(F.try_parse_json(text), path, kind)


class PayloadTypes:
    """Payload schemas by event type; a type that is not registered keeps its text only."""

    def __init__(self) -> None:
        self.schemas: dict[str, T.StructType] = {}
        self.classes: dict[str, type] = {}

    def register_class(self, event_type: str, cls: type) -> PayloadTypes:
        """The Python class that handlers get for events of a type."""
        self.classes[event_type] = cls
        return self

    def build(self, event: dict, base: type = dict):
        """An event (as a dict) as its type's class, or as ``base`` where none is registered."""
        return self.classes.get(event["type"], base)(**event)

    def register(self, event_type: str, schema: T.StructType | str) -> PayloadTypes:
        self.schemas[event_type] = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        return self

    def events_of(self, log: DataFrame, event_type: str) -> DataFrame:
        """The events of one type with their payload parsed into the struct column ``payload``."""
        rows = log.where(F.col("type") == event_type)
        schema = self.schemas.get(event_type)
        return rows.withColumn("payload", F.from_json("data", schema) if schema else as_variant(F.col("data")))
