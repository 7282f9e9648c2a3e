"""The event log's data model: one fixed envelope, streams as key triples, two orders."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

#: Columns of an event. ``data`` and ``metadata`` are JSON text at this boundary (see functions.payload for typed access).
EVENT = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("context", T.StringType(), False),
        T.StructField("stream_name", T.StringType(), False),
        T.StructField("stream_id", T.StringType(), False),
        T.StructField("type", T.StringType(), False),
        T.StructField("global_position", T.LongType(), False),
        T.StructField("stream_revision", T.IntegerType(), False),
        T.StructField("data", T.StringType(), False),
        T.StructField("metadata", T.StringType(), False),
        T.StructField("link_global_position", T.LongType(), True),
        T.StructField("link_partition_id", T.LongType(), True),
        T.StructField("created_at", T.TimestampNTZType(), False),
    ]
)

STREAM_KEYS = ("context", "stream_name", "stream_id")
LINK_TYPE = "$>"
SYSTEM_PREFIX = "$"
NO_STREAM_REVISION = -1
DEFAULT_COUNT = 1000
DESCENDING = ("desc", "Backwards")


@dataclass(frozen=True)
class Stream:
    """A stream's identity. ``Stream.all()`` is the whole log, ``Stream.system(name)`` a read-only view such as $streams."""

    context: str
    stream_name: str
    stream_id: str

    @classmethod
    def all(cls) -> Stream:
        return cls("$all", "", "")

    @classmethod
    def system(cls, name: str) -> Stream:
        return cls(name, "", "")

    @property
    def is_all(self) -> bool:
        return self == Stream.all()

    @property
    def is_system(self) -> bool:
        return self.context.startswith(SYSTEM_PREFIX)

    @property
    def key(self) -> tuple[str, str, str]:
        return (self.context, self.stream_name, self.stream_id)


@dataclass
class Event:
    """An event to append; what a store assigns (position, revision, time) is not given here."""

    type: str
    data: dict[str, Any] = field(default_factory=dict)
    metadata: dict[str, Any] = field(default_factory=dict)
    id: str | None = None

    @property
    def is_system(self) -> bool:
        return self.type.startswith(SYSTEM_PREFIX)


def is_descending(direction: Any) -> bool:
    """'desc' and 'Backwards' (any letter case for the first) read backwards; everything else reads forwards."""
    return isinstance(direction, str) and (direction in DESCENDING or direction.lower() == "desc")
