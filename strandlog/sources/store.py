"""A store for event logs: Parquet by context, stream name and type, and a log of commits.

Layout below the store's path: ``data/commit=N-U/p_context=../p_name=../p_type=../*.parquet`` and ``_commits/N.json``. A
commit's files are written first; they count from the moment its record exists, and a record is made once: of two writers of
the same version one loses and runs its block again, so commits are serial, in position order, and everything up to the
last commit is safe to read. Deletions are tombstones in commit records, applied when the log is read, until ``compact``
writes the live log anew. The key columns are read from the folders (with a prefix, so that '' survives), so filters on
them prune folders.

Work on events (numbering, presence of linked events, deletion, compaction) is Spark's; the driver handles commit records,
whose size doesn't grow with the events.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from strandlog.config import Config
from strandlog.errors import CommitConflictError, NotPersistedEventError, ReadOnlyTransactionError, SystemStreamError, TooManyRecordsToLockError, WrongExpectedRevisionError
from strandlog.functions.names import encoded
from strandlog.operators import catalog, grouped, paging, reads, writes
from strandlog.schema import EVENT, LINK_TYPE, NO_STREAM_REVISION, STREAM_KEYS, Event, Stream
from strandlog.scratch import scratch_path
from strandlog.sources.files import Files

_FOLDERS = ("p_context", "p_name", "p_type")
_STORED = T.StructType([*EVENT.fields, *(T.StructField(c, T.StringType()) for c in _FOLDERS), T.StructField("commit", T.StringType())])
#: Events that a deletion may renumber without force.
RENUMBERED = 1000
ANY, NO_STREAM, STREAM_EXISTS = "any", "no_stream", "stream_exists"


@dataclass
class _State:
    """The store after a commit: its last position, live data commits, tombstones in order (and all there ever were), known heads."""

    version: int = 0
    last_position: int = 0
    commits: list[str] = field(default_factory=list)  # folders of live data
    tombstones: list[dict[str, Any]] = field(default_factory=list)
    heads: dict[tuple[str, str, str], int] = field(default_factory=dict)
    erased: list[dict[str, Any]] = field(default_factory=list)

    def after(self, record: Mapping[str, Any]) -> _State:
        out = _State(record["version"], record["last_position"], list(self.commits), list(self.tombstones), dict(self.heads), self.erased + record["tombstones"])
        if record["kind"] == "snapshot":
            out.commits, out.tombstones = [], []
        if record["folder"]:
            out.commits.append(record["folder"])
        out.tombstones += record["tombstones"]
        for t in record["tombstones"]:
            out.heads.pop(tuple(t["stream"]), None)
        if record["heads"] is None:
            out.heads = {}
        else:
            out.heads.update({tuple(k): v for *k, v in record["heads"]})
        return out


class LogStore:
    """Reads and writes one event log under ``path``."""

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None, middlewares: Sequence[tuple[str, Any]] = ()):
        self.spark, self.path = spark, path.rstrip("/")
        self.config = config or Config(path=path)
        self.middlewares = [*self.config.middlewares, *middlewares]
        self.files = Files(self.path)
        self._state = _State()

    # ---- commits

    def state(self) -> _State:
        """The state after the last commit; only records that are new since the last call are read."""
        while (raw := self.files.read(self._record_path(self._state.version + 1))) is not None:
            self._state = self._state.after(json.loads(raw))
        return self._state

    @staticmethod
    def _record_path(version: int) -> str:
        return f"_commits/{version:012d}.json"

    def _commit(self, base: _State, rows: DataFrame | None, tombstones: list[dict[str, Any]], heads: list | None, last_position: int, kind: str = "append") -> int:
        """Write data and record of the version after ``base``; CommitConflictError if another writer was first."""
        version = base.version + 1
        folder = ""
        if rows is not None:
            parts = rows.withColumns({"p_context": encoded(F.col("context")), "p_name": encoded(F.col("stream_name")), "p_type": encoded(F.col("type"))})
            folder = f"commit={version}-{uuid.uuid4().hex}"
            parts.write.partitionBy(*_FOLDERS).parquet(f"{self.path}/data/{folder}")
        record = {"version": version, "kind": kind, "folder": folder, "last_position": last_position, "tombstones": tombstones, "heads": heads, "at": time.time()}
        if not self.files.create(self._record_path(version), json.dumps(record)):
            raise CommitConflictError(f"version {version} was taken")
        return version

    def records(self, after: int = 0, until: int | None = None) -> list[dict[str, Any]]:
        """Commit records of versions in (after, until]."""
        last = self.state().version if until is None else until
        return [json.loads(self.files.read(self._record_path(v))) for v in range(after + 1, last + 1)]

    # ---- reading

    def _data(self, folders: Iterable[str]) -> DataFrame:
        """The events of these commits as they were written: one scan of all their folders."""
        paths = [f"{self.path}/data/{x}" for x in folders]
        if not paths:
            return self.spark.createDataFrame([], EVENT)
        raw = self.spark.read.schema(_STORED).option("basePath", f"{self.path}/data").parquet(*paths)
        value = lambda c: F.substring(F.col(c), 2, 1 << 30)
        columns = {"context": value("p_context"), "stream_name": value("p_name"), "type": value("p_type")}
        return raw.select(*[columns.get(f.name, F.col(f.name)).alias(f.name) for f in EVENT.fields])

    def _named(self, middlewares: Sequence[str] | None) -> list[Any]:
        """The middlewares of these names in the order of the configuration; all of them for None."""
        return [m for name, m in self.middlewares if middlewares is None or name in middlewares]

    def deserialized(self, rows: DataFrame, middlewares: Sequence[str] | None = None) -> DataFrame:
        for m in self._named(middlewares):
            rows = m.deserialize(rows)
        return rows

    def serialized(self, rows: DataFrame, middlewares: Sequence[str] | None = None) -> DataFrame:
        for m in self._named(middlewares):
            rows = m.serialize(rows)
        return rows

    def stored(self) -> DataFrame:
        """All live events as they were written."""
        state = self.state()
        return self._live(self._data(state.commits), state.tombstones)

    def still_live(self, rows: DataFrame) -> DataFrame:
        """``rows`` of any commits as they were written, without what has been deleted since; the log is not read."""
        return self._live(rows, self.state().erased)

    def log(self, middlewares: Sequence[str] | None = None) -> DataFrame:
        """All live events, with the middlewares' deserialize applied in order (``middlewares``: only the named ones)."""
        return self.deserialized(self.stored(), middlewares)

    def _live(self, df: DataFrame, tombstones: list[dict[str, Any]]) -> DataFrame:
        """Apply tombstones: a deleted stream's events up to its position go, later revisions of a deleted event move down."""
        if not tombstones:
            return df
        schema = "context string, stream_name string, stream_id string, version long, bound long, revision int"
        marks = self.spark.createDataFrame([(*t["stream"], i, t["bound"], t["revision"]) for i, t in enumerate(tombstones)], schema)
        per = marks.groupBy(*STREAM_KEYS).agg(F.array_sort(F.collect_list(F.struct("version", "bound", "revision"))).alias("_marks"))
        joined = df.join(per, list(STREAM_KEYS), "left")
        gone = F.lit(-1)

        def step(revision, mark):
            applies = (F.col("global_position") <= mark["bound"]) & (revision >= 0)
            hit = mark["revision"].isNull() | (mark["revision"] == revision)
            return F.when(applies & hit, gone).when(applies & (revision > mark["revision"]), revision - 1).otherwise(revision)

        revision = F.aggregate(F.coalesce("_marks", F.array().cast("array<struct<version:bigint,bound:bigint,revision:int>>")), F.col("stream_revision"), step)
        return joined.withColumn("stream_revision", revision.cast("int")).where("stream_revision >= 0").select(*df.columns)

    def read(self, stream: Stream, options: Mapping[str, Any] | None = None, middlewares: Sequence[str] | None = None, check: bool = True) -> DataFrame:
        """Events of a stream; middlewares see the rows that are returned, not the links that resolved events came by."""
        return self.deserialized(reads.read(self.stored(), stream, self._defaults(options), check), middlewares)

    def _defaults(self, options: Mapping[str, Any] | None) -> dict[str, Any]:
        return {"max_count": self.config.max_count, **{k: v for k, v in (options or {}).items() if not (k == "max_count" and v is None)}}

    def read_paginated(self, stream: Stream, options: Mapping[str, Any] | None = None, middlewares: Sequence[str] | None = None):
        return (self.deserialized(page, middlewares) for page in paging.paginated(self.stored(), stream, self._defaults(options)))

    def read_grouped(self, stream: Stream, options: Mapping[str, Any] | None = None, middlewares: Sequence[str] | None = None) -> DataFrame:
        return self.deserialized(grouped.read_grouped(self.stored(), stream, options), middlewares)

    def partitions(self) -> DataFrame:
        return catalog.partitions(self.log([]))

    def stream_revision(self, stream: Stream) -> int:
        return self._head(self.state(), stream)

    def safe_position(self) -> int:
        """Commits are serial and ordered, so whatever is committed is safe."""
        return self.state().last_position

    def _head(self, state: _State, stream: Stream) -> int:
        if stream.key not in state.heads:
            state.heads[stream.key] = reads.stream_revision(self._live(self._data(state.commits), state.tombstones), stream)
        return state.heads[stream.key]

    # ---- writing

    def multiple(self, block: Callable[[Transaction], Any], read_only: bool = False) -> Any:
        """Run ``block`` with a transaction and commit what it wrote at once; run it again if another writer came first."""
        while True:
            tx = Transaction(self, self.state(), read_only)
            out = block(tx)
            try:
                tx.commit()
            except CommitConflictError:
                continue
            return out

    def append(self, stream: Stream, events: Event | Sequence[Event], expected_revision: Any = ANY, middlewares: Sequence[str] | None = None) -> Any:
        """Append one event or many, all or none; the stored rows are returned, one for one event."""
        return self.multiple(lambda tx: tx.append(stream, events, expected_revision, middlewares))

    def append_frame(self, batch: DataFrame, order: str, middlewares: Sequence[str] | None = None) -> int:
        """Append a large batch for many streams (key columns, type, data, metadata, id may be missing), numbered by Spark.

        ``order``: a column of distinct whole numbers. The batch is evaluated once, into a table in the shared folder.
        """
        for key in STREAM_KEYS:
            if key not in batch.columns:
                raise ValueError(f"{key} is missing")
        scratch = scratch_path(self.spark, "batch")
        batch.write.parquet(scratch)
        batch = self.spark.read.schema(batch.schema).parquet(scratch)
        size = batch.agg(F.count("*").alias("n"), F.count_distinct(order).alias("orders"), F.max(F.col("context").startswith("$")).alias("system")).first()
        if size.orders != size.n:
            raise ValueError(f"{order} is not a column of distinct numbers")
        if size.system:
            raise SystemStreamError(batch.where(F.col("context").startswith("$")).select(*STREAM_KEYS).first())
        now = F.lit(datetime.now(UTC).replace(tzinfo=None)).cast("timestamp_ntz")
        fill = {"id": F.expr("uuid()"), "data": F.lit("{}"), "metadata": F.lit("{}"), "link_global_position": F.lit(None).cast("long"), "link_partition_id": F.lit(None).cast("long"), "created_at": now}
        batch = batch.withColumns({k: v for k, v in fill.items() if k not in batch.columns})
        while True:
            state = self.state()
            heads = reads.stream_heads(self._live(self._data(state.commits), state.tombstones))
            rows = writes.numbered_batch(batch, order, heads, state.last_position)
            rows = self.serialized(rows.select(*[f.name for f in EVENT.fields]), middlewares)
            try:
                return self._commit(state, rows, [], None, state.last_position + size.n)
            except CommitConflictError:
                continue

    def link_to(self, stream: Stream, positions: Sequence[int], expected_revision: Any = ANY, middlewares: Sequence[str] = ()) -> Any:
        """Append links to stored events, given by their global positions; no middlewares unless they are named."""
        return self.multiple(lambda tx: tx.link_to(stream, positions, expected_revision, middlewares))

    def delete_stream(self, stream: Stream) -> bool:
        """Delete a stream's events; whether there were any."""
        return self.multiple(lambda tx: tx.delete_stream(stream))

    def delete_event(self, stream: Stream, revision: int, force: bool = False) -> bool:
        """Delete the event at a revision and renumber the later ones; whether there was one."""
        return self.multiple(lambda tx: tx.delete_event(stream, revision, force))

    def compact(self) -> int:
        """Write the live log anew as one commit, sorted by position inside its files; tombstones are gone then."""
        while True:
            state = self.state()
            rows = self._live(self._data(state.commits), state.tombstones)
            # by key folders, and inside them by ranges of positions: few files, none of one task only
            rows = rows.repartitionByRange("context", "stream_name", "type", "global_position").sortWithinPartitions("context", "stream_name", "type", "global_position")
            try:
                return self._commit(state, rows, [], None, state.last_position, "snapshot")
            except CommitConflictError:
                continue


class Transaction:
    """Writes that are committed together, and reads that see them."""

    def __init__(self, store: LogStore, state: _State, read_only: bool):
        self.store, self.state, self.read_only = store, state, read_only
        self.rows: list[dict[str, Any]] = []
        self.tombstones: list[dict[str, Any]] = []
        self.heads: dict[tuple[str, str, str], int] = {}
        self.position = state.last_position
        self.now = datetime.now(UTC).replace(tzinfo=None)
        self.frames: list[DataFrame] = []

    def _writable(self, stream: Stream) -> None:
        if self.read_only:
            raise ReadOnlyTransactionError("the block is read-only")
        if stream.is_system:
            raise SystemStreamError(stream)

    def stream_revision(self, stream: Stream) -> int:
        return self.heads.get(stream.key, None) if stream.key in self.heads else self.store._head(self.state, stream)

    def log(self) -> DataFrame:
        """The log as this block sees it: what was committed before, and its own writes."""
        rows = self.store._data(self.state.commits)
        if self.rows:
            rows = rows.unionByName(self.store.spark.createDataFrame(self._tuples(self.rows), EVENT))
        return self.store._live(rows, [*self.state.tombstones, *self.tombstones])

    def read(self, stream: Stream, options: Mapping[str, Any] | None = None) -> DataFrame:
        return reads.read(self.log(), stream, options)

    @staticmethod
    def _tuples(rows: list[dict[str, Any]]) -> list[tuple]:
        return [tuple(r[f.name] for f in EVENT.fields) for r in rows]

    def _check(self, stream: Stream, expected: Any) -> int:
        head = self.stream_revision(stream)
        wrong = {ANY: False, NO_STREAM: head != NO_STREAM_REVISION, STREAM_EXISTS: head == NO_STREAM_REVISION}.get(expected, head != expected)
        if wrong:
            raise WrongExpectedRevisionError(stream, expected, head)
        return head

    def _add(self, stream: Stream, items: list[dict[str, Any]], expected: Any) -> list[dict[str, Any]]:
        self._writable(stream)
        head = self._check(stream, expected)
        out = []
        for item in items:
            head, self.position = head + 1, self.position + 1
            out.append({"id": str(uuid.uuid4()), "link_global_position": None, "link_partition_id": None, "created_at": self.now, **dict(zip(STREAM_KEYS, stream.key, strict=True)), **item, "global_position": self.position, "stream_revision": head})
        self.rows += out
        self.heads[stream.key] = head
        return out

    def append(self, stream: Stream, events: Event | Sequence[Event], expected_revision: Any = ANY, middlewares: Sequence[str] | None = None) -> Any:
        many = not isinstance(events, Event)
        items = []
        for e in events if many else [events]:
            row = {"type": e.type, "data": json.dumps(e.data), "metadata": json.dumps(e.metadata)}
            items.append({**row, "id": e.id} if e.id else row)
        out = self._add(stream, items, expected_revision)
        for row in out:
            row["_middlewares"] = middlewares
        return [self._shown(r) for r in out] if many else self._shown(out[0])

    @staticmethod
    def _shown(row: dict[str, Any]) -> dict[str, Any]:
        return {f.name: row[f.name] for f in EVENT.fields}

    def link_to(self, stream: Stream, positions: Sequence[int], expected_revision: Any = ANY, middlewares: Sequence[str] = ()) -> Any:
        self._writable(stream)
        wanted = self.store.spark.createDataFrame([(p,) for p in positions], "global_position long")
        found = {r.global_position: r for r in self.log().join(F.broadcast(wanted), "global_position", "left_semi").select("global_position", catalog.partition_id(F.col("context"), F.col("stream_name"), F.col("type")).alias("pid")).collect()}
        absent = [p for p in positions if p not in found]
        if absent:
            raise NotPersistedEventError(f"there are no events at {absent}")
        items = [{"type": LINK_TYPE, "data": "{}", "metadata": "{}", "link_global_position": p, "link_partition_id": found[p].pid} for p in positions]
        out = self._add(stream, items, expected_revision)
        for row in out:
            row["_middlewares"] = middlewares
        return [self._shown(r) for r in out]

    def delete_stream(self, stream: Stream) -> bool:
        self._writable(stream)
        if self.stream_revision(stream) == NO_STREAM_REVISION:
            return False
        self.tombstones.append({"stream": list(stream.key), "bound": self.position, "revision": None})
        self.heads[stream.key] = NO_STREAM_REVISION
        return True

    def delete_event(self, stream: Stream, revision: int, force: bool = False) -> bool:
        self._writable(stream)
        head = self.stream_revision(stream)
        if not 0 <= revision <= head:
            return False
        if head - revision > RENUMBERED and not force:
            raise TooManyRecordsToLockError(stream, head - revision)
        self.tombstones.append({"stream": list(stream.key), "bound": self.position, "revision": revision})
        self.heads[stream.key] = head - 1
        return True

    def commit(self) -> None:
        if self.read_only or not (self.rows or self.tombstones):
            return
        rows = None
        alike: dict[tuple[str, ...] | None, list[dict[str, Any]]] = {}  # by the middlewares that their append named
        for row in self.rows:
            named = row.get("_middlewares")
            alike.setdefault(None if named is None else tuple(named), []).append(row)
        for named, own in alike.items():
            part = self.store.serialized(self.store.spark.createDataFrame(self._tuples(own), EVENT).coalesce(1), named)
            rows = part if rows is None else rows.unionByName(part)
        self.store._commit(self.state, rows, self.tombstones, [[*k, v] for k, v in self.heads.items()], self.position)
