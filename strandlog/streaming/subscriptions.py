"""Subscriptions: durable consumers of a store, as Structured Streaming queries.

Each subscription is one streaming query over the store's commits. Its micro-batch is filtered, ordered by position,
cut behind the subscription's position, links resolved, and handed to the handler event by event or as one batch. The position is saved after
each event (or batch) is handled, so a crash repeats at most what was being handled: at least once, in order. Spark's own
checkpoint says which commits are done; a reset starts a new checkpoint generation with another start position.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from strandlog.errors import SubscriptionHandlerError
from strandlog.operators.links import cursor_position, resolve_links
from strandlog.operators.reads import select_log
from strandlog.sources.store import LogStore
from strandlog.streaming.commits import commit_stream
from strandlog.streaming.state import StateStore, SubscriptionState

FIRST_CHUNK, LEAST_CHUNK, MOST_CHUNK = 10, 10, 1000
TIMINGS = 100


def next_chunk_size(interval: float, average: float, backlog: int) -> int:
    """Events to fetch next: as many as fit in the interval at the average time each, less what still waits."""
    if average == 0:
        return FIRST_CHUNK
    wanted = min(round(interval / average), MOST_CHUNK) - backlog
    return 0 if wanted < 0 else max(wanted, LEAST_CHUNK)


class Timings:
    """The mean of the last 100 handler times."""

    def __init__(self, size: int = TIMINGS):
        self.last: deque[float] = deque(maxlen=size)

    def track(self, seconds: float) -> None:
        self.last.append(seconds)

    @property
    def average(self) -> float:
        return sum(self.last) / len(self.last) if self.last else 0.0


class Subscription:
    """One consumer. ``handler`` takes a row (dict), or with ``in_batches`` a DataFrame."""

    def __init__(self, store: LogStore, state: SubscriptionState, handler: Callable[[Any], None], in_batches: bool = False, on_change: Callable[[str, str], None] | None = None):
        self.store, self.handler, self.in_batches, self.on_change = store, handler, in_batches, on_change
        self.states, self.timings = StateStore(store.files), Timings()
        self.row, self.owner = state, ""
        self.query: StreamingQuery | None = None

    # ---- life cycle

    def _to(self, state: str) -> None:
        old, self.row.state = self.row.state, state
        if old != state:
            self._save()
            if self.on_change:
                self.on_change(old, state)

    def _save(self) -> None:
        self.row = self.states.save(self.row)

    def lock(self, owner: str, force: bool = False) -> Subscription:
        self.row, self.owner = self.states.lock(self.row, owner, force), owner
        return self

    def unlock(self) -> None:
        self.states.unlock(self.row)
        self.row.locked_by = None

    @property
    def checkpoint(self) -> str:
        name = f"{self.row.set}/{self.row.name}".encode().hex()
        return f"{self.store.path}/_checkpoints/{name}/{self.row.generation}"

    def start(self, available_now: bool = False) -> StreamingQuery:
        """Start the streaming query: to the end of the log, or every interval until stopped."""
        stream = commit_stream(self.store.spark, self.store.path)
        writer = stream.writeStream.foreachBatch(self._process).option("checkpointLocation", self.checkpoint)
        trigger = {"availableNow": True} if available_now else {"processingTime": f"{max(0.2, self.row.chunk_query_interval)} seconds"}
        self._to("running")
        self.query = writer.trigger(**trigger).start()
        return self.query

    def drain(self) -> int:
        """Process everything that is committed, with restarts after handler errors; the number of events handled."""
        before = self.row.total_processed_events
        while True:
            position = self.row.current_position
            query = self.start(available_now=True)
            try:
                query.awaitTermination()
            except Exception as error:  # the query's failure, whatever the handler raised
                if not self._recover(error):
                    raise
                continue
            # a restarted query ends behind the batch that it repeats; go on until nothing more comes
            if self.row.current_position == position:
                break
        self._to("stopped")
        return self.row.total_processed_events - before

    def _recover(self, error: BaseException) -> bool:
        self._to("dead")
        config = self.store.config
        if config.restart_terminator and config.restart_terminator(self.row):
            return False
        if self.row.restart_count >= self.row.max_restarts_number:
            if config.failed_notifier:
                config.failed_notifier(self.row, error)
            return False
        time.sleep(self.row.time_between_restarts)
        self.row.restart_count += 1
        self._save()
        return True

    def supervise(self, timeout: float | None = None) -> None:
        """Keep a started query running: restart it after errors as often as allowed; returns when it is stopped."""
        end = None if timeout is None else time.time() + timeout
        while self.query is not None and (end is None or time.time() < end):
            try:
                if self.query.awaitTermination(0.5):
                    return
            except Exception as error:
                if not self._recover(error):
                    raise
                self.start()

    def stop(self) -> None:
        if self.query is not None:
            self._to("halting")
            self.query.stop()
            self.query = None
        self._to("stopped")

    def restore(self) -> None:
        """Start a dead or stopped subscription again with a fresh count of restarts."""
        self.row.restart_count, self.row.last_error = 0, None
        self.start()

    def reset_position(self, position: int) -> None:
        """Begin again behind ``position`` (0: with the first event); only while stopped."""
        if self.query is not None and self.query.isActive:
            raise ValueError("stop the subscription first")
        self.row.current_position, self.row.total_processed_events = position or None, 0
        self.row.options = {**self.row.options, "from_position": position}
        self.row.generation += 1
        self._save()

    # ---- processing

    def rows(self, batch: DataFrame) -> DataFrame:
        """What the subscription sees of a batch of appended events: live, filtered, behind its position, in order."""
        start = self.row.current_position if self.row.current_position is not None else self.row.options.get("from_position", 0)
        wanted = select_log(batch, {"filter": self.row.options.get("filter")}).where(F.col("global_position") > (start or 0))
        out = self.store.still_live(wanted)
        if self.row.options.get("resolve_link_tos"):
            out = resolve_links(out, self.store.stored())
        return cursor_position(self.store.deserialized(out)).orderBy("cursor")

    def _process(self, batch: DataFrame, batch_id: int) -> None:
        rows = self.rows(batch)
        position = None
        try:
            if self.in_batches:
                stats = rows.agg(F.count("*").alias("n"), F.max("cursor").alias("last")).first()
                if stats.n:
                    position, began = stats.last, time.time()
                    self.handler(rows.drop("cursor"))
                    self._handled(stats.last, stats.n, time.time() - began)
            else:
                for row in rows.toLocalIterator():
                    position, began = row.cursor, time.time()
                    event = row.asDict(recursive=True)
                    del event["cursor"]
                    self.handler(event)
                    self._handled(row.cursor, 1, time.time() - began)
        except Exception as cause:
            self.row.last_error, self.row.last_error_at = repr(cause), time.time()
            self._save()
            raise SubscriptionHandlerError(position, cause) from cause

    def _handled(self, position: int, n: int, seconds: float) -> None:
        for _ in range(min(n, TIMINGS)):
            self.timings.track(seconds / n)
        self.row.current_position = position
        self.row.total_processed_events += n
        self.row.average_event_processing_time = self.timings.average
        self._save()


class SubscriptionManager:
    """A set of subscriptions of one process, under one lease."""

    def __init__(self, store: LogStore, set_name: str, force_lock: bool = False):
        self.store, self.set_name, self.force_lock = store, set_name, force_lock
        self.states = StateStore(store.files)
        self.subscriptions: dict[str, Subscription] = {}
        self.owner: str | None = None

    def subscribe(self, name: str, handler: Callable[[Any], None], options: Mapping[str, Any] | None = None, in_batches: bool = False, pull_interval: float | None = None, max_retries: int | None = None, retries_interval: float | None = None) -> Subscription:
        c = self.store.config
        state = self.states.find(self.set_name, name) or SubscriptionState(self.set_name, name)
        state.options = dict(options or {})
        state.chunk_query_interval = c.pull_interval if pull_interval is None else pull_interval
        state.max_restarts_number = c.max_retries if max_retries is None else max_retries
        state.time_between_restarts = c.retries_interval if retries_interval is None else retries_interval
        self.subscriptions[name] = Subscription(self.store, state, handler, in_batches)
        return self.subscriptions[name]

    def lock(self) -> str:
        """Take all subscriptions under a new lease."""
        self.owner = self.states.join_set(self.set_name)
        for s in self.subscriptions.values():
            s.lock(self.owner, self.force_lock)
        return self.owner

    def start(self) -> None:
        self.lock()
        for s in self.subscriptions.values():
            s.start()

    def drain(self) -> int:
        """Process what is committed, subscription by subscription, and release them."""
        self.lock()
        try:
            return sum(s.drain() for s in self.subscriptions.values())
        finally:
            self.release()

    def heartbeat(self) -> None:
        if self.owner:
            self.states.heartbeat(self.set_name, self.owner)

    def restart_failed(self) -> int:
        """Start again, as often as allowed, the subscriptions whose query has ended with an error; their number."""
        n = 0
        for s in self.subscriptions.values():
            error = s.query.exception() if s.query is not None and not s.query.isActive else None
            if error is not None:
                s.query = None
                if s._recover(error):
                    s.start()
                    n += 1
        return n

    def stop(self) -> None:
        for s in self.subscriptions.values():
            s.stop()
        self.release()

    def release(self) -> None:
        for s in self.subscriptions.values():
            s.unlock()
        if self.owner:
            self.states.leave_set(self.set_name, self.owner)
        self.owner = None

    def run_commands(self) -> int:
        """Carry out waiting commands: Ping, StartAll, StopAll, Start, Stop, Restore, ResetPosition; their number."""
        n = 0
        for c in self.states.commands(self.owner or ""):
            one = self.subscriptions.get(c["subscription"])
            actions: dict[str, Callable[[], Any]] = {"Ping": self.heartbeat, "StartAll": lambda: [s.start() for s in self.subscriptions.values()], "StopAll": lambda: [s.stop() for s in self.subscriptions.values()]}
            if one is not None:
                actions |= {"Start": one.start, "Stop": one.stop, "Restore": one.restore, "ResetPosition": lambda one=one, c=c: one.reset_position(c["data"]["position"])}
            if c["name"] in actions:
                actions[c["name"]]()
                n += 1
            self.states.done(c)
        return n
