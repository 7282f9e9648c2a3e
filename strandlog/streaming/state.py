"""State of subscriptions and their sets: queries over state tables, and the store they are kept in."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, functions as F

from strandlog.errors import SubscriptionLockedError, WrongLockError
from strandlog.sources.files import Files

STATES = ("initial", "running", "halting", "stopped", "dead")


def set_names(sets: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """All set names, of sets (name) and of subscriptions (set), in order."""
    return sets.select("name").union(subscriptions.select(F.col("set").alias("name"))).distinct().orderBy("name")


def sets_with_state(sets: DataFrame, subscriptions: DataFrame, state: str) -> DataFrame:
    """The sets that lock at least one subscription in ``state``."""
    locked = subscriptions.where((F.col("state") == state) & F.col("locked_by").isNotNull()).select(F.col("locked_by").alias("name"))
    return sets.join(locked, "name", "left_semi")


def associate(sets: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(set_name, subscriptions): each set's locked subscriptions, [] for a set without, a null set for free ones."""
    joined = sets.select(F.col("name").alias("set_name")).join(subscriptions.select("name", "locked_by"), F.col("set_name") == F.col("locked_by"), "full_outer")
    return joined.groupBy("set_name").agg(F.collect_list("name").alias("subscriptions"))


def distinct_sets(subscriptions: DataFrame, state: str | None = None) -> DataFrame:
    rows = subscriptions if state is None else subscriptions.where(F.col("state") == state)
    return rows.select("set").distinct().orderBy("set")


@dataclass
class SubscriptionState:
    """One durable consumer: its place in the log, statistics, life cycle and lock."""

    set: str
    name: str
    options: dict[str, Any] = field(default_factory=dict)
    current_position: int | None = None
    total_processed_events: int = 0
    average_event_processing_time: float = 0.0
    state: str = "initial"
    restart_count: int = 0
    max_restarts_number: int = 5
    time_between_restarts: float = 1.0
    chunk_query_interval: float = 1.0
    last_error: str | None = None
    last_error_at: float | None = None
    generation: int = 0
    locked_by: str | None = None
    created_at: float = 0.0
    updated_at: float = 0.0


class StateStore:
    """Rows of subscriptions, sets and commands as small JSON files beside the log, replaced whole."""

    def __init__(self, files: Files):
        self.files = files

    def _path(self, kind: str, *key: str) -> str:
        return f"_state/{kind}/" + "/".join("k" + part.encode().hex() for part in key) + ".json"

    def find(self, set_name: str, name: str) -> SubscriptionState | None:
        raw = self.files.read(self._path("subscriptions", set_name, name))
        return SubscriptionState(**json.loads(raw)) if raw is not None else None

    def save(self, state: SubscriptionState) -> SubscriptionState:
        """Write the row; if it is locked by another than the row says, WrongLockError."""
        now = self.find(state.set, state.name)
        if now is not None and now.locked_by != state.locked_by:
            raise WrongLockError(f"{state.set}/{state.name} is locked by {now.locked_by}")
        return self._put(state)

    def _put(self, state: SubscriptionState) -> SubscriptionState:
        state.updated_at = time.time()
        state.created_at = state.created_at or state.updated_at
        self.files.replace(self._path("subscriptions", state.set, state.name), json.dumps(asdict(state)))
        return state

    def lock(self, state: SubscriptionState, owner: str, force: bool = False) -> SubscriptionState:
        """Take the subscription for ``owner``; a locked one raises, even for its owner, unless forced."""
        now = self.find(state.set, state.name) or state
        if now.locked_by is not None and not force:
            raise SubscriptionLockedError(state.name, now.locked_by)
        now.locked_by, now.restart_count, now.last_error, now.last_error_at = owner, 0, None, None
        now.options, now.chunk_query_interval = state.options, max(0.2, state.chunk_query_interval)
        return self._put(now)

    def unlock(self, state: SubscriptionState) -> None:
        now = self.find(state.set, state.name)
        if now is not None and now.locked_by == state.locked_by:
            now.locked_by = None
            self._put(now)

    def all(self) -> list[SubscriptionState]:
        return [SubscriptionState(**json.loads(self.files.read(p))) for p in self.files.list("_state/subscriptions", recursive=True) if p.endswith(".json")]

    def delete(self, set_name: str, name: str) -> None:
        self.files.delete(self._path("subscriptions", set_name, name))

    # sets: a lease that its owner renews
    def join_set(self, name: str) -> str:
        owner = f"{name}-{uuid.uuid4().hex[:12]}"
        self.heartbeat(name, owner)
        return owner

    def heartbeat(self, name: str, owner: str, state: str = "running") -> None:
        self.files.replace(self._path("sets", name, owner), json.dumps({"name": name, "owner": owner, "state": state, "updated_at": time.time()}))

    def sets(self) -> list[dict[str, Any]]:
        return [json.loads(self.files.read(p)) for p in self.files.list("_state/sets", recursive=True) if p.endswith(".json")]

    def is_live(self, owner: str, interval: float = 10.0) -> bool:
        return any(s["owner"] == owner and s["updated_at"] > time.time() - interval - 1 for s in self.sets())

    def leave_set(self, name: str, owner: str) -> None:
        self.files.delete(self._path("sets", name, owner))

    def release_stale(self, interval: float = 10.0) -> list[str]:
        """Unlock the subscriptions of owners whose lease has run out; their names are returned."""
        out = []
        for s in self.all():
            if s.locked_by and not self.is_live(s.locked_by, interval):
                self.unlock(s)
                out.append(s.name)
        return out

    # commands: one file for each (subscription, set, command)
    def send(self, set_owner: str, command: str, subscription: str = "", data: dict[str, Any] | None = None) -> None:
        path = self._path("commands", set_owner, subscription, command)
        if self.files.read(path) is None:
            self.files.replace(path, json.dumps({"set": set_owner, "subscription": subscription, "name": command, "data": data or {}, "created_at": time.time()}))

    def commands(self, set_owner: str) -> list[dict[str, Any]]:
        """A set's waiting commands, Ping first, then by age."""
        paths = self.files.list(f"_state/commands/k{set_owner.encode().hex()}", recursive=True)
        found = [json.loads(self.files.read(p)) for p in paths if p.endswith(".json")]
        return sorted(found, key=lambda c: (c["name"] != "Ping", c["created_at"]))

    def done(self, command: dict[str, Any]) -> None:
        self.files.delete(self._path("commands", command["set"], command["subscription"], command["name"]))
