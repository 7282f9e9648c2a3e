"""The store: appends, expected revisions, links, deletions, transactions, compaction, subscriptions."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from strandlog import errors
from strandlog.config import Config
from strandlog.errors import SystemStreamError
from strandlog.schema import Event, Stream
from strandlog.sources.store import LogStore
from strandlog.streaming.state import StateStore, SubscriptionState
from strandlog.streaming.subscriptions import Subscription, SubscriptionManager, Timings, next_chunk_size

A, B = Stream("FooCtx", "Foo", "1"), Stream("BarCtx", "Bar", "")


@pytest.fixture
def store(spark, tmp_path):
    return LogStore(spark, str(tmp_path / "store"))


def ids(df):
    return [(r.type, r.stream_revision) for r in df.collect()]


def test_append_and_read(store):
    one = store.append(A, Event("Foo", {"a": 1}))
    assert (one["stream_revision"], one["global_position"], one["data"]) == (0, 1, '{"a": 1}')
    many = store.append(A, [Event("Bar"), Event("Baz")], expected_revision=0)
    assert [e["stream_revision"] for e in many] == [1, 2]
    store.append(B, Event("Foo"))
    assert ids(store.read(A)) == [("Foo", 0), ("Bar", 1), ("Baz", 2)]
    assert ids(store.read(B)) == [("Foo", 0)]  # an empty stream_id is a value like others
    assert [r.global_position for r in store.read(Stream.all(), {"direction": "desc"}).collect()] == [4, 3, 2, 1]
    assert store.safe_position() == 4
    plan = store.log().where("context = 'FooCtx'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "p_context" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_expected_revision(store):
    for expected in (0, "stream_exists"):
        with pytest.raises(errors.WrongExpectedRevisionError):
            store.append(A, Event("Foo"), expected_revision=expected)
    store.append(A, Event("Foo"), expected_revision="no_stream")
    for expected in (1, "no_stream", -1):
        with pytest.raises(errors.WrongExpectedRevisionError):
            store.append(A, Event("Foo"), expected_revision=expected)
    store.append(A, Event("Foo"), expected_revision="stream_exists")
    assert store.stream_revision(A) == 1
    with pytest.raises(errors.SystemStreamError):
        store.append(Stream.system("$streams"), Event("Foo"))
    with pytest.raises(errors.StreamNotFoundError):
        store.read(B)


def test_links(store):
    a = store.append(A, [Event("Foo"), Event("Bar")])
    links = store.link_to(B, [a[1]["global_position"], a[0]["global_position"]])
    assert [x["type"] for x in links] == ["$>", "$>"]
    assert ids(store.read(B, {"resolve_link_tos": True})) in ([("Bar", 1), ("Foo", 0)], [("Foo", 0), ("Bar", 1)])
    with pytest.raises(errors.NotPersistedEventError):
        store.link_to(B, [77])
    store.delete_stream(A)
    assert ids(store.read(B, {"resolve_link_tos": True})) == [("$>", 0), ("$>", 1)]  # dangling


def test_delete_and_compact(store):
    store.append(A, [Event(t) for t in "abcde"])
    assert store.delete_event(A, 1) and store.delete_event(A, 2) and not store.delete_event(A, 9)
    want = [("a", 0), ("c", 1), ("e", 2)]
    assert ids(store.read(A)) == want
    store.append(A, Event("f"))
    assert ids(store.read(A)) == [*want, ("f", 3)]
    store.append(B, Event("x"))
    assert store.delete_stream(B) and not store.delete_stream(B)
    store.compact()
    assert store.state().tombstones == [] and len(store.state().commits) == 1
    assert ids(store.read(A)) == [*want, ("f", 3)]
    store.append(B, Event("y"), expected_revision="no_stream")
    assert ids(store.read(B)) == [("y", 0)]
    assert LogStore(store.spark, store.path).stream_revision(A) == 3


def test_too_many_to_renumber(store, monkeypatch):
    monkeypatch.setattr("strandlog.sources.store.RENUMBERED", 1)
    store.append(A, [Event("a"), Event("b"), Event("c")])
    with pytest.raises(errors.TooManyRecordsToLockError):
        store.delete_event(A, 0)
    assert store.delete_event(A, 0, force=True)


def test_multiple_is_atomic(store):
    def block(tx):
        tx.append(A, Event("a"))
        tx.append(B, Event("b"))
        assert tx.stream_revision(A) == 0 and ids(tx.read(A)) == [("a", 0)]
        return "out"

    assert store.multiple(block) == "out"
    assert store.state().version == 1

    def failing(tx):
        tx.append(A, Event("lost"))
        raise RuntimeError("stop")

    with pytest.raises(RuntimeError):
        store.multiple(failing)
    assert ids(store.read(A)) == [("a", 0)]
    with pytest.raises(errors.ReadOnlyTransactionError):
        store.multiple(lambda tx: tx.append(A, Event("a")), read_only=True)


def test_concurrent_writers(store, spark):
    def write(kind, n):
        own = LogStore(spark, store.path)
        for _ in range(3):
            own.append(A, [Event(kind)] * n)

    threads = [threading.Thread(target=write, args=a) for a in (("x", 3), ("y", 2), ("z", 1))]
    [t.start() for t in threads]
    [t.join() for t in threads]
    rows = store.read(A).collect()
    assert [r.stream_revision for r in rows] == list(range(18))
    assert [r.global_position for r in rows] == list(range(1, 19))
    run, size = 0, {"x": 3, "y": 2, "z": 1}
    for k, r in enumerate(rows):
        run = run + 1 if k and rows[k - 1].type == r.type else 1
        if k + 1 == len(rows) or rows[k + 1].type != r.type:
            assert run % size[r.type] == 0  # blocks are never mixed


def test_append_frame(store, spark):
    store.append(A, Event("first"))
    batch = spark.createDataFrame([("FooCtx", "Foo", "1", "n", 5), ("BarCtx", "Bar", "2", "n", 7), ("FooCtx", "Foo", "1", "n", 9)], "context string, stream_name string, stream_id string, type string, k long")
    store.append_frame(batch, "k")
    assert [(r.global_position, r.stream_id, r.stream_revision) for r in store.read(Stream.all()).collect()] == [(1, "1", 0), (2, "1", 1), (3, "2", 0), (4, "1", 2)]
    store.append(A, Event("last"), expected_revision=2)


class Upper:
    def serialize(self, df):
        from pyspark.sql import functions as F

        return df.withColumn("data", F.upper("data"))

    def deserialize(self, df):
        from pyspark.sql import functions as F

        return df.withColumn("metadata", F.lit('{"seen": true}'))


def test_middlewares(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "s"), middlewares=[("upper", Upper())])
    store.append(A, Event("a", {"k": "v"}))
    assert store.read(A).first().data == '{"K": "V"}'
    assert store.read(A).first().metadata == '{"seen": true}'
    assert store.read(A, middlewares=["other"]).first().metadata == "{}"


def test_subscription(store):
    store.append(A, [Event("a"), Event("b")])
    store.append(B, Event("c"))
    got = []
    sub = Subscription(store, SubscriptionState("set", "sub", {"filter": {"streams": [{"context": "FooCtx"}]}}), lambda e: got.append(e["type"])).lock("me")
    assert sub.drain() == 2 and got == ["a", "b"]
    store.append(A, Event("d"))
    assert sub.drain() == 1 and got == ["a", "b", "d"]
    sub.reset_position(1)
    got.clear()
    assert sub.drain() == 2 and got == ["b", "d"]  # exclusive
    with pytest.raises(errors.SubscriptionLockedError):
        Subscription(store, SubscriptionState("set", "sub"), print).lock("me")
    Subscription(store, SubscriptionState("set", "sub"), print).lock("other", force=True)
    with pytest.raises(errors.WrongLockError):
        sub._save()


def test_subscription_retries_without_loss(spark, tmp_path):
    failed = []
    store = LogStore(spark, str(tmp_path / "s"), Config(failed_notifier=lambda row, e: failed.append(row.name)))
    store.append(A, [Event(t) for t in "abc"])
    got, broken = [], {"b": 2}

    def handler(e):
        if broken.get(e["type"], 0):
            broken[e["type"]] -= 1
            raise ValueError("once more")
        got.append(e["type"])

    sub = Subscription(store, SubscriptionState("s", "n", time_between_restarts=0, max_restarts_number=2), handler).lock("me")
    assert sub.drain() == 3 and got == ["a", "b", "c"] and sub.row.restart_count == 2 and not failed
    broken["d"] = 99
    store.append(A, Event("d"))
    with pytest.raises(Exception):
        sub.drain()
    assert failed == ["n"] and sub.row.state == "dead" and "once more" in sub.row.last_error


def test_batches_links_and_manager(store):
    a = store.append(A, [Event("Foo"), Event("Bar")])
    store.link_to(B, [e["global_position"] for e in a])
    got = []
    m = SubscriptionManager(store, "set")
    m.subscribe("all", lambda df: got.append([r.type for r in df.collect()]), {"resolve_link_tos": True}, in_batches=True)
    assert m.drain() == 4 and sum(got, []) == ["Foo", "Bar", "Foo", "Bar"]
    assert m.states.find("set", "all").locked_by is None and m.states.sets() == []
    owner = m.lock()
    m.states.send(owner, "ResetPosition", "all", {"position": 0})
    m.states.send(owner, "Ping")
    m.states.send(owner, "Ping")
    assert [c["name"] for c in m.states.commands(owner)] == ["Ping", "ResetPosition"]
    assert m.run_commands() == 2 and m.subscriptions["all"].row.generation == 1
    m.release()


def test_stale_locks_are_released(store):
    states = StateStore(store.files)
    states.lock(SubscriptionState("s", "n"), "gone")
    assert states.release_stale() == ["n"] and states.find("s", "n").locked_by is None
    assert [s.name for s in states.all()] == ["n"]
    states.delete("s", "n")
    assert states.find("s", "n") is None


@pytest.mark.parametrize(("interval", "average", "backlog", "want"), [(1, 0, 0, 10), (5, 0.1, 0, 50), (5, 0.1, 20, 30), (1, 0.0001, 0, 1000), (1, 0.0001, 2, 998), (1, 2, 0, 10), (1, 2, 11, 0)])
def test_chunk_size(interval, average, backlog, want):
    assert next_chunk_size(interval, average, backlog) == want


def test_timings():
    t = Timings(3)
    assert t.average == 0
    for x in (1, 2, 3, 4):
        t.track(x)
    assert t.average == 3


class _Stamp:
    """A middleware that writes its name into the metadata, and adds it to the data when rows are read."""

    def __init__(self, name):
        self.name = name

    def serialize(self, rows):
        return rows.withColumn("metadata", F.concat("metadata", F.lit(self.name)))

    def deserialize(self, rows):
        return rows.withColumn("data", F.concat("data", F.lit(self.name)))


def test_middlewares_by_append(spark, tmp_path):
    """Each append of a transaction has its own middlewares, links have none, and a resolved row's link stays as stored."""
    store = LogStore(spark, f"file://{tmp_path}/m", middlewares=[("a", _Stamp("a")), ("b", _Stamp("b"))])
    one, views = Stream("C", "S", "1"), Stream("V", "S", "1")
    store.multiple(lambda tx: (tx.append(one, Event("A"), middlewares=["a"]), tx.append(one, Event("B"), middlewares=[]), tx.append(one, Event("C"))))
    store.link_to(views, [1])
    assert [r.metadata for r in store.stored().orderBy("global_position").collect()] == ["{}a", "{}", "{}ab", "{}"]
    row = store.read(views, {"resolve_link_tos": True}).first()
    assert row.data == "{}ab" and row.metadata == "{}a" and row.link.data == "{}"
    assert [r.data for r in store.read(one, middlewares=["b"]).collect()] == ["{}b"] * 3


def test_append_frame_guards(spark, tmp_path):
    store = LogStore(spark, f"file://{tmp_path}/g", middlewares=[("a", _Stamp("a"))])
    rows = spark.createDataFrame([("C", "S", "1", "A", 1), ("C", "S", "1", "A", 2)], "context string, stream_name string, stream_id string, type string, k long")
    store.append_frame(rows, "k")
    assert [r.metadata for r in store.stored().collect()] == ["{}a"] * 2
    with pytest.raises(ValueError):
        store.append_frame(rows.withColumn("k", F.lit(1)), "k")
    with pytest.raises(SystemStreamError):
        store.append_frame(rows.withColumn("context", F.lit("$streams")), "k")


def test_a_batch_does_not_read_the_log(spark, tmp_path):
    """What a subscription sees of a batch is made of the batch and the tombstones; deleted events are gone, compacted or not."""
    store = LogStore(spark, f"file://{tmp_path}/b")
    one = Stream("C", "S", "1")
    store.append(one, [Event("A"), Event("B"), Event("C")])
    batch = store._data(store.state().commits)
    store.delete_event(one, 1)
    for _ in range(2):
        seen = Subscription(store, SubscriptionState("s", "n"), print).rows(batch)
        assert [(r.type, r.stream_revision) for r in seen.collect()] == [("A", 0), ("C", 1)]
        plan = seen._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("Scan parquet") == 1
        store.compact()
