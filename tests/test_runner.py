"""The runner of subscription managers: start, commands, recovery, lease, stop."""

from __future__ import annotations

import sys
import threading
import time
import types

from strandlog import __main__ as cli
from strandlog.functions.payload import PayloadTypes
from strandlog.schema import Event, Stream
from strandlog.sources.store import LogStore
from strandlog.streaming.listeners import HeartbeatListener
from strandlog.streaming.subscriptions import SubscriptionManager

A = Stream("FooCtx", "Foo", "1")


def wait_for(what, seconds=60):
    end = time.time() + seconds
    while not what() and time.time() < end:
        time.sleep(0.2)
    return what()


def test_start_process_recover_stop(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "store"))
    store.append(A, [Event("a"), Event("b")])
    got, fail = [], {"b": 1}

    def handler(event):
        if fail.pop(event["type"], 0):
            raise ValueError("once")
        got.append(event["type"])

    manager = SubscriptionManager(store, "set")
    manager.subscribe("one", handler, pull_interval=0.2, retries_interval=0)
    module = types.ModuleType("strandlog_test_managers")
    module.managers = lambda: [manager]
    sys.modules[module.__name__] = module
    stop, pid = threading.Event(), str(tmp_path / "pid")
    thread = threading.Thread(target=cli.start, args=(module.__name__, pid, stop, 0.1))
    thread.start()
    assert wait_for(lambda: got == ["a", "b"])
    store.append(A, Event("c"))
    assert wait_for(lambda: got == ["a", "b", "c"])
    stop.set()
    thread.join(60)
    row = manager.states.find("set", "one")
    assert (row.state, row.locked_by, row.current_position, row.restart_count) == ("stopped", None, 3, 1)
    assert not (tmp_path / "pid").exists() and not cli.stop(pid)


def test_listener_and_arguments():
    beats = []
    listener = HeartbeatListener(lambda: beats.append(1), 1000)
    for _ in range(3):
        listener.onQueryProgress(None)
    assert beats == [1]
    args = cli.parser().parse_args(["subscriptions", "start", "-r", "app", "-p", "/tmp/x"])
    assert (args.action, args.require, args.pid) == ("start", "app", "/tmp/x")


def test_event_classes():
    class Mine(dict):
        pass

    registry = PayloadTypes().register_class("mine", Mine)
    assert isinstance(registry.build({"type": "mine"}), Mine) and type(registry.build({"type": "other"})) is dict
