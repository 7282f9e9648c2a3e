"""``python -m strandlog subscriptions start -r MODULE [-p PIDFILE]`` and ``... stop -p PIDFILE``.

MODULE defines ``managers()``, a list of SubscriptionManager. They run until the process gets TERM or INT, then stop after
the current batch.
"""

from __future__ import annotations

import argparse
import importlib
import os
import signal
import sys
import threading
from pathlib import Path

from strandlog.streaming.listeners import HeartbeatListener

PIDFILE = "/tmp/strandlog-subscriptions.pid"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandlog")
    area = p.add_subparsers(dest="area", required=True).add_parser("subscriptions")
    actions = area.add_subparsers(dest="action", required=True)
    for name in ("start", "stop"):
        a = actions.add_parser(name)
        a.add_argument("-p", "--pid", default=PIDFILE)
        if name == "start":
            a.add_argument("-r", "--require", required=True, help="module with managers()")
    return p


def start(module: str, pid: str, stop: threading.Event | None = None, interval: float = 0.5) -> None:
    """Start a module's managers, carry out their commands and keep their leases, until ``stop`` is set."""
    stop = stop or threading.Event()
    managers = importlib.import_module(module).managers()
    Path(pid).write_text(str(os.getpid()))
    if threading.current_thread() is threading.main_thread():
        for s in (signal.SIGTERM, signal.SIGINT):
            signal.signal(s, lambda *_: stop.set())
    listener = HeartbeatListener(lambda: [m.heartbeat() for m in managers])
    sessions = {id(m.store.spark): m.store.spark for m in managers}
    for m in managers:
        m.states.release_stale()
        m.start()
    for s in sessions.values():
        s.streams.addListener(listener)
    try:
        while not stop.wait(interval):
            for m in managers:
                m.run_commands()
                m.restart_failed()
    finally:
        for s in sessions.values():
            s.streams.removeListener(listener)
        for m in managers:
            m.stop()
        Path(pid).unlink(missing_ok=True)


def stop(pid: str) -> bool:
    """Send TERM to the process of a pid file; whether there was one."""
    path = Path(pid)
    if not path.exists():
        return False
    os.kill(int(path.read_text()), signal.SIGTERM)
    return True


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.action == "start":
        start(args.require, args.pid)
        return 0
    return 0 if stop(args.pid) else 1


if __name__ == "__main__":
    sys.exit(main())
