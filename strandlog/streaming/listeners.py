"""A streaming listener that keeps a set's lease alive while its queries make progress."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener


class HeartbeatListener(StreamingQueryListener):
    """Calls ``beat`` at most once every ``interval`` seconds, on progress or idle ticks of any query of the session."""

    def __init__(self, beat: Callable[[], None], interval: float = 10.0):
        self.beat, self.interval, self.last = beat, interval, float("-inf")

    def _tick(self) -> None:
        now = time.monotonic()
        if now - self.last >= self.interval:
            self.last = now
            self.beat()

    def onQueryStarted(self, event) -> None:
        self._tick()

    def onQueryProgress(self, event) -> None:
        self._tick()

    def onQueryIdle(self, event) -> None:
        self._tick()

    def onQueryTerminated(self, event) -> None:
        pass
