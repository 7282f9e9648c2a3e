"""Named settings of stores and subscriptions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from strandlog.schema import DEFAULT_COUNT


@dataclass(frozen=True)
class Config:
    """Defaults of one store; ``middlewares`` are applied in order by name."""

    path: str = ""
    max_count: int = DEFAULT_COUNT
    middlewares: tuple[tuple[str, Any], ...] = ()
    pull_interval: float = 1.0
    max_retries: int = 5
    retries_interval: float = 1.0
    set_max_retries: int = 10
    shutdown_timeout: float = 15.0
    restart_terminator: Callable[[Any], bool] | None = None
    failed_notifier: Callable[[Any, BaseException], None] | None = None


_configs: dict[str, Config] = {"default": Config()}


def configure(name: str = "default", **changes: Any) -> Config:
    """Set values of a named configuration, which is made if new, and return it."""
    _configs[name] = replace(_configs.get(name, Config()), **changes)
    return _configs[name]


def config(name: str = "default") -> Config:
    if name not in _configs:
        raise KeyError(f"there is no configuration {name!r}")
    return _configs[name]
