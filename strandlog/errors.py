"""Errors that callers may want to tell apart."""

from __future__ import annotations


class StrandlogError(Exception):
    """Base of all errors of this package."""


class StreamNotFoundError(StrandlogError):
    def __init__(self, stream):
        super().__init__(f"there is no stream {stream}")
        self.stream = stream


class SystemStreamError(StrandlogError):
    def __init__(self, stream):
        super().__init__(f"{stream} is a system stream and can't be written")
        self.stream = stream


class WrongExpectedRevisionError(StrandlogError):
    """The stream's revision is not what the writer expected; ``revision`` is -1 if the stream doesn't exist."""

    def __init__(self, stream, expected, revision: int):
        if expected == "no_stream":
            why = f"the stream should not exist, but is at revision {revision}"
        elif revision < 0 and expected == "stream_exists":
            why = "the stream should exist, but doesn't"
        elif revision < 0:
            why = f"revision {expected} was expected, but the stream doesn't exist"
        else:
            why = f"revision {expected} was expected, but the stream is at {revision}"
        super().__init__(f"{stream}: {why}")
        self.stream, self.expected, self.revision = stream, expected, revision


class NotPersistedEventError(StrandlogError):
    """A link to an event that the store doesn't hold."""


class TooManyRecordsToLockError(StrandlogError):
    """Deleting this event would renumber more events than allowed without ``force``."""

    def __init__(self, stream, n: int):
        super().__init__(f"{stream}: {n} later events would be renumbered; pass force=True")
        self.stream, self.n = stream, n


class ReadOnlyTransactionError(StrandlogError):
    """A write inside multiple(read_only=True)."""


class CommitConflictError(StrandlogError):
    """Another writer took this commit version; the block is run again."""


class SubscriptionLockedError(StrandlogError):
    def __init__(self, name: str, owner: str):
        super().__init__(f"subscription {name} is locked by {owner}")
        self.owner = owner


class WrongLockError(StrandlogError):
    """The subscription's lock has changed hands since it was taken."""


class SubscriptionHandlerError(StrandlogError):
    """A handler raised; the position of the failed event is kept."""

    def __init__(self, position: int | None, cause: BaseException):
        super().__init__(f"handler failed at position {position}: {cause!r}")
        self.position = position
