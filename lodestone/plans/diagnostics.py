"""Logging and progress: a bounded log, errors reported once, streaming state."""

from __future__ import annotations

import logging
from collections import deque

from pyspark.sql.streaming.listener import StreamingQueryListener

LOG = logging.getLogger("lodestone")
#: Fixed value: characters that a bounded log keeps.
MOST_CHARACTERS = 200_000


class RingHandler(logging.Handler):
    """Keeps the last ``most`` characters of what is logged."""

    def __init__(self, most: int = MOST_CHARACTERS):
        super().__init__()
        self.most, self.lines, self.size = most, deque(), 0
        self.setFormatter(logging.Formatter("%(asctime)s %(message)s"))

    def emit(self, record: logging.LogRecord) -> None:
        line = self.format(record)
        self.lines.append(line)
        self.size += len(line) + 1
        while self.size > self.most and len(self.lines) > 1:
            self.size -= len(self.lines.popleft()) + 1

    def clear(self) -> None:
        self.lines.clear()
        self.size = 0

    def text(self) -> str:
        return "\n".join(self.lines)[-self.most :]


class OnceFilter(logging.Filter):
    """Drops a message that repeats the one before it."""

    def __init__(self) -> None:
        super().__init__()
        self.last: str | None = None

    def filter(self, record: logging.LogRecord) -> bool:
        fresh = record.getMessage() != self.last
        self.last = record.getMessage()
        return fresh


class StateListener(StreamingQueryListener):
    """Calls ``changed(state, rows)`` as index maintenance starts, moves on and ends."""

    def __init__(self, changed):  # noqa: ANN001
        self.changed = changed

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        self.changed("starting", 0)

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        self.changed("indexing" if event.progress.numInputRows else "ready", event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        self.changed("ready", 0)

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        self.changed("error" if event.exception else "offline", 0)
