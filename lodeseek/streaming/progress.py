"""Progress of index upkeep for whoever wants to follow it: the last events, and callbacks around batches with changes."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable

from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener


class Progress(StreamingQueryListener):
    """A follower that is slow misses old events, as only the last are kept."""

    def __init__(self, keep: int = 100, on_rows: Callable[[int], None] | None = None) -> None:
        self.events: deque[dict] = deque(maxlen=keep)
        self.on_rows = on_rows

    def onQueryStarted(self, event: QueryStartedEvent) -> None:  # noqa: N802
        self.events.append({"kind": "started", "id": str(event.id)})

    def onQueryProgress(self, event: QueryProgressEvent) -> None:  # noqa: N802
        value = json.loads(event.progress.json)
        self.events.append({"kind": "progress", "id": value["id"], "batch": value["batchId"], "rows": value.get("numInputRows", 0), "seconds": value.get("batchDuration", 0) / 1000})
        if self.on_rows and value.get("numInputRows"):
            self.on_rows(value["numInputRows"])

    def onQueryIdle(self, event: QueryIdleEvent) -> None:  # noqa: N802
        self.events.append({"kind": "idle", "id": str(event.id)})

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:  # noqa: N802
        self.events.append({"kind": "error" if event.exception else "done", "id": str(event.id), "error": event.exception})
