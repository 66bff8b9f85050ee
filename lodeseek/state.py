"""Checks before a search, retries, and the last log lines: what runs on the driver beside queries."""

from __future__ import annotations

import logging
import time
from collections import deque
from collections.abc import Callable, Iterator
from typing import Any, TypeVar

T = TypeVar("T")


class NotReady(RuntimeError):
    pass


def stale_selection(selected: dict[str, Any], index: dict[str, Any] | None, claims_index: bool) -> bool:
    """Whether settings and index disagree: another engine or model, or settings that claim an index there is not."""
    if index is None:
        return claims_index
    return selected["engine"] != index["engine"] or selected["model"] != index["model_id"]


def before_semantic_search(root: str | None, index: dict[str, Any] | None, building: bool, has_embedder: bool) -> bool:
    """Raises if a semantic search cannot run; True if the index is of another folder, so a rebuild should start while it still answers."""
    if building:
        raise NotReady("the index is being built")
    if not has_embedder:
        raise NotReady("no embedding model is loaded")
    if index is None:
        raise NotReady("there is no index")
    return bool(root and index.get("root_path") and index["root_path"] != root)


def delays(tries: int = 5, first: float = 0.5, most: float = 5.0) -> Iterator[float]:
    """Waits between tries, doubling up to a limit."""
    for k in range(tries - 1):
        yield min(most, first * 2**k)


def retried(action: Callable[[], T], tries: int = 5, first: float = 0.5, most: float = 5.0, sleep: Callable[[float], None] = time.sleep) -> T:
    """action(), tried again after a failure; the last failure is raised."""
    for wait in delays(tries, first, most):
        try:
            return action()
        except Exception:
            sleep(wait)
    return action()


class LogRing(logging.Handler):
    """Keeps the last formatted lines."""

    def __init__(self, keep: int = 1000) -> None:
        super().__init__()
        self.lines: deque[str] = deque(maxlen=keep)

    def emit(self, record: logging.LogRecord) -> None:
        self.lines.append(self.format(record))


def probe(embedder: Any) -> dict[str, Any]:
    """Dimension of an embedder, measured on a text where it does not say, and its longest input."""
    size = getattr(embedder, "dimension", None) or len(embedder.embed(["probe"])[0])
    longest = getattr(embedder, "max_length", None)
    return {"model_id": embedder.model_id, "dimension": int(size), "max_length": 999_999 if longest in (None, float("inf")) else int(longest)}
