import logging

import pytest

from lodeseek import state
from lodeseek.operators.embed import HashingEmbedder


def test_stale_selection():
    index = {"engine": "SBERT", "model_id": "m", "root_path": "/r"}
    assert not state.stale_selection({"engine": "SBERT", "model": "m"}, index, True)
    assert state.stale_selection({"engine": "SBERT", "model": "n"}, index, True)
    assert state.stale_selection({"engine": "SBERT", "model": "m"}, None, True)
    assert not state.stale_selection({"engine": "SBERT", "model": "m"}, None, False)


def test_before_semantic_search():
    index = {"root_path": "/r"}
    assert not state.before_semantic_search("/r", index, False, True)
    assert state.before_semantic_search("/x", index, False, True)
    for args in ((index, True, True), (index, False, False), (None, False, True)):
        with pytest.raises(state.NotReady):
            state.before_semantic_search("/r", *args)


def test_retries():
    waits, calls = [], []

    def action():
        calls.append(1)
        if len(calls) < 4:
            raise OSError
        return "ok"

    assert state.retried(action, sleep=waits.append) == "ok" and waits == [0.5, 1.0, 2.0]
    assert list(state.delays(8)) == [0.5, 1, 2, 4, 5, 5, 5]
    with pytest.raises(ZeroDivisionError):
        state.retried(lambda: 1 / 0, tries=2, sleep=waits.append)


def test_log_ring_and_probe():
    ring = state.LogRing(3)
    log = logging.getLogger("ring")
    log.addHandler(ring)
    for k in range(5):
        log.warning("line %d", k)
    assert list(ring.lines) == ["line 2", "line 3", "line 4"]
    assert state.probe(HashingEmbedder(12)) == {"model_id": "hashing", "dimension": 12, "max_length": 999_999}
