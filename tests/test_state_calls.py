"""Calls of the state are messages to the JVM: their number must not grow with the rows of a batch."""

import pandas as pd

from lineup.streaming.stateful import _Buckets, _Sessions


class _Counted:
    """A state or handle that takes every call and counts it; nothing is stored yet."""

    def __init__(self):
        self.calls = 0

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            return [] if name == "get" else False

        return call


class _Handle:
    def __init__(self):
        self.state, self.timers = _Counted(), 0
        self.getListState = self.getMapState = self.getValueState = lambda *args: self.state

    def registerTimer(self, at):
        self.timers += 1


def _calls(processor, rows: int) -> tuple[int, int]:
    handle = _Handle()
    processor.init(handle)
    us = [1_704_067_200_000_000 + k for k in range(rows)]
    pdf = pd.DataFrame({"us": us, "id": range(rows), "ends": False, "score": 1.0, "bucket": 104})
    out = list(processor.handleInputRows((1,), iter([pdf]), None))
    return handle.state.calls + handle.timers, sum(len(x) for x in out)


def test_state_calls_a_batch():
    assert _calls(_Sessions(["k", "first", "last", "events"], 10), 5)[0] == _calls(_Sessions(["k", "first", "last", "events"], 10), 500)[0]
    few, many = (_calls(_Buckets(["k", "id", "bucket", "kept"], 14), n) for n in (5, 500))
    assert few == (many[0], 4) and many[1] == 499
