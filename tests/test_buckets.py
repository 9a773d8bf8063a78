"""The state of crossings: tickers share a group, and each is read and written once a batch."""

import datetime as dt

import pandas as pd

from larkspur.streaming.levels import Crossing


class Handle:
    def __init__(self):
        self.kept, self.calls, self.timers = {}, 0, []

    def getMapState(self, *_):  # noqa: N802
        return self

    def getValue(self, k):  # noqa: N802
        self.calls += 1
        return self.kept.get(k)

    def updateValue(self, k, v):  # noqa: N802
        self.calls += 1
        self.kept[k] = v

    def removeKey(self, k):  # noqa: N802
        del self.kept[k]

    def iterator(self):
        return iter(self.kept.items())

    def listTimers(self):  # noqa: N802
        return iter(self.timers)

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)


class Mark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms


def test_two_calls_for_each_ticker():
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(f"k{i % 50}", t(i), 99.0 + i // 50 % 2 * 2, None, None) for i in range(1000)] + [(f"k{i}", t(0), None, 1, 100.0) for i in range(50)]
    handle, work = Handle(), Crossing(3600)
    work.init(handle)
    frame = pd.DataFrame(rows, columns=["ticker", "ts", "price", "level_id", "level"])
    found = pd.concat(work.handleInputRows((7,), iter([frame[::2], frame[1::2]]), Mark(0)))
    assert handle.calls == 100 and len(handle.timers) == 1
    assert len(found) == 50 * 19 and set(found["ticker"]) == {f"k{i}" for i in range(50)}
    first = found[found["ticker"] == "k3"].iloc[0]
    assert (first["ts"], first["price"], first["up"]) == (pd.Timestamp(t(53)), 101.0, True)
    # Idle tickers go by the bucket's timer; those with newer rows stay, and the bucket keeps a timer.
    end = int(pd.Timestamp(t(970)).value // 1_000_000) + 3_600_000
    list(work.handleExpiredTimer((7,), Mark(end), None))
    assert {k[0] for k in handle.kept} == {f"k{i}" for i in range(21, 50)} and len(handle.timers) == 2
