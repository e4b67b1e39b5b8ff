from types import SimpleNamespace

import pandas as pd

from kgspark.streaming import clock


class Held:
    """A value of state that counts how often it is called."""

    def __init__(self):
        self.value, self.calls, self.timers = None, 0, set()

    def getValueState(self, *_, **__):
        return self

    def getListState(self, *_, **__):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def listTimers(self):
        return list(self.timers)

    def deleteTimer(self, t):
        self.timers.remove(t)

    def registerTimer(self, t):
        self.timers.add(t)


def times(ms):
    return SimpleNamespace(getCurrentWatermarkInMs=lambda: ms, getCurrentProcessingTimeInMs=lambda: ms)


def test_a_bucket_of_reminders_is_read_and_written_once():
    held, n = Held(), 1000
    processor = clock.Clock(clock.HOUR, 24 * clock.HOUR)
    processor.init(held)
    rows = pd.DataFrame({"reminder_id": range(n), "at": 1_000, "action": "arm", "until": [(k + 1) * 1_000_000 for k in range(n)]})
    out = pd.concat(processor.handleInputRows((0,), iter([rows]), times(0)))
    assert (len(out), held.calls, held.timers) == (n, 2, {1000})
    out = pd.concat(processor.handleExpiredTimer((0,), times(500_000), None))
    assert set(out["reminder_id"]) == set(range(500)) and set(out["status"]) == {"fired"}
    assert held.calls == 4 and held.timers == {501_000}


def test_a_bucket_of_claims_forgets_what_was_not_seen_for_long():
    held = Held()
    processor = clock.Claims(100)
    processor.init(held)
    rows = lambda *r: iter([pd.DataFrame(r, columns=["reminder_id", "occurrence", "first"])])
    see = lambda at, *r: sorted(pd.concat(processor.handleInputRows((0,), rows(*r), times(at))).itertuples(index=False, name=None))
    assert see(0, (1, 5, 9), (1, 5, 7), (2, 5, 8)) == [(1, 5, 7, 2), (2, 5, 8, 1)] and held.calls == 2
    assert see(60, (1, 5, 6)) == [(1, 5, 6, 3)]
    assert see(150, (1, 5, 8), (2, 5, 8)) == [(1, 5, 6, 4), (2, 5, 8, 1)]
