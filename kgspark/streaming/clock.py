"""Reminders that act by themselves: state per reminder, timers in event time, no row lost however late it comes.

Time passes by ticks, a stream of its own. Only ticks carry the watermark, so timers fire as ticks go by, and actions, which
carry none, never fall behind it: an action that is seen long after it was taken changes what follows from it, and the rows
that it makes wrong are taken back.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import docket
from ..shipping import ship

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"
HOUR = 3_600_000_000
#: A reminder in one of these stays there.
FINAL = ("done", "cancelled")
#: Reminders are dealt to so many buckets of state, by a digest; fixed for the life of a checkpoint.
BUCKETS = 256


@contextmanager
def state_store(spark: SparkSession, idle_batches: bool = True) -> Iterator[None]:
    """The state store that timers and expiry need, for queries started inside; afterwards the session is as it was.

    idle_batches: whether batches without data run when the watermark moves, as timers in event time need them. State that
    expires by the time of processing asks for one after every batch, without end, so they are off for `claimed`.
    """
    wanted = {PROVIDER: ROCKS, IDLE: str(idle_batches).lower()}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


@dataclass(frozen=True)
class Reminder:
    """What is known of a reminder at a time. target: when it fires next; open: an occurrence that fired and nobody claimed.

    Times are microseconds, -1 for none.
    """

    state: str = "pending"
    target: int = -1
    open: int = -1


def until(r: Reminder, now: int, grace: int, out: dict[int, str]) -> Reminder:
    """What timers do up to a time: a reminder that is due fires; a firing that nobody claimed within the grace is missed."""
    if r.target >= 0 and r.target <= now:
        out.setdefault(r.target, "fired")
        r = Reminder("sent", -1, r.target)
    if r.open >= 0 and r.open + grace < now:
        out[r.open] = "late_missed"
        r = Reminder("missed")
    return r


def act(r: Reminder, at: int, action: str, to: int) -> Reminder:
    """What an action does: arm and snooze set the time of the next firing (snooze in the future only), claim takes a firing."""
    if r.state in FINAL:
        return r
    if action == "arm":
        return Reminder("pending", to)
    if action == "snooze":
        return Reminder("snoozed", to) if to > at else r
    if action == "claim":
        return replace(r, open=-1) if r.state == "sent" else r
    if action in ("acknowledge", "done", "cancel"):
        return Reminder({"acknowledge": "acknowledged", "done": "done", "cancel": "cancelled"}[action])
    return r


def fold(r: Reminder, actions: Iterable[tuple[int, str, int]], clock: int, grace: int) -> tuple[Reminder, dict[int, str]]:
    """The reminder after actions (time, action, until) in their order and the clock, and what became of each occurrence."""
    out: dict[int, str] = {}
    for at, action, to in actions:
        r = act(until(r, at, grace, out), at, action, to)
    return until(r, clock, grace, out), out


class Clock(StatefulProcessor):
    """State of a bucket of reminders. Of each: the reminder as of actions that are settled, those that aren't, the clock they
    were folded to, and when it has to be looked at next.

    An action settles kept microseconds after its time; one that comes later still counts as taken when the last settled.
    A bucket is read and written once for all of its reminders, for each call to the engine takes far longer than a fold.
    """

    def __init__(self, grace: int, kept: int) -> None:
        self.grace, self.kept = grace, kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "reminders binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new: dict[int, list[tuple[int, str, int]]] = {}
        for b in rows:
            for r, *action in zip(b["reminder_id"].tolist(), b["at"].tolist(), b["action"].tolist(), b["until"].tolist(), strict=True):
                new.setdefault(r, []).append(tuple(action))
        yield from self.passed(new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.passed({}, timerValues.getCurrentWatermarkInMs())

    def passed(self, new: dict[int, list[tuple[int, str, int]]], now: int) -> Iterator[pd.DataFrame]:
        """Fold the reminders that have new actions, and those whose time has come."""
        held = self.held.get()
        reminders = pickle.loads(bytes(held[0])) if held else {}
        out: list[tuple] = []
        for key in [*new, *(k for k, r in reminders.items() if k not in new and 0 <= r[-1] <= now)]:
            reminders[key], rows = self.folded(key, reminders.get(key), new.get(key, []), now * 1000)
            out += rows
        self.held.update((pickle.dumps(reminders),))
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        following = min((r[-1] for r in reminders.values() if r[-1] >= 0), default=-1)
        if following >= 0:
            self.handle.registerTimer(max(following, now + 1))
        if out:
            ids, occurrences, statuses, states, counts = zip(*out, strict=True)
            yield pd.DataFrame({"reminder_id": ids, "occurrence": pd.array(occurrences, "Int64"), "status": statuses, "state": states, "actions": counts})

    def folded(self, key: int, held: tuple | None, new: list[tuple[int, str, int]], clock: int) -> tuple[tuple, list[tuple]]:
        """What is held of a reminder from now on, and its rows."""
        base, settled, before, count, old, _ = held or (Reminder(), -1, -1, 0, [], -1)
        was = fold(base, old, before, self.grace)[1] if before >= 0 else {}
        own = sorted([*old, *((max(int(at), settled), action, int(to)) for at, action, to in new)])
        clock = max(clock, before, 0)
        now, occurrences = fold(base, own, clock, self.grace)
        changed = [(o, s) for o, s in sorted(occurrences.items()) if was.get(o) != s] + [(o, "retracted") for o in sorted(was.keys() - occurrences.keys())]
        done = [r for r in own if r[0] < clock - self.kept]
        if done:
            base, own, settled = fold(base, done, done[-1][0], self.grace)[0], own[len(done) :], done[-1][0]
        count += len(new)
        following = [t for t in (now.target, now.open + self.grace + 1 if now.open >= 0 else -1, own[0][0] + self.kept + 1 if own else -1) if t >= 0]
        # Timers are milliseconds; rounded up, so that the time has come when they fire.
        at = max(-(-min(following) // 1000), clock // 1000 + 1) if following else -1
        rows = [(key, o, s, now.state, count) for o, s in changed or ([(None, None)] if new else [])]
        return (base, settled, clock, count, own, at), rows


OUT = "reminder_id long, occurrence long, status string, state string, actions long"


def reminder_clock(actions: DataFrame, ticks: DataFrame, grace_hours: int = docket.GRACE_HOURS, kept_days: int = 10) -> DataFrame:
    """A stream of what reminders do. actions: reminder_id, at, action, until (null: none); ticks: now.

    Rows: reminder_id, occurrence_time and status (fired, late_missed, retracted) of an occurrence that changed (null: none
    did), the reminder's state and the number of its actions so far. Of several rows the last one counts. Start it inside
    `state_store`.
    """
    ship(actions.sparkSession)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    acted = actions.select(F.pmod(F.xxhash64("reminder_id"), F.lit(BUCKETS)).alias("bucket"), F.col("reminder_id").cast("long").alias("reminder_id"), micros("at").alias("at"), F.coalesce("action", F.lit("")).alias("action"), F.coalesce(micros("until"), F.lit(-1)).alias("until"), F.lit(None).cast("timestamp").alias("now"))
    passed = ticks.select(F.lit(-1).cast("long").alias("bucket"), F.lit(-1).cast("long").alias("reminder_id"), F.lit(0).cast("long").alias("at"), F.lit("tick").alias("action"), F.lit(-1).cast("long").alias("until"), F.col("now").cast("timestamp").alias("now"))
    # Ticks have done their work once they have moved the watermark.
    rows = acted.union(passed).withWatermark("now", "0 seconds").where("now is null")
    found = rows.groupBy("bucket").transformWithStateInPandas(Clock(grace_hours * HOUR, kept_days * 24 * HOUR), OUT, "Update", "EventTime")
    return found.select("reminder_id", F.timestamp_micros("occurrence").alias("occurrence_time"), "status", "state", "actions")


class Claims(StatefulProcessor):
    """Of the occurrences of a bucket's reminders: the first time that an occurrence was seen, how often, and when last;
    forgotten some time after it was seen last.

    Expiry is by the time of processing and looks at no input, so nothing is too late to be counted.
    """

    def __init__(self, kept: int) -> None:
        self.kept = kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.claims = handle.getValueState("claims", "claims binary", ttlDurationMs=self.kept)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, now = self.claims.get(), timerValues.getCurrentProcessingTimeInMs()
        claims = {k: v for k, v in pickle.loads(bytes(held[0])).items() if v[2] + self.kept > now} if held else {}
        seen = set()
        for b in rows:
            for r, o, first in zip(b["reminder_id"].tolist(), b["occurrence"].tolist(), b["first"].tolist(), strict=True):
                before = claims.get((r, o), (first, 0, now))
                claims[r, o] = (min(before[0], first), before[1] + 1, now)
                seen.add((r, o))
        self.claims.update((pickle.dumps(claims),))
        out = [(*k, *claims[k][:2]) for k in seen]
        yield pd.DataFrame(out, columns=["reminder_id", "occurrence", "first", "times_seen"])


def claimed(firings: DataFrame, kept_days: int) -> DataFrame:
    """reminder_id, occurrence_time, fired_at (the first time of seeing), times_seen: a row whenever these change.

    State is kept by buckets of reminders, read and written once a batch.
    """
    ship(firings.sparkSession)
    seen = F.unix_micros("seen_at").alias("first")
    keyed = firings.select(F.pmod(F.xxhash64("reminder_id"), F.lit(BUCKETS)).alias("bucket"), F.col("reminder_id").cast("long").alias("reminder_id"), F.unix_micros("occurrence_time").alias("occurrence"), seen)
    found = keyed.groupBy("bucket").transformWithStateInPandas(Claims(kept_days * 86_400_000), "reminder_id long, occurrence long, first long, times_seen long", "Update", "ProcessingTime")
    return found.select("reminder_id", F.timestamp_micros("occurrence").alias("occurrence_time"), F.timestamp_micros("first").alias("fired_at"), "times_seen")
