from datetime import datetime, timedelta

from pyspark.sql import functions as F

from kgspark.operators import docket
from kgspark.sources.keyed import KeyedTable
from kgspark.streaming import clock, reminders

from .test_docket import DOCS, EVENTS, REMINDERS, ts


def source(spark, tmp_path, rows, schema, name):
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/{name}")


def test_ticks_fire_once_like_the_batch(spark, tmp_path):
    events = spark.createDataFrame([(1, 1, "hearing", "H", ts("2026-11-05 15:00:00"), "UTC", "scheduled", 0)], EVENTS)
    rem = [(i, 1, 1, None, "u", "fixed_datetime", None, None, ts("2026-08-01 11:00:00") + timedelta(hours=i), "pending", None, "none") for i in range(6)]
    own = spark.createDataFrame(rem, REMINDERS)
    none = spark.createDataFrame([], DOCS)
    ticks = source(spark, tmp_path, [[(datetime(2026, 8, 1, 12),)], [(datetime(2026, 8, 1, 12),)], [(datetime(2026, 8, 1, 14),)]], "now timestamp", "ticks")
    for _ in range(2):  # the second run starts from the checkpoint: nothing fires again
        reminders.run_ticks(ticks, own, events, none, f"{tmp_path}/out", f"{tmp_path}/check", once=True).awaitTermination()
    fired = spark.read.parquet(f"{tmp_path}/out").select("reminder_id", "occurrence_time")
    assert sorted(r.reminder_id for r in fired.collect()) == [0, 1, 2, 3]
    states = KeyedTable(spark, f"{tmp_path}/out-states", reminders.STATES, ["reminder_id"])
    assert states.manifest()["version"] == 3 and {(r.reminder_id, r.state) for r in states.read().collect()} == {(0, "sent"), (1, "sent"), (2, "sent"), (3, "sent")}
    batch = docket.process_tick(own, events, none, spark.createDataFrame([], "reminder_id long, occurrence_time timestamp"), docket.ts("2026-08-01 14:00:00"))
    assert sorted(r.reminder_id for r in batch.collect()) == sorted(r.reminder_id for r in fired.collect())


def test_a_tick_that_runs_again_fires_nothing_twice(spark, tmp_path, monkeypatch):
    events = spark.createDataFrame([(1, 1, "hearing", "H", ts("2026-11-05 15:00:00"), "UTC", "scheduled", 0)], EVENTS)
    rem = [(i, 1, 1, None, "u", "fixed_datetime", None, None, ts("2026-08-01 11:00:00"), "pending", None, "daily_until_event") for i in range(3)]
    ticks = source(spark, tmp_path, [[(datetime(2026, 8, 1, 12),)], [(datetime(2026, 8, 2, 12),)], [(datetime(2026, 8, 2, 12, 1),)]], "now timestamp", "ticks")
    once = lambda: reminders.run_ticks(ticks, spark.createDataFrame(rem, REMINDERS), events, spark.createDataFrame([], DOCS), f"{tmp_path}/out", f"{tmp_path}/check", once=True).awaitTermination()
    upsert, calls = KeyedTable.upsert, []

    def killed(self, rows, before):
        calls.append(1)
        if len(calls) == 2:  # the second tick dies: before or after its states are committed
            if not before:
                upsert(self, rows)
            raise RuntimeError("killed")
        return upsert(self, rows)

    for before in (True, False):
        calls.clear()
        with monkeypatch.context() as m:
            m.setattr(KeyedTable, "upsert", lambda self, rows: killed(self, rows, before))  # noqa: B023
            try:
                once()
            except Exception as e:  # noqa: BLE001
                assert "killed" in str(e)
    once()
    fired = sorted((r.reminder_id, r.occurrence_time) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert fired == sorted((i, datetime(2026, 8, d, 11)) for i in range(3) for d in (1, 2))


def test_states_over_batches(spark, tmp_path):
    t = datetime(2026, 1, 1)
    parts = [[(1, t + timedelta(2), "fire"), (2, t, "fire")], [(1, t + timedelta(1), "snooze"), (2, t + timedelta(1), "done")], [(1, t, "fire"), (2, t + timedelta(2), "fire"), (2, t + timedelta(2), "cancel")]]
    stream = reminders.reminder_states(source(spark, tmp_path, parts, "reminder_id long, at timestamp, action string", "actions"))
    seen = []
    stream.writeStream.outputMode("update").foreachBatch(lambda b, n: seen.extend((n, *r) for r in b.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    last = {r[1]: r[2:] for r in sorted(seen)}
    assert last == {1: ("sent", 3), 2: ("done", 4)}


def test_firings_are_one_per_occurrence(spark):
    t = datetime(2026, 1, 1, 9)
    rows = [(1, t, t + timedelta(hours=5)), (1, t, t + timedelta(hours=1)), (2, t, t + timedelta(hours=3)), (3, t, t - timedelta(hours=1))]
    got = reminders.fired_once(spark.createDataFrame(rows, "reminder_id long, occurrence_time timestamp, seen_at timestamp")).select("reminder_id", "times_seen", "status").orderBy("reminder_id").collect()
    assert [tuple(r) for r in got] == [(1, 2, "fired"), (2, 1, "late_missed")]
    assert reminders.step("done", "fire") == "done" and reminders.step("pending", "?") == "pending"
    assert reminders.step("sent", "miss") == "missed" and reminders.step("missed", "acknowledge") == "acknowledged"
    assert F is not None


def run(stream, tmp_path, keep, idle_batches=True):
    with clock.state_store(stream.sparkSession, idle_batches):
        stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert stream.sparkSession.conf.get(clock.PROVIDER, None) != clock.ROCKS


def test_late_firings_come_out_over_batches(spark, tmp_path):
    t = datetime(2026, 1, 1, 9)
    parts = [
        [(1, t, t + timedelta(minutes=1))],
        [(2, t + timedelta(days=1), t + timedelta(days=1, hours=3)), (1, t, t + timedelta(days=1))],
        [(3, t, t + timedelta(days=31)), (4, t + timedelta(days=31), t + timedelta(days=31))],
        [(3, t, t + timedelta(days=32)), (5, t - timedelta(days=400), t + timedelta(days=32)), (6, t + timedelta(days=2), t + timedelta(days=2, hours=3)), (1, t, t)],
    ]
    stream = reminders.fired_once(source(spark, tmp_path, parts, "reminder_id long, occurrence_time timestamp, seen_at timestamp", "firings"))
    seen = []
    run(stream, tmp_path, lambda b, n: seen.extend((n, r.reminder_id, r.times_seen, r.status) for r in b.collect()), False)
    last = {r[1]: r[2:] for r in sorted(seen)}
    # The last batch's sixth was seen thirty days behind the newest, and late.
    assert last == {1: (3, "fired"), 2: (1, "late_missed"), 3: (2, "late_missed"), 4: (1, "fired"), 5: (1, "late_missed"), 6: (1, "late_missed")}
    assert len({r[0] for r in seen}) == 4


ACTIONS = "reminder_id long, at timestamp, action string, until timestamp"


def clocked(spark, tmp_path, parts, **kept):
    """Run batches of (actions, ticks); the last row of each occurrence, the last state of each reminder, and all rows."""
    rows = [[(*a, None) for a in acts] + [(None, None, None, None, t) for t in ticks] for acts, ticks in parts]
    both = source(spark, tmp_path, rows, f"{ACTIONS}, now timestamp", "both")
    stream = clock.reminder_clock(both.where("reminder_id is not null"), both.where("now is not null"), **kept)
    seen = []
    run(stream, tmp_path, lambda b, n: seen.extend((n, r.reminder_id, r.occurrence_time, r.status, r.state) for r in b.collect()))
    return {r[1:3]: r[3] for r in seen if r[2]}, {r[1]: r[4] for r in seen}, seen


def test_timers_fire_snoozes_and_miss_what_nobody_claims(spark, tmp_path):
    t = datetime(2026, 1, 1, 9)
    h = lambda n: t + timedelta(hours=n)
    parts = [
        ([(1, h(0), "arm", h(4)), (2, h(0), "arm", h(1)), (3, h(0), "arm", h(1)), (4, h(0), "arm", h(50)), (5, h(0), "arm", h(1))], [h(0)]),
        ([(2, h(1.5), "snooze", h(8)), (3, h(2), "claim", None), (5, h(2), "done", None)], [h(2.5)]),
        ([(5, h(3), "arm", h(4))], [h(5)]),
        ([], [h(6.5)]),
        ([], [h(8.5)]),
        ([], [h(30)]),
    ]
    firings, states, seen = clocked(spark, tmp_path, parts)
    assert firings == {(1, h(4)): "late_missed", (2, h(1)): "fired", (2, h(8)): "late_missed", (3, h(1)): "fired", (5, h(1)): "fired"}
    assert states == {1: "missed", 2: "missed", 3: "sent", 4: "pending", 5: "done"}
    # By timer, with no action of theirs in the batch: fired first, missed once the grace was over.
    assert [r[3] for r in seen if r[1] == 1 and r[2]] == ["fired", "late_missed"] and [r[3] for r in seen if r[2] == h(8)] == ["fired", "late_missed"]


def test_actions_seen_late_take_back_what_they_make_wrong(spark, tmp_path):
    t = datetime(2026, 1, 1, 9)
    h = lambda n: t + timedelta(hours=n)
    parts = [
        ([(1, h(0), "arm", h(4)), (2, h(0), "arm", h(4))], [h(0)]),
        ([], [h(100)]),
        ([], [h(100.5)]),
        ([(1, h(5), "acknowledge", None), (2, h(1), "cancel", None), (3, h(2), "arm", h(3))], [h(101)]),
        ([], [h(102)]),
    ]
    firings, states, seen = clocked(spark, tmp_path, parts)
    assert firings == {(1, h(4)): "fired", (2, h(4)): "retracted", (3, h(3)): "late_missed"}
    assert states == {1: "acknowledged", 2: "cancelled", 3: "missed"}
    assert [r[3] for r in seen if r[1] == 1 and r[2]][-2:] == ["late_missed", "fired"]


def test_settled_actions_leave_the_list(spark, tmp_path):
    t = datetime(2026, 1, 1, 9)
    d = lambda n: t + timedelta(days=n)
    parts = [([(1, d(0), "arm", d(1))], [d(0)]), ([], [d(30)]), ([(1, d(2), "snooze", d(40))], [d(31)]), ([], [d(41)])]
    firings, states, _ = clocked(spark, tmp_path, parts, kept_days=5)
    assert firings == {(1, d(1)): "late_missed", (1, d(40)): "late_missed"} and states == {1: "missed"}
