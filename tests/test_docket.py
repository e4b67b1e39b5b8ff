import pytest
from pyspark.sql import functions as F

from kgspark.operators import access, docket
from kgspark.sources import calendar

EVENTS = "event_id long, matter_id long, kind string, title string, starts_at timestamp, timezone string, status string, sequence int"
REMINDERS = "reminder_id long, event_id long, matter_id long, document_id long, user_id string, anchor string, days_before int, time_of_day string, fire_at timestamp, state string, snoozed_until timestamp, repeat_rule string"
DOCS = "document_id long, event_id long, matter_id long, display_name string, review_status string"
NOW = "2026-08-01 12:00:00"


def ts(text):
    from datetime import datetime

    return datetime.fromisoformat(text)


@pytest.fixture
def events(spark):
    return spark.createDataFrame([(1, 1, "hearing", "H", ts("2026-11-05 15:00:00"), "America/New_York", "scheduled", 0), (2, 1, "deadline", "D", ts("2026-08-02 12:00:00"), "Nowhere/Land", "postponed", 0), (3, 1, "deadline", "E", ts("2026-08-02 11:00:00"), "UTC", "scheduled", 3)], EVENTS)


@pytest.fixture
def reminders(spark):
    rem = lambda i, event, fire, state, doc=None, snooze=None, rule="none": (i, event, 1, doc, "u", "fixed_datetime", None, None, ts(fire), state, ts(snooze) if snooze else None, rule)
    return spark.createDataFrame(
        [
            rem(1, 1, "2026-08-01 11:45:00", "pending"),
            rem(2, 1, "2026-08-01 07:00:00", "pending"),
            rem(3, 2, "2026-08-01 11:00:00", "pending"),
            rem(4, 1, "2026-08-01 11:00:00", "done"),
            rem(5, 1, "2026-08-01 11:00:00", "pending", doc=10),
            rem(6, 1, "2026-07-01 11:00:00", "snoozed", snooze="2026-08-01 13:00:00"),
            rem(7, 1, "2026-07-01 11:00:00", "snoozed", snooze="2026-08-01 10:00:00"),
            rem(8, 3, "2026-08-01 11:00:00", "sent", rule="daily_until_event"),
            rem(9, 1, "2026-08-01 11:00:00", "sent", doc=11, rule="daily_until_done"),
            rem(10, 99, "2026-08-01 11:00:00", "pending"),
            rem(11, 1, "2026-08-01 11:00:00", "missed"),
        ],
        REMINDERS,
    )


@pytest.fixture
def documents(spark):
    return spark.createDataFrame([(10, 1, 1, "a", "reviewed"), (11, 1, 1, "b", "changed_since_review")], DOCS)


@pytest.mark.parametrize(
    ("starts", "zone", "days", "at", "want"),
    [
        ("2026-11-05 15:00:00", "America/New_York", 7, "09:00", "2026-10-29 13:00:00"),  # over the change to winter time
        ("2026-11-05 15:00:00", "America/New_York", 0, None, "2026-11-05 14:00:00"),
        ("2026-03-09 02:00:00", "America/New_York", 0, "02:30", "2026-03-08 07:30:00"),  # an hour that doesn't exist
        ("2026-11-01 12:00:00", "America/New_York", 0, "01:30", "2026-11-01 05:30:00"),  # an hour that comes twice
        ("2026-11-05 15:00:00", "Nowhere/Land", 1, "14:15:30", "2026-11-04 14:15:30"),
    ],
)
def test_fire_time(spark, starts, zone, days, at, want):
    row = spark.createDataFrame([(ts(starts), zone, days, at)], "s timestamp, z string, d int, t string")
    assert row.select(docket.fire_time(F.col("s"), F.col("z"), F.col("d"), F.col("t")).cast("string").alias("x")).first().x == want


def test_due_and_late(events, reminders, documents):
    got = {r.reminder_id: (r.new_state, r.notification) for r in docket.due_reminders(reminders, events, documents, docket.ts(NOW)).collect()}
    assert got == {1: ("sent", "reminder_fired"), 2: ("missed", "reminder_late"), 7: ("sent", "reminder_fired"), 8: ("sent", "reminder_fired"), 9: ("sent", "reminder_fired"), 11: ("sent", "reminder_fired")}


def test_a_tick_fires_once_and_rearms(spark, events, reminders, documents):
    none = spark.createDataFrame([], "reminder_id long, occurrence_time timestamp")
    first = docket.process_tick(reminders, events, documents, none, docket.ts(NOW))
    got = {r.reminder_id: (r.state_after, str(r.next_fire_at)) for r in first.collect()}
    assert set(got) == {1, 2, 7, 8, 9}
    assert got[8] == ("sent", "None") and got[9] == ("pending", "2026-08-02 11:00:00") and got[2][0] == "missed"
    assert docket.process_tick(reminders, events, documents, first.select("reminder_id", "occurrence_time"), docket.ts(NOW)).count() == 0


def test_reschedule(spark, events, reminders):
    requests = spark.createDataFrame([(1, ts("2026-12-01 15:00:00"), None)], "event_id long, new_starts_at timestamp, new_timezone string")
    offset = reminders.where("reminder_id = 1").withColumn("anchor", F.lit("offset_before_event")).withColumn("days_before", F.lit(2)).withColumn("state", F.lit("sent"))
    fixed = reminders.where("reminder_id = 2")
    none = spark.createDataFrame([], "reminder_id long, action string, decided_days int, decided_time string")
    checked = docket.reschedule_conflicts(requests, events, offset.union(fixed), none, docket.ts(NOW))
    assert {r.reminder_id: (r.issue, r.event_blocked) for r in checked.collect()} == {1: (None, True), 2: ("FIXED_DATE_CONFIRMATION_REQUIRED", True)}
    assert docket.reschedule_events(requests, events, checked).count() == 0
    keep = spark.createDataFrame([(2, "shift", 3, "10:00")], none.schema)
    checked = docket.reschedule_conflicts(requests, events, offset.union(fixed), keep, docket.ts(NOW))
    got = {r.reminder_id: (str(r.fire_at), r.state, r.anchor) for r in docket.reschedule_reminders(checked).collect()}
    assert got == {1: ("2026-11-29 14:00:00", "pending", "offset_before_event"), 2: ("2026-11-28 15:00:00", "pending", "offset_before_event")}
    done = docket.reschedule_events(requests, events, checked).first()
    assert (done.status, done.sequence, done.verification_cleared) == ("rescheduled", 1, False)


def test_versions(spark):
    uploads = spark.createDataFrame([(1, 1, "a", "x"), (2, 1, "a", "x"), (3, 1, "a", "y"), (4, 1, "b", "x")], "upload_id long, matter_id long, display_name string, sha256 string")
    versions = docket.document_versions(uploads)
    assert sorted((r.display_name, r.version_number, r.upload_id, r.supersedes_id, r.is_current) for r in versions.collect()) == [("a", 1, 1, None, False), ("a", 2, 3, 1, True), ("b", 1, 4, None, True)]
    reviews = spark.createDataFrame([(1, "a", 2)], "matter_id long, display_name string, after_upload long")
    assert {r.display_name: r.review_status for r in docket.review_after_upload(versions, reviews).collect()} == {"a": "changed_since_review", "b": "to_review"}


def test_agenda_and_labels(spark, events, reminders):
    rows = docket.agenda(events, reminders, 1, "u", docket.ts("2026-08-01 10:00:00"), docket.ts("2026-08-03 00:00:00")).collect()
    assert [(r.item_type, r.id) for r in rows] == [("reminder", 3), ("reminder", 5), ("reminder", 10), ("reminder", 11), ("reminder", 1), ("event", 3), ("event", 2)]
    assert [r.is_missed for r in rows] == [False, False, False, True, False, False, False]
    label = lambda t: spark.range(1).select(docket.relative_label(docket.ts(t), docket.ts(NOW)).alias("x")).first().x
    assert [label(t) for t in ("2026-08-01 13:00:00", "2026-08-02 12:00:00", "2026-07-31 12:00:00", "2026-08-05 12:00:00", "2026-07-20 12:00:00")] == ["Today", "Tomorrow", "Yesterday", "In 4 days", "12 days ago"]


def test_calendar(events):
    text = calendar.ics_events(events.withColumns({c: F.lit("x, y") for c in ("court_name", "courtroom", "judge", "notes")})).where("event_id = 1").first().ics
    assert "DTSTART:20261105T150000Z\nDTEND:20261105T160000Z" in text and "LOCATION:x\\, y\\, Room x\\, y" in text and "STATUS:CONFIRMED" in text
    hidden = calendar.ics_events(events.withColumns({c: F.lit("secret") for c in ("court_name", "courtroom", "judge", "notes")}), redact=True).where("event_id = 1").first().ics
    assert "secret" not in hidden and "Redacted" in hidden


def test_access(spark):
    matters = spark.createDataFrame([(1,)], "matter_id long")
    members = spark.createDataFrame([(1, "v", "viewer"), (1, "o", "owner"), (1, "p", "paralegal")], "matter_id long, user_id string, role string")
    asked = [(2, "o", "read"), (1, "x", "read"), (1, "v", "read"), (1, "v", "write"), (1, "p", "write"), (1, "p", "audit"), (1, "o", "audit")]
    got = {(r.matter_id, r.user_id, r.action): r.status_code for r in access.decide(spark.createDataFrame(asked, "matter_id long, user_id string, action string"), matters, members).collect()}
    assert [got[a] for a in asked] == [404, 403, 200, 403, 200, 403, 200]


def test_audit_is_append_only(spark, tmp_path):
    row = spark.createDataFrame([(1, 1)], "audit_id long, matter_id long")
    access.append_audit(f"{tmp_path}/log", row)
    access.append_audit(f"{tmp_path}/log", row)
    assert spark.read.parquet(f"{tmp_path}/log").count() == 2
    assert not [n for n in dir(access) if any(w in n for w in ("overwrite", "delete", "truncate"))]
