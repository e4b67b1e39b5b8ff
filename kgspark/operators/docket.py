"""Docket operators: events, reminders with time-zone-correct firing, rescheduling, document versions, agenda.

`now` is always an argument. Times are UTC timestamps; a fire time is computed on the court's own calendar, so it keeps its
local hour across a change of daylight saving. Zones that Spark doesn't know count as UTC.
"""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRACE_HOURS, PAGE = 2, 50
FINISHED = ["done", "cancelled", "acknowledged"]
PAUSING = ["postponed", "cancelled", "completed"]
#: IANA names, a fixed list of some 600.
ZONES = sorted(z for z in available_timezones() if "/" in z or z in ("UTC", "GMT", "EST", "MST", "HST"))


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def known_zone(zone: Column) -> Column:
    return F.when(zone.isin(ZONES), zone).otherwise("UTC")


def time_of_day(text: Column) -> Column:
    """HH:MM or HH:MM:SS as HH:MM:SS; nine o'clock without one."""
    parts = F.split(F.trim(text), ":")
    second = F.when(F.size(parts) >= 3, F.get(parts, F.lit(2))).otherwise("0")
    full = F.format_string("%02d:%02d:%02d", F.get(parts, F.lit(0)).try_cast("int"), F.get(parts, F.lit(1)).try_cast("int"), second.try_cast("int"))
    return F.when((F.coalesce(text, F.lit("")) == "") | (F.size(parts) < 2), "09:00:00").otherwise(full)


def fire_time(starts_at: Column, zone: Column, days_before: Column, at: Column) -> Column:
    """The UTC time, some days before the event's local day, at a local time of day."""
    z = known_zone(zone)
    day = F.date_sub(F.to_date(F.from_utc_timestamp(starts_at, z)), days_before)
    local = F.try_to_timestamp(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" "), time_of_day(at)), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.to_utc_timestamp(local, z)


def next_occurrence(fired: Column, rule: Column, starts_at: Column) -> Column:
    """24 hours later; none without a rule, or once the event has come under daily_until_event."""
    following = fired + F.expr("interval 24 hours")
    return F.when((rule != "none") & ~((rule == "daily_until_event") & (following >= starts_at)), following)


def list_events(events: DataFrame, matter_id: int, kind: str | None = None, status: str | None = None, start: str | None = None, end: str | None = None, offset: int = 0, limit: int = PAGE) -> DataFrame:
    """A page of a matter's events by start, and the total on every row."""
    rows = events.where(F.col("matter_id") == matter_id)
    for column, value in (("kind", kind), ("status", status)):
        if value:
            rows = rows.where(F.col(column) == value)
    if start:
        rows = rows.where(F.col("starts_at") >= ts(start))
    if end:
        rows = rows.where(F.col("starts_at") <= ts(end))
    total = rows.agg(F.count(F.lit(1)).alias("total"))  # one row
    return rows.orderBy("starts_at", "event_id").offset(offset).limit(limit).crossJoin(F.broadcast(total))


def due_reminders(reminders: DataFrame, events: DataFrame, documents: DataFrame, now: Column, states: list[str] | None = None, grace_hours: int = GRACE_HOURS) -> DataFrame:
    """Reminders due at `now`, with occurrence_time, new_state and notification: late beyond the grace.

    Finished reminders, those of paused or missing events and of reviewed documents don't fire. states: only reminders in
    these (the tick leaves out missed ones, the plain computation doesn't).
    """
    rows = reminders.where(F.col("state").isin(states)) if states else reminders.where(~F.col("state").isin(FINISHED))
    target = F.when(F.col("state") == "snoozed", F.col("snoozed_until")).otherwise(F.col("fire_at"))
    rows = rows.withColumn("occurrence_time", target).where(F.col("occurrence_time") <= now)
    own = events.where(~F.col("status").isin(PAUSING)).select("event_id", F.col("starts_at").alias("event_starts_at"), F.col("title").alias("event_title"))
    reviewed = documents.where("review_status = 'reviewed'").select("document_id")
    rows = rows.join(own, "event_id").join(reviewed, "document_id", "left_anti")
    late = now > F.col("occurrence_time") + F.expr(f"interval {grace_hours} hours")
    return rows.withColumn("new_state", F.when(late, "missed").otherwise("sent")).withColumn("notification", F.when(late, "reminder_late").otherwise("reminder_fired"))


def process_tick(reminders: DataFrame, events: DataFrame, documents: DataFrame, occurrences: DataFrame, now: Column) -> DataFrame:
    """What one tick fires: reminders due whose occurrence wasn't fired before, the state and time that each has afterwards.

    Running a tick twice fires nothing twice: occurrences (reminder_id, occurrence_time) is the state.
    """
    due = due_reminders(reminders, events, documents, now, ["pending", "snoozed", "sent"])
    fresh = due.join(occurrences.select("reminder_id", "occurrence_time"), ["reminder_id", "occurrence_time"], "left_anti")
    following = next_occurrence(F.col("occurrence_time"), F.col("repeat_rule"), F.col("event_starts_at"))
    return fresh.withColumn("next_fire_at", following).withColumn("state_after", F.when(F.col("next_fire_at").isNotNull(), "pending").otherwise(F.col("new_state")))


def reschedule_conflicts(requests: DataFrame, events: DataFrame, reminders: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """Every active reminder of a rescheduled event with its projected fire time, issue (null: none), the decision on it,
    and event_blocked: whether any issue of the event is undecided, in which case nothing is applied.

    requests: event_id, new_starts_at, new_timezone (null: unchanged). decisions: reminder_id, action, decided_days,
    decided_time.
    """
    own = requests.join(events.select("event_id", "timezone", "starts_at", "kind", "sequence"), "event_id").withColumn("zone", F.coalesce("new_timezone", "timezone"))
    rows = reminders.where(~F.col("state").isin("cancelled", "done")).join(own.select("event_id", "new_starts_at", "zone"), "event_id").join(decisions, "reminder_id", "left")
    offset = F.col("anchor") == "offset_before_event"
    projected = F.when(offset, fire_time(F.col("new_starts_at"), F.col("zone"), F.coalesce("days_before", F.lit(1)), F.col("time_of_day"))).otherwise(F.col("fire_at"))
    rows = rows.withColumn("projected_fire_at", projected)
    issue = F.when(offset & (F.col("projected_fire_at") < now), "PROJECTED_FIRE_IN_PAST").when(
        ~offset & F.col("action").isNull(), F.when(F.col("fire_at") > F.col("new_starts_at"), "SCHEDULED_AFTER_EVENT").otherwise("FIXED_DATE_CONFIRMATION_REQUIRED")
    )
    rows = rows.withColumn("issue", issue)
    open_issue = F.when(F.col("issue").isNotNull() & F.col("action").isNull(), 1).otherwise(0)
    return rows.withColumn("event_blocked", F.max(open_issue).over(Window.partitionBy("event_id")) == 1)


def reschedule_reminders(checked: DataFrame) -> DataFrame:
    """Reminders after the reschedules that go through: kept, cancelled, shifted, or moved with the event and re-armed."""
    action, offset = F.col("action"), F.col("anchor") == "offset_before_event"
    shifted = fire_time(F.col("new_starts_at"), F.col("zone"), F.coalesce("decided_days", F.lit(1)), F.col("decided_time"))
    moves = action.isNull() & offset
    return checked.where("not event_blocked").select(
        "reminder_id",
        "event_id",
        F.when(action == "shift", shifted).when(moves, F.col("projected_fire_at")).otherwise(F.col("fire_at")).alias("fire_at"),
        F.when(action == "cancel", "cancelled").when(action == "shift", "pending").when(moves & F.col("state").isin("sent", "missed"), "pending").otherwise(F.col("state")).alias("state"),
        F.when(action == "shift", "offset_before_event").otherwise(F.col("anchor")).alias("anchor"),
    )


def reschedule_events(requests: DataFrame, events: DataFrame, checked: DataFrame) -> DataFrame:
    """Events after the reschedules that go through: new start, sequence + 1; a deadline has to be verified again."""
    blocked = checked.where("event_blocked").select("event_id").distinct()
    own = requests.join(blocked, "event_id", "left_anti").join(events, "event_id")
    return own.select("event_id", F.col("new_starts_at").alias("starts_at"), F.coalesce("new_timezone", "timezone").alias("timezone"), F.lit("rescheduled").alias("status"), (F.col("sequence") + 1).alias("sequence"), (F.col("kind") == "deadline").alias("verification_cleared"))


def event_state(events: DataFrame, changes: DataFrame) -> DataFrame:
    """Events after a log of changes (event_id, seq, change_type, new_starts_at): the last change of status and the last new
    start count, every change but a verification raises the sequence; a reschedule clears the verification before it."""
    kind = F.col("change_type")
    status = F.when(kind == "postpone", "postponed").when(kind == "cancel", "cancelled").when(kind == "reschedule", "rescheduled")
    folded = changes.groupBy("event_id").agg(
        F.max_by(status, F.when(status.isNotNull(), F.col("seq"))).alias("new_status"),
        F.max_by("new_starts_at", F.when(F.col("new_starts_at").isNotNull(), F.col("seq"))).alias("new_starts_at"),
        F.count_if(kind != "verify").alias("bumps"),
        F.max(F.when(kind == "verify", F.col("seq"))).alias("verified"),
        F.max(F.when(kind == "reschedule", F.col("seq"))).alias("moved"),
    )
    verified = F.coalesce((F.col("kind") == "deadline") & (F.col("verified") > F.coalesce("moved", F.lit(-1))), F.lit(False))
    return events.join(folded, "event_id", "left").select("event_id", F.coalesce("new_status", "status").alias("status"), F.coalesce("new_starts_at", "starts_at").alias("starts_at"), (F.col("sequence") + F.coalesce("bumps", F.lit(0))).alias("sequence"), verified.alias("is_verified"))


def document_versions(uploads: DataFrame) -> DataFrame:
    """The version chain of each logical document (matter_id, display_name): uploads in order, a content that the document
    has already is no version; number, predecessor, which is current, and whether a reviewed document has changed since."""
    key = ["matter_id", "display_name"]
    first = uploads.groupBy(*key, "sha256").agg(F.min("upload_id").alias("upload_id"))
    w = Window.partitionBy(*key).orderBy("upload_id")
    return first.select(*key, "upload_id", "sha256", F.row_number().over(w).alias("version_number"), F.lag("upload_id").over(w).alias("supersedes_id"), F.lead("upload_id").over(w).isNull().alias("is_current"))


def review_after_upload(versions: DataFrame, reviews: DataFrame) -> DataFrame:
    """Review status of each document: to_review, reviewed, or changed_since_review where a version followed the review.
    reviews: matter_id, display_name, after_upload (the upload that was reviewed)."""
    key = ["matter_id", "display_name"]
    last = versions.where("is_current").select(*key, F.col("upload_id").alias("current_upload"))
    done = reviews.groupBy(*key).agg(F.max("after_upload").alias("after_upload"))
    out = last.join(done, key, "left")
    return out.select(*key, F.when(F.col("after_upload").isNull(), "to_review").when(F.col("current_upload") > F.col("after_upload"), "changed_since_review").otherwise("reviewed").alias("review_status"))


def check_new_reminder(requests: DataFrame, events: DataFrame, documents: DataFrame, now: Column) -> DataFrame:
    """requests (request_id, event_id, matter_id, document_id, anchor, days_before, time_of_day, fire_at) with the fire time
    and `outcome`: OK or why a reminder is refused."""
    own = events.select("event_id", "matter_id", "starts_at", "timezone", F.lit(True).alias("has_event"))
    docs = documents.select("document_id", "event_id", "matter_id", F.lit(True).alias("has_document"))
    offset = F.col("anchor") == "offset_before_event"
    at = F.when(offset, fire_time(F.col("starts_at"), F.col("timezone"), F.coalesce("days_before", F.lit(1)), F.col("time_of_day"))).otherwise(F.col("fire_at"))
    # The time is known before documents are looked up, so that what it is made of isn't shuffled again.
    rows = requests.join(own, ["event_id", "matter_id"], "left").withColumn("fires_at", at)
    rows = rows.join(docs, ["document_id", "event_id", "matter_id"], "left")
    outcome = (
        F.when(F.col("has_event").isNull(), "EVENT_NOT_FOUND")
        .when(F.col("document_id").isNotNull() & F.col("has_document").isNull(), "DOCUMENT_NOT_OF_EVENT")
        .when(F.col("fires_at").isNull(), "FIRE_AT_REQUIRED")
        .when(F.col("fires_at") < now, "IN_THE_PAST")
        .otherwise("OK")
    )
    return rows.withColumn("outcome", outcome)


def act_on_reminder(reminders: DataFrame, actions: DataFrame, now: Column) -> DataFrame:
    """Reminders after one action each (reminder_id, action, snooze_until); a snooze must end in the future, else refused."""
    rows = reminders.join(actions, "reminder_id")
    refused = (F.col("action") == "snooze") & ~F.coalesce(F.col("snooze_until") > now, F.lit(False))
    state = F.when(refused, F.col("state")).when(F.col("action") == "snooze", "snoozed").when(F.col("action") == "acknowledge", "acknowledged").when(F.col("action") == "done", "done").otherwise(F.col("state"))
    return rows.select("reminder_id", state.alias("state"), refused.alias("refused"))


def agenda(events: DataFrame, reminders: DataFrame, matter_id: int, user_id: str, start: Column, end: Column) -> DataFrame:
    """Events in a span, the user's due reminders in it, and all the user's missed ones, by time."""
    e = events.where((F.col("matter_id") == matter_id) & F.col("starts_at").between(start, end)).select(F.lit("event").alias("item_type"), F.col("event_id").alias("id"), F.col("starts_at").alias("timestamp"), F.lit(False).alias("is_missed"))
    own = reminders.where((F.col("matter_id") == matter_id) & (F.col("user_id") == user_id))
    r = own.where(F.col("state").isin("pending", "snoozed") & F.col("fire_at").between(start, end) | (F.col("state") == "missed"))
    r = r.select(F.lit("reminder").alias("item_type"), F.col("reminder_id").alias("id"), F.col("fire_at").alias("timestamp"), (F.col("state") == "missed").alias("is_missed"))
    return e.union(r).orderBy("timestamp", "item_type", "id")


def relative_label(at: Column, now: Column) -> Column:
    days = F.floor((F.unix_seconds(at) - F.unix_seconds(now)) / 86400.0 + 0.5).cast("int")
    return (
        F.when(days == 0, "Today")
        .when(days == 1, "Tomorrow")
        .when(days == -1, "Yesterday")
        .when(days > 0, F.concat(F.lit("In "), days.cast("string"), F.lit(" days")))
        .otherwise(F.concat(F.abs(days).cast("string"), F.lit(" days ago")))
    )


def notifications(fired: DataFrame, user_id: str, read: DataFrame, matter_id: int | None = None, unread_only: bool = False, offset: int = 0, limit: int = PAGE) -> DataFrame:
    """A page of the user's own notifications, newest first. fired: process_tick's rows. read: reminder_id, occurrence_time."""
    rows = fired.where(F.col("user_id") == user_id)
    if matter_id is not None:
        rows = rows.where(F.col("matter_id") == matter_id)
    seen = read.select("reminder_id", "occurrence_time", F.lit(True).alias("__read"))
    rows = rows.join(seen, ["reminder_id", "occurrence_time"], "left").withColumn("is_read", F.coalesce("__read", F.lit(False))).drop("__read")
    if unread_only:
        rows = rows.where("not is_read")
    return rows.orderBy(F.desc("occurrence_time"), "reminder_id").offset(offset).limit(limit)


def event_detail(events: DataFrame, documents: DataFrame, reminders: DataFrame) -> DataFrame:
    """Events with their documents and reminders nested, sorted by id."""
    d = documents.groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("document_id", "display_name", "review_status"))).alias("documents"))
    r = reminders.groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("reminder_id", "state"))).alias("reminders"))
    return events.join(d, "event_id", "left").join(r, "event_id", "left")
