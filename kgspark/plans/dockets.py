"""Queries on docket, tenancy and audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import access, docket
from ..sources import calendar
from .fixtures import frame, sql
from .registry import query

NOW = "1998-06-01 12:00:00"
LATE = "2001-01-01 00:00:00"


def text(c: Column | str, name: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name)


T = "strftime({}, '%Y-%m-%d %H:%M:%S')"
PADDED = "case when time_of_day is null then '09:00:00' when length(time_of_day) = 5 then time_of_day || ':00' else time_of_day end"


def fire_sql(starts: str, zone: str, days: str, at: str) -> str:
    return f"((cast(strftime(cast((({starts} at time zone 'UTC') at time zone {zone}) as date) - cast({days} as int), '%Y-%m-%d') || ' ' || {at} as timestamp) at time zone {zone}) at time zone 'UTC')"


FIRE = fire_sql("e.starts_at", "e.timezone", "r.days_before", PADDED)


@query(f"select event_id, {T.format('starts_at')} as starts_at, count(*) over () as total from docket where matter_id = 7 and kind = 'hearing' and starts_at >= timestamp '1996-01-01' order by starts_at, event_id limit 3 offset 1")
def d_list_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docket.list_events(frame(spark, sf_dir, "docket"), 7, kind="hearing", start="1996-01-01 00:00:00", offset=1, limit=3).select("event_id", text("starts_at", "starts_at"), "total")


@query(f"select event_id, case when starts_at < timestamp '{NOW}' then 'Event date is in the past.' end as warning from docket")
def d_past_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "docket").select("event_id", F.when(F.col("starts_at") < docket.ts(NOW), "Event date is in the past.").alias("warning"))


@query(f"select r.reminder_id, {T.format(FIRE)} as fire_at from reminders r join docket e using (event_id) where anchor = 'offset_before_event'")
def d_fire_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "reminders").where("anchor = 'offset_before_event'").join(frame(spark, sf_dir, "docket").select("event_id", "starts_at", "timezone"), "event_id")
    return rows.select("reminder_id", text(docket.fire_time(F.col("starts_at"), F.col("timezone"), F.col("days_before"), F.col("time_of_day")), "fire_at"))


DUE = f"""due as (select r.*, e.starts_at as event_starts_at, case when r.state = 'snoozed' then snoozed_until else fire_at end as occurrence_time from reminders r join docket e using (event_id)
  left join attached a on a.document_id = r.document_id where r.state not in ('done', 'cancelled', 'acknowledged') and e.status not in ('postponed', 'cancelled', 'completed') and coalesce(a.review_status, '') <> 'reviewed'
  and case when r.state = 'snoozed' then snoozed_until else fire_at end <= timestamp '{NOW}')"""
LATE_SQL = f"timestamp '{NOW}' > occurrence_time + interval 2 hours"


@query(f"with {DUE} select reminder_id, {T.format('occurrence_time')} as occurrence_time, case when {LATE_SQL} then 'missed' else 'sent' end as new_state, case when {LATE_SQL} then 'reminder_late' else 'reminder_fired' end as notification from due")
def d_due_reminders(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = docket.due_reminders(frame(spark, sf_dir, "reminders"), frame(spark, sf_dir, "docket"), frame(spark, sf_dir, "attached"), docket.ts(NOW))
    return found.select("reminder_id", text("occurrence_time", "occurrence_time"), "new_state", "notification")


@query(f"select r.reminder_id, case when repeat_rule <> 'none' and not (repeat_rule = 'daily_until_event' and fire_at + interval 24 hours >= starts_at) then {T.format('fire_at + interval 24 hours')} end as next_fire from reminders r join docket using (event_id)")
def d_next_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "reminders").join(frame(spark, sf_dir, "docket").select("event_id", "starts_at"), "event_id")
    return rows.select("reminder_id", text(docket.next_occurrence(F.col("fire_at"), F.col("repeat_rule"), F.col("starts_at")), "next_fire"))


FIRED = "select reminder_id, fire_at as occurrence_time from reminders where reminder_id % 3 = 0"
TICK = f"""with {DUE}, n as (select *, case when repeat_rule <> 'none' and not (repeat_rule = 'daily_until_event' and occurrence_time + interval 24 hours >= event_starts_at) then occurrence_time + interval 24 hours end as next_fire_at
  from due where state in ('pending', 'snoozed', 'sent') and not (reminder_id % 3 = 0 and occurrence_time = fire_at))
  select reminder_id, user_id, {T.format('occurrence_time')} as occurrence_time, case when next_fire_at is not null then 'pending' when {LATE_SQL} then 'missed' else 'sent' end as state_after, {T.format('next_fire_at')} as next_fire_at from n"""


def _tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docket.process_tick(frame(spark, sf_dir, "reminders"), frame(spark, sf_dir, "docket"), frame(spark, sf_dir, "attached"), sql(spark, sf_dir, FIRED), docket.ts(NOW))


@query(TICK)
def d_process_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tick(spark, sf_dir).select("reminder_id", "user_id", text("occurrence_time", "occurrence_time"), "state_after", text("next_fire_at", "next_fire_at"))


@query(f"select * from (with t as ({TICK}) select reminder_id, occurrence_time, reminder_id % 2 = 0 as is_read from t where user_id = '3' order by occurrence_time desc, reminder_id limit 20 offset 5)")
def d_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    fired = _tick(spark, sf_dir)
    read = frame(spark, sf_dir, "reminders").where("reminder_id % 2 = 0").withColumn("occurrence_time", F.when(F.col("state") == "snoozed", F.col("snoozed_until")).otherwise(F.col("fire_at")))
    return docket.notifications(fired, "3", read, offset=5, limit=20).select("reminder_id", text("occurrence_time", "occurrence_time"), "is_read")


REQUESTS = "select event_id, starts_at + interval '400' day as new_starts_at, case when event_id % 8 = 0 then 'America/Denver' else cast(null as string) end as new_timezone from docket where event_id % 5 = 0"
CHOICES = "select reminder_id, case when reminder_id % 4 = 0 then 'cancel' when reminder_id % 4 = 1 then 'shift' else 'keep' end as action, cast(2 as int) as decided_days, '11:00' as decided_time from reminders where reminder_id % 3 <> 0"
CHECKED = f"""q as ({REQUESTS}), ch as ({CHOICES}), ck0 as (select r.reminder_id, r.event_id, r.anchor, r.fire_at, r.state, r.days_before, r.time_of_day, q.new_starts_at, coalesce(q.new_timezone, e.timezone) as zone, ch.action, ch.decided_days
  from reminders r join q using (event_id) join docket e using (event_id) left join ch using (reminder_id) where r.state not in ('cancelled', 'done')),
  ck1 as (select *, case when anchor = 'offset_before_event' then {fire_sql("new_starts_at", "zone", "days_before", PADDED)} else fire_at end as projected_fire_at from ck0),
  ck2 as (select *, case when anchor = 'offset_before_event' and projected_fire_at < timestamp '{NOW}' then 'PROJECTED_FIRE_IN_PAST' when anchor <> 'offset_before_event' and action is null then case when fire_at > new_starts_at then 'SCHEDULED_AFTER_EVENT' else 'FIXED_DATE_CONFIRMATION_REQUIRED' end end as issue from ck1),
  checked as (select *, max(case when issue is not null and action is null then 1 else 0 end) over (partition by event_id) = 1 as event_blocked from ck2)"""


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docket.reschedule_conflicts(sql(spark, sf_dir, REQUESTS), frame(spark, sf_dir, "docket"), frame(spark, sf_dir, "reminders"), sql(spark, sf_dir, CHOICES), docket.ts(NOW))


@query(f"with {CHECKED} select reminder_id, issue, {T.format('projected_fire_at')} as projected_fire_at, event_blocked from checked")
def d_reschedule_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).select("reminder_id", "issue", text("projected_fire_at", "projected_fire_at"), "event_blocked")


@query(f"""with {CHECKED} select reminder_id, {T.format("case when action = 'shift' then " + fire_sql("new_starts_at", "zone", "decided_days", "'11:00:00'") + " when action is null and anchor = 'offset_before_event' then projected_fire_at else fire_at end")} as fire_at,
  case when action = 'cancel' then 'cancelled' when action = 'shift' then 'pending' when action is null and anchor = 'offset_before_event' and state in ('sent', 'missed') then 'pending' else state end as state from checked where not event_blocked""")
def d_reschedule_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docket.reschedule_reminders(_checked(spark, sf_dir)).select("reminder_id", text("fire_at", "fire_at"), "state")


@query(f"""with {CHECKED} select q.event_id, {T.format('new_starts_at')} as starts_at, coalesce(new_timezone, timezone) as timezone, 'rescheduled' as status, sequence + 1 as sequence, kind = 'deadline' as verification_cleared
  from q join docket using (event_id) where event_id not in (select event_id from checked where event_blocked)""")
def d_reschedule_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = docket.reschedule_events(sql(spark, sf_dir, REQUESTS), frame(spark, sf_dir, "docket"), _checked(spark, sf_dir))
    return out.withColumn("starts_at", text("starts_at", "starts_at"))


CHANGES = """select event_id, n.seq as seq, case when n.seq = 0 then case when event_id % 3 = 0 then 'postpone' else 'reschedule' end when n.seq = 1 then 'verify' else case when event_id % 4 = 0 then 'cancel' else 'update' end end as change_type,
  case when n.seq = 0 and event_id % 3 <> 0 then starts_at + interval '30' day end as new_starts_at from docket cross join (select 0 as seq union all select 1 union all select 2) n where event_id % 2 = 1 or n.seq <> 1"""


@query(f"""with c as ({CHANGES}), s as (select event_id, arg_max(case change_type when 'postpone' then 'postponed' when 'cancel' then 'cancelled' when 'reschedule' then 'rescheduled' end, seq) filter (where change_type in ('postpone', 'cancel', 'reschedule')) as ns,
  max(new_starts_at) as nt, count(*) filter (where change_type <> 'verify') as b, max(seq) filter (where change_type = 'verify') as v from c group by 1)
  select event_id, coalesce(ns, status) as status, {T.format('coalesce(nt, starts_at)')} as starts_at, sequence + coalesce(b, 0) as sequence, kind = 'deadline' and v is not null as is_verified from docket left join s using (event_id)""")
def d_event_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docket.event_state(frame(spark, sf_dir, "docket"), sql(spark, sf_dir, CHANGES)).withColumn("starts_at", text("starts_at", "starts_at"))


VERSIONS = """v0 as (select matter_id, display_name, sha256, min(upload_id) as upload_id from uploads group by 1, 2, 3),
  versions as (select *, row_number() over w as version_number, lag(upload_id) over w as prior, lead(upload_id) over w is null as is_current from v0 window w as (partition by matter_id, display_name order by upload_id))"""


@query(f"with {VERSIONS} select matter_id, display_name, upload_id, version_number, coalesce(prior, -1) as supersedes_id, is_current from versions")
def d_doc_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = docket.document_versions(frame(spark, sf_dir, "uploads")).drop("sha256")
    return out.withColumn("version_number", F.col("version_number").cast("long")).na.fill(-1, ["supersedes_id"])


REVIEWS = "select matter_id, display_name, min(upload_id) + 200 as after_upload from uploads where display_name < 'src5' group by 1, 2 union all select matter_id, display_name, max(upload_id) from uploads where display_name like '%3' group by 1, 2"


@query(f"with {VERSIONS}, r as (select matter_id, display_name, max(after_upload) as a from ({REVIEWS}) group by 1, 2) select matter_id, display_name, case when a is null then 'to_review' when upload_id > a then 'changed_since_review' else 'reviewed' end as review_status from versions left join r using (matter_id, display_name) where is_current")
def d_doc_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docket.review_after_upload(docket.document_versions(frame(spark, sf_dir, "uploads")), sql(spark, sf_dir, REVIEWS))


NEW = "select reminder_id as request_id, case when reminder_id % 31 = 0 then -1 else event_id end as event_id, matter_id, case when reminder_id % 7 = 0 then -5 else document_id end as document_id, anchor, days_before, time_of_day, case when reminder_id % 13 = 0 then cast(null as timestamp) else fire_at end as fire_at from reminders"


@query(f"""with n as ({NEW}), f as (select n.*, e.event_id is not null as he, d.document_id is not null as hd, case when anchor = 'offset_before_event' then {fire_sql("e.starts_at", "e.timezone", "n.days_before", PADDED)} else fire_at end as fires
  from n left join docket e on e.event_id = n.event_id and e.matter_id = n.matter_id left join attached d on d.document_id = n.document_id and d.event_id = n.event_id and d.matter_id = n.matter_id)
  select request_id, case when not he then 'EVENT_NOT_FOUND' when document_id is not null and not hd then 'DOCUMENT_NOT_OF_EVENT' when fires is null then 'FIRE_AT_REQUIRED' when fires < timestamp '{NOW}' then 'IN_THE_PAST' else 'OK' end as outcome from f""")
def d_reminder_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docket.check_new_reminder(sql(spark, sf_dir, NEW), frame(spark, sf_dir, "docket"), frame(spark, sf_dir, "attached"), docket.ts(NOW)).select("request_id", "outcome")


ACTIONS = "select reminder_id, case reminder_id % 3 when 0 then 'snooze' when 1 then 'acknowledge' else 'done' end as action, case when reminder_id % 2 = 0 then fire_at else cast(null as timestamp) end as snooze_until from reminders where reminder_id % 5 = 0"


@query(f"""with a as ({ACTIONS}) select reminder_id, case when action = 'snooze' then case when snooze_until > timestamp '{NOW}' then 'snoozed' else state end when action = 'acknowledge' then 'acknowledged' else 'done' end as state,
  action = 'snooze' and not coalesce(snooze_until > timestamp '{NOW}', false) as refused from reminders join a using (reminder_id)""")
def d_reminder_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docket.act_on_reminder(frame(spark, sf_dir, "reminders"), sql(spark, sf_dir, ACTIONS), docket.ts(NOW))


@query(f"""select 'event' as item_type, event_id as id, {T.format('starts_at')} as "timestamp", false as is_missed from docket where matter_id = 12 and starts_at between timestamp '{NOW}' and timestamp '{LATE}'
  union all select 'reminder', reminder_id, {T.format('fire_at')}, state = 'missed' from reminders where matter_id = 12 and user_id in ('4') and (state = 'missed' or (state in ('pending', 'snoozed') and fire_at between timestamp '{NOW}' and timestamp '{LATE}'))""")
def d_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = docket.agenda(frame(spark, sf_dir, "docket"), frame(spark, sf_dir, "reminders"), 12, "4", docket.ts(NOW), docket.ts(LATE))
    return out.withColumn("timestamp", text("timestamp", "timestamp"))


DAYS = f"cast(floor((epoch(starts_at) - epoch(timestamp '{NOW}')) / 86400.0 + 0.5) as int)"


@query(f"select event_id, case when d = 0 then 'Today' when d = 1 then 'Tomorrow' when d = -1 then 'Yesterday' when d > 0 then 'In ' || d || ' days' else abs(d) || ' days ago' end as label from (select event_id, {DAYS} as d from docket)")
def d_relative_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "docket").select("event_id", docket.relative_label(F.col("starts_at"), docket.ts(NOW)).alias("label"))


@query(f"with c as ({CHANGES}) select event_id, seq, change_type from c")
def d_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of every event, the latest first."""
    return sql(spark, sf_dir, CHANGES).select("event_id", "seq", "change_type").orderBy("event_id", F.desc("seq"))


@query("""select e.event_id, coalesce((select string_agg(display_name || ':' || review_status, ',' order by document_id) from attached a where a.event_id = e.event_id), '') as documents,
  coalesce((select string_agg(reminder_id || ':' || state, ',' order by reminder_id) from reminders r where r.event_id = e.event_id), '') as reminders from docket e""")
def d_event_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = docket.event_detail(frame(spark, sf_dir, "docket"), frame(spark, sf_dir, "attached"), frame(spark, sf_dir, "reminders"))
    d = F.array_join(F.transform("documents", lambda x: F.concat_ws(":", x["display_name"], x["review_status"])), ",")
    r = F.array_join(F.transform("reminders", lambda x: F.concat_ws(":", x["reminder_id"].cast("string"), x["state"])), ",")
    return out.select("event_id", F.coalesce(d, F.lit("")).alias("documents"), F.coalesce(r, F.lit("")).alias("reminders"))


def _ics(redact: bool) -> str:
    room = "case when courtroom is not null then court_name || '\\, Room ' || courtroom else court_name end"
    where = "case when kind = 'hearing' then 'Redacted Court Location' end" if redact else f"case when kind = 'hearing' then {room} end"
    more = "case when kind = 'hearing' then '\\nLocation details redacted.' else '' end" if redact else "case when kind = 'hearing' and judge is not null then '\\nJudge: ' || judge else '' end || case when notes is not null then '\\nNotes: ' || notes else '' end"
    more = more.replace("\\n", "\\\\n")
    return f"""select event_id, concat_ws(chr(10), 'BEGIN:VEVENT', 'UID:docket-event-' || event_id || '@kgspark.local', 'SEQUENCE:' || sequence, 'DTSTART:' || strftime(starts_at, '%Y%m%dT%H%M%SZ'), 'DTEND:' || strftime(starts_at + interval 1 hour, '%Y%m%dT%H%M%SZ'),
      'STATUS:' || case when status = 'cancelled' then 'CANCELLED' when status in ('scheduled', 'rescheduled') then 'CONFIRMED' else 'TENTATIVE' end, 'SUMMARY:[' || upper(kind) || '] ' || title, 'LOCATION:' || {where},
      'DESCRIPTION:Matter: ' || matter_id || '\\\\nType: ' || kind || '\\\\nStatus: ' || status || {more}, 'END:VEVENT') as ics from docket"""


@query(_ics(False))
def d_ics_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.ics_events(frame(spark, sf_dir, "docket")).select("event_id", "ics")


@query(_ics(True))
def d_ics_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.ics_events(frame(spark, sf_dir, "docket"), redact=True).select("event_id", "ics")


@query(f"select event_id, {T.format('starts_at')} as starts_at from docket where matter_id = 9 and starts_at >= timestamp '{NOW}'")
def d_ics_upcoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.upcoming(frame(spark, sf_dir, "docket"), 9, docket.ts(NOW)).select("event_id", text("starts_at", "starts_at"))


ASKED = """select c_custkey + case when u.i = 3 then 1000000 else 0 end as matter_id, cast((c_custkey + u.i) % 20 as string) as user_id, case u.i when 0 then 'read' when 1 then 'write' else 'audit' end as action
  from customer cross join (select 0 as i union all select 1 union all select 2 union all select 3) u"""


@query(f"""with a as ({ASKED}) select a.matter_id, a.user_id, a.action, case when t.matter_id is null then 404 when m.role is null then 403 when a.action = 'write' and m.role = 'viewer' then 403
  when a.action = 'audit' and m.role not in ('owner', 'attorney') then 403 else 200 end as status_code from a left join matters t using (matter_id) left join members m on m.matter_id = a.matter_id and m.user_id = a.user_id""")
def p_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.decide(sql(spark, sf_dir, ASKED), frame(spark, sf_dir, "matters"), frame(spark, sf_dir, "members")).drop("role")


@query("select matter_id, name, role from matters join members using (matter_id) where user_id = '5' order by matter_id desc limit 20 offset 10")
def j_user_matters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.user_matters(frame(spark, sf_dir, "matters"), frame(spark, sf_dir, "members"), "5", 10, 20).select("matter_id", "name", "role")


@query("select matter_id, user_id, case when user_no = 0 then 'owner' when user_no = 1 and matter_id % 2 = 0 then 'viewer' else role end as role from members")
def p_member_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = frame(spark, sf_dir, "members").select("matter_id", "user_id", "role")
    first = members.where("user_id = '0'").withColumn("role", F.lit("owner")).withColumn("at", F.lit(0))
    second = members.where("user_id = '1'").withColumn("role", F.when(F.col("matter_id") % 2 == 0, "viewer").otherwise(F.col("role"))).withColumn("at", F.lit(1))
    return access.upsert_members(members, first.union(second))


LOG = "select event_id * 3 + seq as audit_id, event_id % 50 as matter_id, 'event' as target_type, event_id as target_id, change_type as action, event_id * 3 + seq as logged_at from ({}) c"


@query(f"select audit_id, target_id, action from ({LOG.format(CHANGES)}) where matter_id = 11 order by logged_at desc, audit_id desc limit 25 offset 5")
def p_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.audit_page(sql(spark, sf_dir, LOG.format(CHANGES)), 11, "event", 5, 25).select("audit_id", "target_id", "action")
