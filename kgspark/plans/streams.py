"""Queries that run a stream over the events table to its end and read what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder
from ..streaming import channel, clock, reminders
from .registry import query


#: Files of a day that make a batch.
DAYS = 6


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of several batches: a file for each day, in no order of time."""
    events, at = spark.read.parquet(f"{sf_dir}/events.parquet"), f"{shared_folder(spark, "stream")}/in"
    events.withColumn("day", F.md5(F.to_date("ts").cast("string"))).repartition("day").write.partitionBy("day").parquet(at)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", DAYS).option("recursiveFileLookup", "true").parquet(at)


def _finished(stream: DataFrame, mode: str, idle_batches: bool = True) -> DataFrame:
    """Run to the end; every batch's rows are written under its number, so a batch that runs twice counts once."""
    spark, at = stream.sparkSession, shared_folder(stream.sparkSession, "stream")
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")
    with clock.state_store(spark, idle_batches):
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{at}/out")


OCCURRENCE = "date_trunc('day', ts) + to_hours(cast(user_id % 24 as int))"


@query(f"""with f as (select user_id as reminder_id, {OCCURRENCE} as o, ts from events where ts >= {OCCURRENCE}) select reminder_id, strftime(o, '%Y-%m-%d %H:%M:%S') as occurrence_time, count(*) as times_seen,
  case when min(ts) > o + interval 2 hours then 'late_missed' else 'fired' end as status from f group by reminder_id, o""")
def w_fired_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("reminder_id"), reminders.occurrence_of(F.col("ts"), F.col("user_id")).alias("occurrence_time"), F.col("ts").cast("timestamp").alias("seen_at"))
    out = _finished(reminders.fired_once(rows), "update", idle_batches=False)
    last = out.groupBy("reminder_id", "occurrence_time").agg(F.max_by(F.struct("times_seen", "status"), "batch").alias("x"))
    return last.select("reminder_id", F.date_format("occurrence_time", "yyyy-MM-dd HH:mm:ss").alias("occurrence_time"), "x.times_seen", "x.status")


ACTION = "case event_type when 'view' then 'fire' when 'click' then 'snooze' when 'error' then 'rearm' else 'acknowledge' end"


@query(f"""with f as (select user_id as reminder_id, {OCCURRENCE} - to_days(cast(user_id % 40 as int)) as o, ts from events)
  select reminder_id, strftime(o, '%Y-%m-%d %H:%M:%S') as occurrence_time, count(*) as times_seen from f where ts >= o group by reminder_id, o having min(ts) > o + interval 2 hours""")
def w_late_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences up to forty days before they are seen, in batches of days in no order: each late one comes out, flagged."""
    occurrence = (reminders.occurrence_of(F.col("ts"), F.col("user_id")) - F.make_dt_interval((F.col("user_id") % 40).cast("int"))).cast("timestamp")
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("reminder_id"), occurrence.alias("occurrence_time"), F.col("ts").cast("timestamp").alias("seen_at"))
    out = _finished(reminders.fired_once(rows), "update", idle_batches=False)
    last = out.groupBy("reminder_id", "occurrence_time").agg(F.max_by(F.struct("times_seen", "status"), "batch").alias("x"))
    return last.where("x.status = 'late_missed'").select("reminder_id", F.date_format("occurrence_time", "yyyy-MM-dd HH:mm:ss").alias("occurrence_time"), "x.times_seen")


@query("""with a as (select user_id as reminder_id, ts, case event_type when 'view' then 'sent' when 'click' then 'snoozed' when 'error' then 'pending' else 'acknowledged' end as state from events)
  select reminder_id, arg_max(state, ts) as state, count(*) as actions from a group by 1""")
def w_reminder_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("reminder_id"), F.col("ts").alias("at"), F.expr(ACTION).alias("action"))
    out = _finished(reminders.reminder_states(rows), "update")
    return out.groupBy("reminder_id").agg(F.max_by("state", "batch").alias("state"), F.max("actions").alias("actions"))


def _clock_actions(hours: str) -> list[str]:
    """Actions on ten reminders for each user: arm, snooze (in part into the past), claim, acknowledge and, now and then, done."""
    return [
        "user_id * 10 + event_id % 10 as reminder_id",
        "ts as seen",
        "case event_id % 6 when 0 then 'arm' when 1 then 'arm' when 2 then 'snooze' when 3 then 'claim' when 4 then 'acknowledge' else case when event_id % 11 = 0 then 'done' else 'claim' end end as action",
        f"case when event_id % 6 < 2 then ts + {hours.format('event_id % 31')} when event_id % 6 = 2 then ts + {hours.format('event_id % 23 - 3')} end as to_time",
    ]


@query(f"""with recursive a as (select {", ".join(_clock_actions("to_hours(cast({} as int))"))} from events),
  e as (select reminder_id, seen, action, to_time from a union all select distinct reminder_id, date_trunc('milliseconds', (select max(ts) from events)), 'tick', cast(null as timestamp) from a),
  o as (select *, row_number() over (partition by reminder_id order by seen, action, to_time nulls first) as k from e),
  r as (
    select distinct reminder_id, cast(0 as bigint) as k, 'pending' as state, cast(null as timestamp) as target, cast(null as timestamp) as open, cast(null as timestamp) as fired, cast(null as timestamp) as missed from a
    union all
    select reminder_id, k,
      case when s in ('done', 'cancelled') then s when action = 'arm' then 'pending' when action = 'snooze' and to_time > seen then 'snoozed' when action = 'acknowledge' then 'acknowledged' when action = 'done' then 'done' else s end,
      case when s in ('done', 'cancelled') then t when action = 'arm' or action = 'snooze' and to_time > seen then to_time when action in ('acknowledge', 'done') then null else t end,
      case when s in ('done', 'cancelled') then w when action in ('arm', 'acknowledge', 'done') or action = 'snooze' and to_time > seen or action = 'claim' and s = 'sent' then null else w end, fired, missed
    from (select *, case when missed is not null then 'missed' when fired is not null then 'sent' else state end as s, case when fired is null then target end as t, case when missed is null then coalesce(fired, open) end as w
      from (select *, case when coalesce(fired, open) + interval 2 hours < seen then coalesce(fired, open) end as missed
        from (select o.reminder_id, o.k, o.seen, o.action, o.to_time, r.state, r.target, r.open, case when r.target <= o.seen then r.target end as fired from r join o on o.reminder_id = r.reminder_id and o.k = r.k + 1)))),
  f as (select reminder_id, fired as occurrence, 'fired' as status from r where fired is not null union all select reminder_id, missed, 'late_missed' from r where missed is not null),
  g as (select reminder_id, occurrence, max(status) as status from f group by 1, 2), z as (select reminder_id, arg_max(state, k) as state, max(k) - 1 as actions from r group by 1)
  select z.reminder_id, strftime(occurrence, '%Y-%m-%d %H:%M:%S') as occurrence_time, status, state, actions from z left join g on z.reminder_id = g.reminder_id""")
def w_reminder_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timers over batches of days in no order: what every occurrence came to, and the state that each reminder is left in."""
    events = _events(spark, sf_dir)
    actions = events.selectExpr(*_clock_actions("make_interval(0, 0, 0, 0, cast({} as int), 0, 0)")).withColumnsRenamed({"seen": "at", "to_time": "until"})
    out = _finished(clock.reminder_clock(actions, events.select(F.col("ts").alias("now")), kept_days=40), "update")
    last = out.groupBy("reminder_id").agg(F.max_by("state", "batch").alias("state"), F.max("actions").alias("actions"))
    firings = out.where("occurrence_time is not null").groupBy("reminder_id", "occurrence_time").agg(F.max_by("status", "batch").alias("status")).where("status <> 'retracted'")
    return last.join(firings, "reminder_id", "left").select("reminder_id", F.date_format("occurrence_time", "yyyy-MM-dd HH:mm:ss").alias("occurrence_time"), "status", "state", "actions")


@query("select cast(user_id as string) as user_id, count(*) as unread, min(cast(event_id as bigint)) as first_id from events where event_type <> 'error' group by 1")
def w_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notifications sent through a channel over several batches, then what each user has unread."""
    rows = _events(spark, sf_dir).where("event_type <> 'error'")
    rows = rows.select(F.col("event_id").cast("string").alias("notification_id"), F.col("user_id").cast("string").alias("user_id"), F.concat(F.lit("Reminder: "), "event_type").alias("title"), F.col("ts").cast("timestamp").alias("created_at"))
    at = shared_folder(spark, "stream")
    inbox = channel.InApp(spark, f"{at}/inbox")
    channel.deliver(rows, inbox, f"{at}/state", once=True).awaitTermination()
    return inbox.sent().where("not is_read").groupBy("user_id").agg(F.count(F.lit(1)).alias("unread"), F.min(F.col("notification_id").cast("long")).alias("first_id"))
