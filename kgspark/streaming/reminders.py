"""Reminders as streams: ticks that fire what is due exactly once, deduplicated firings, a state machine per reminder.

Late firings are flagged, never dropped, over any number of batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import docket
from ..shipping import ship
from ..sources.keyed import KeyedTable
from . import clock

TICK = "60 seconds"


def fired_once(firings: DataFrame, grace_hours: int = docket.GRACE_HOURS, kept_days: int = 10) -> DataFrame:
    """One row per reminder and occurrence, however often its firing is seen, with the first time and whether that was late.

    firings: reminder_id, occurrence_time, seen_at. Works on a stream and on a table alike. A stream has no watermark, so no
    firing is too late, whether the occurrence is long past or the firing itself was seen long before others; an occurrence
    stays in the state for kept_days of processing after it was seen last. Start a stream inside
    `clock.state_store(spark, idle_batches=False)`.
    """
    rows = firings.where(F.col("seen_at") >= F.col("occurrence_time"))
    if rows.isStreaming:
        found = clock.claimed(rows, kept_days)
    else:
        found = rows.groupBy("reminder_id", "occurrence_time").agg(F.min("seen_at").alias("fired_at"), F.count(F.lit(1)).alias("times_seen"))
    late = F.col("fired_at") > F.col("occurrence_time") + F.expr(f"interval {grace_hours} hours")
    return found.withColumn("status", F.when(late, "late_missed").otherwise("fired"))


#: What an action makes of a state; anything not listed leaves it. Done and cancelled stay.
MOVES = {"fire": "sent", "snooze": "snoozed", "acknowledge": "acknowledged", "done": "done", "miss": "missed", "cancel": "cancelled", "rearm": "pending"}
FINAL = ("done", "cancelled")


def step(state: str, action: str) -> str:
    return state if state in FINAL else MOVES.get(action, state)


def reminder_states(actions: DataFrame) -> DataFrame:
    """The state of each reminder after its actions so far, by their time, in whatever order and batches they are seen.

    actions: a stream of reminder_id, at, action. Kept between batches: a reminder's first final action and its last other one.
    """
    ship(actions.sparkSession)

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        final, last, seen = held.get if held.exists else ("", "", 0)
        for batch in batches:
            seen += len(batch)
            # Digits of one length in front: as strings, pairs of time and action are ordered as they are.
            pairs = [f"{at:020d}{action}" for at, action in zip(batch["at"], batch["action"], strict=True)]
            final = min([p for p in [final, *pairs] if MOVES.get(p[20:]) in FINAL], default="")
            last = max([p for p in [last, *pairs] if p[20:] in MOVES and MOVES[p[20:]] not in FINAL], default="")
        held.update((final, last, seen))
        yield pd.DataFrame({"reminder_id": [key[0]], "state": [MOVES.get((final or last)[20:], "pending")], "actions": [seen]})

    rows = actions.select("reminder_id", F.unix_micros(F.col("at").cast("timestamp")).alias("at"), "action")
    return rows.groupBy("reminder_id").applyInPandasWithState(run, "reminder_id long, state string, actions long", "final string, last string, seen long", "update", GroupStateTimeout.NoTimeout)


STATES = "reminder_id long, state string, fire_at timestamp, last_occurrence timestamp"
FIRED = ["reminder_id", "occurrence_time", "state_after", "notification", "next_fire_at"]


def run_ticks(ticks: DataFrame, reminders: DataFrame, events: DataFrame, documents: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Process a stream of ticks (column `now`): each batch fires what is due at its latest tick and wasn't fired before.

    What a batch fires is written once, under its number. Then the states that it leaves, with each reminder's last
    occurrence, are committed to a keyed table, out + "-states", as the version after the batch's number: a batch that runs
    again after a failure finds its version there, and does nothing, or doesn't, and replaces its own rows. So an occurrence
    is fired once, and a tick writes what changes and reads a row for each reminder, not all that ever fired.
    """
    spark = ticks.sparkSession
    states = KeyedTable(spark, f"{out}-states", STATES, ["reminder_id"])

    def fire(batch: DataFrame, number: int) -> None:
        if states.manifest()["version"] > number:
            return
        latest = batch.agg(F.max("now").alias("now")).first()
        known = states.read()
        held = known.select("reminder_id", F.col("state").alias("held_state"), F.col("fire_at").alias("held_fire_at"))
        own = reminders.join(held, "reminder_id", "left").withColumn("state", F.coalesce("held_state", "state")).withColumn("fire_at", F.coalesce("held_fire_at", "fire_at")).drop("held_state", "held_fire_at")
        fired = known.select("reminder_id", F.col("last_occurrence").alias("occurrence_time"))
        due = docket.process_tick(own, events, documents, fired, F.lit(latest.now).cast("timestamp")).select(*FIRED, "fire_at")
        due.write.mode("overwrite").parquet(f"{out}/batch={number}")
        due = spark.read.schema(due.schema).parquet(f"{out}/batch={number}")
        states.upsert(due.select("reminder_id", F.col("state_after").alias("state"), F.coalesce("next_fire_at", "fire_at").alias("fire_at"), F.col("occurrence_time").alias("last_occurrence")))

    writer = ticks.writeStream.foreachBatch(fire).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=TICK)).start()


def occurrence_of(ts: Column, reminder: Column) -> Column:
    """The daily occurrence of a reminder: its own hour of the day."""
    return (F.date_trunc("day", ts).cast("timestamp") + F.make_interval(hours=(reminder % 24).cast("int"))).cast("timestamp")
