"""iCalendar sink: one text block per event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRODUCT, UID_HOST = "-//kgspark//Docket//EN", "kgspark.local"


def ics_events(events: DataFrame, redact: bool = False) -> DataFrame:
    """event_id and its VEVENT. A stable UID and the sequence let a client replace what it has; the end is an hour later.

    redact leaves out court, judge, and notes. The time stamp is left to the caller, who knows `now`.
    """
    stamp = lambda c: F.date_format(c, "yyyyMMdd'T'HHmmss'Z'")
    status = F.when(F.col("status") == "cancelled", "CANCELLED").when(F.col("status").isin("scheduled", "rescheduled"), "CONFIRMED").otherwise("TENTATIVE")
    hearing = F.col("kind") == "hearing"
    text = lambda label, c: F.concat(F.lit(f"{label}: "), c.cast("string"))
    parts = [text("Matter", F.col("matter_id")), text("Type", F.col("kind")), text("Status", F.col("status"))]
    if redact:
        location = F.when(hearing, "Redacted Court Location")
        parts.append(F.when(hearing, "Location details redacted."))
    else:
        location = F.when(hearing & F.col("court_name").isNotNull(), F.concat("court_name", F.coalesce(F.concat(F.lit(", Room "), "courtroom"), F.lit(""))))
        parts += [F.when(hearing & F.col("judge").isNotNull(), text("Judge", F.col("judge"))), F.when(F.col("notes").isNotNull(), text("Notes", F.col("notes")))]
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit(","), F.lit("\\,")), F.lit(";"), F.lit("\\;"))
    lines = [
        F.lit("BEGIN:VEVENT"),
        F.concat(F.lit("UID:docket-event-"), F.col("event_id").cast("string"), F.lit(f"@{UID_HOST}")),
        F.concat(F.lit("SEQUENCE:"), F.col("sequence").cast("string")),
        F.concat(F.lit("DTSTART:"), stamp("starts_at")),
        F.concat(F.lit("DTEND:"), stamp(F.col("starts_at") + F.expr("interval 1 hour"))),
        F.concat(F.lit("STATUS:"), status),
        F.concat(F.lit("SUMMARY:"), escape(F.concat(F.lit("["), F.upper("kind"), F.lit("] "), F.col("title")))),
        F.concat(F.lit("LOCATION:"), escape(location)),
        F.concat(F.lit("DESCRIPTION:"), escape(F.concat_ws("\\n", *parts))),
        F.lit("END:VEVENT"),
    ]
    return events.select("event_id", "starts_at", F.concat_ws("\n", *lines).alias("ics"))


def upcoming(events: DataFrame, matter_id: int, now: F.Column) -> DataFrame:
    """A matter's events from `now` on, by start."""
    return events.where((F.col("matter_id") == matter_id) & (F.col("starts_at") >= now)).orderBy("starts_at", "event_id")
