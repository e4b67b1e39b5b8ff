"""Background jobs as a log of steps: status, stage and timings of each job after the steps so far.

A job is PENDING until its first stage begins, PROCESSING until its last step, then SUCCESS, PARTIAL (nothing was extracted)
or FAILED. The log only grows, so a job's record is a fold over its rows, and a step that is written twice counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What a log row can be.
QUEUED, BEGIN, END, FINISHED, FAILED = "queued", "begin", "end", "finished", "failed"


def job_states(log: DataFrame) -> DataFrame:
    """job_id, status, stage, error, created_at, updated_at, total_secs, stages (stage to seconds).

    log: job_id, seq, at (timestamp), step, stage, entities (of a finished job), error (of a failed one).
    """
    rows = log.dropDuplicates(["job_id", "seq"])
    secs = lambda a, b: F.unix_micros(b) / 1e6 - F.unix_micros(a) / 1e6
    stages = rows.where(F.col("step").isin(BEGIN, END)).groupBy("job_id", "stage").agg(
        F.min(F.when(F.col("step") == BEGIN, F.col("at"))).alias("a"), F.max(F.when(F.col("step") == END, F.col("at"))).alias("b"), F.min("seq").alias("first")
    )
    timed = stages.where("a is not null and b is not null").groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("first", "stage", F.round(secs("a", "b"), 2).alias("secs")))).alias("s"))
    last = F.max_by(F.struct("step", "stage", "entities", "error"), "seq")
    jobs = rows.groupBy("job_id").agg(last.alias("l"), F.min("at").alias("created_at"), F.max("at").alias("updated_at"))
    status = (
        F.when(F.col("l.step") == FAILED, "FAILED")
        .when((F.col("l.step") == FINISHED) & (F.coalesce("l.entities", F.lit(0)) == 0), "PARTIAL")
        .when(F.col("l.step") == FINISHED, "SUCCESS")
        .when(F.col("l.step") == QUEUED, "PENDING")
        .otherwise("PROCESSING")
    )
    stage = F.when(F.col("l.step") == QUEUED, "Queued").otherwise(F.col("l.stage"))
    out = jobs.join(timed, "job_id", "left")
    return out.select("job_id", status.alias("status"), stage.alias("stage"), "l.error", "created_at", "updated_at", F.round(secs("created_at", "updated_at"), 2).alias("total_secs"), F.transform(F.coalesce("s", F.array().cast("array<struct<first:long,stage:string,secs:double>>")), lambda x: F.struct(x["stage"], x["secs"])).alias("stages"))
