"""Queries on background jobs: an order is a job, its lines are the stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import jobs
from .fixtures import sql
from .registry import query

# Each line is a stage of as many seconds as its quantity; the last step depends on the order's status.
LOG = """select o_orderkey as job_id, cast(0 as bigint) as seq, cast(0 as bigint) as sec, 'queued' as step, cast(null as string) as stage, cast(0 as bigint) as entities, cast(null as string) as error from orders
  union all select okey, cast(line as bigint) * 2, cast(line as bigint) * 100, 'begin', 'stage ' || flag || status, cast(0 as bigint), null from lines
  union all select okey, cast(line as bigint) * 2 + 1, cast(line as bigint) * 100 + cast(qty as bigint), 'end', 'stage ' || flag || status, cast(0 as bigint), null from lines
  union all select o_orderkey, cast(90 as bigint), cast(900 as bigint), case o_orderstatus when 'F' then 'finished' else 'failed' end, 'Complete', cast(o_orderkey % 5 as bigint), case o_orderstatus when 'F' then null else 'broken' end from orders where o_orderstatus <> 'O'"""


@query(f"""with log as ({LOG.replace("as string", "as varchar")}), l as (select job_id, arg_max(step, seq) as step, arg_max(coalesce(stage, ''), seq) as stage, arg_max(entities, seq) as entities, arg_max(coalesce(error, ''), seq) as error, max(sec) - min(sec) as total from log group by 1),
  s as (select job_id, stage, min(seq) as first, max(sec) filter (where step = 'end') - min(sec) filter (where step = 'begin') as secs from log where step in ('begin', 'end') group by 1, 2),
  t as (select job_id, string_agg(stage || '=' || cast(secs as bigint), ',' order by first) as stages from s group by 1)
  select job_id, case when step = 'failed' then 'FAILED' when step = 'finished' and entities = 0 then 'PARTIAL' when step = 'finished' then 'SUCCESS' when step = 'queued' then 'PENDING' else 'PROCESSING' end as status,
    case when step = 'queued' then 'Queued' else stage end as stage, error, cast(total as bigint) as total_secs, coalesce(stages, '') as stages from l left join t using (job_id)""")
def w_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = sql(spark, sf_dir, LOG).withColumn("at", F.timestamp_seconds("sec")).drop("sec")
    again = log.where("step = 'end'")  # steps that were written twice
    found = jobs.job_states(log.union(again))
    stages = F.array_join(F.transform("stages", lambda x: F.concat_ws("=", x["stage"], x["secs"].cast("long").cast("string"))), ",")
    return found.select("job_id", "status", "stage", F.coalesce("error", F.lit("")).alias("error"), F.col("total_secs").cast("long").alias("total_secs"), stages.alias("stages"))
