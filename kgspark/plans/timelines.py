"""Queries on dates and timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import temporal
from .fixtures import frame, sql
from .registry import query

# Spellings of a day by `form`; the twin reads the columns, never the text.
TEXTS = """select id, form, case form when 0 then mname || ' ' || cast(dd as string) || ', ' || cast(y as string) when 1 then cast(dd as string) || 'th day of ' || mname || ', ' || cast(y as string) when 2 then iso
  when 3 then cast(m as string) || '/' || cast(dd as string) || '/' || cast(y as string) when 4 then upper(mname) || ' ' || cast(y as string) when 5 then 'in ' || cast(y as string)
  when 6 then 'from ' || iso || ' through ' || mname || ' ' || cast(dd as string) || ', ' || cast(y + 1 as string) when 7 then 'February ' || cast(dd % 3 + 29 as string) || ', ' || cast(y as string) else 'sometime around ' || mname end as text, iso, m, dd, y from date_texts"""
LEAP = "(y % 4 = 0 and (y % 100 <> 0 or y % 400 = 0))"
SECOND = "'02-' || cast(dd % 3 + 29 as string)"
ISO = f"case when form = 6 and m = 2 and dd = 29 then cast(y + 1 as string) || '-02-29' when form in (0, 1, 2, 3, 6) then iso when form = 4 then substr(iso, 1, 7) when form = 5 then cast(y as string) when form = 7 then cast(y as string) || '-' || {SECOND} end"


@query("select id, y * 10000 + m * 100 + dd as ymd, (m <> 2 or dd <= 28 or (dd = 29 and " + LEAP + ")) as ok from (select id, y, case when id % 3 = 0 then 2 else m end as m, dd from date_texts) where (case when m in (4, 6, 9, 11) then dd <= 30 else true end)")
def m_date_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "date_texts").withColumn("m", F.when(F.col("id") % 3 == 0, 2).otherwise(F.col("m"))).where("case when m in (4, 6, 9, 11) then dd <= 30 else true end")
    return rows.select("id", (F.col("y") * 10000 + F.col("m") * 100 + F.col("dd")).alias("ymd"), dates.is_calendar_date(F.col("y"), F.col("m"), F.col("dd")).alias("ok"))


@query(f"""select id, {ISO} as iso_value, case when form in (0, 1, 2, 3, 6, 7) then 'EXACT_DAY' when form = 4 then 'MONTH' when form = 5 then 'YEAR' else 'UNKNOWN_PARTIAL' end as precision,
  case when form = 8 or (form = 6 and m = 2 and dd = 29) then false when form = 7 then dd % 3 = 0 and {LEAP} else true end as is_valid from date_texts""")
def m_normalize_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, TEXTS).select("id", dates.normalize_date(F.col("text")).alias("d")).select("id", "d.iso_value", "d.precision", "d.is_valid")


@query("select id, iso as start_date, cast(y + 1 as string) || substr(iso, 5) as end_date from date_texts where form = 6 and not (m = 2 and dd = 29)")
def m_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sql(spark, sf_dir, TEXTS).where("form = 6 and not (m = 2 and dd = 29)")
    return rows.select("id", dates.normalize_date(F.col("text")).alias("d")).select("id", "d.start_date", "d.end_date")


ENTITIES = """select 'O' || cast(o_orderkey as string) as id, 'd_' || cast(o_custkey as string) as document_id, case o_orderkey % 6 when 0 then 'HEARING' when 1 then 'FILING' when 2 then 'PERSON' when 3 then 'DEADLINE' when 4 then 'COURT' else 'CASE' end as entity_type, 'Entity ' || cast(o_orderkey as string) as name, o_orderkey as pos from orders
  union all select 'D' || cast(o_orderkey as string), 'd_' || cast(o_custkey as string), 'DATE', iso, o_orderkey from orders join date_texts on id = o_orderkey"""
LINKS = """select 'L' || cast(o_orderkey as string) as id, 'O' || cast(o_orderkey as string) as source_id, 'D' || cast(o_orderkey as string) as target_id, 'OCCURRED_ON' as relationship_type, o_orderkey * 2 as pos from orders where o_orderkey % 4 <> 2
  union all select 'M' || cast(o_orderkey as string), 'O' || cast(o_orderkey as string), 'D' || cast(o_orderkey + 1 as string), 'HAS_DEADLINE', o_orderkey * 2 + 1 from orders where o_orderkey % 3 = 0
  union all select 'N' || cast(o_orderkey as string), 'O' || cast(o_orderkey as string), 'O' || cast(o_orderkey + 1 as string), case when o_orderkey % 2 = 0 then 'BEFORE' else 'CITES' end, o_orderkey * 2 from orders"""
DATED = f"""ent as ({ENTITIES}), lnk as ({LINKS}), dated as (select source_id as id, arg_max(e.name, l.pos) as iso_value from lnk l join ent e on e.id = l.target_id and e.entity_type = 'DATE'
  where relationship_type in ('OCCURRED_ON', 'HAS_DEADLINE') group by 1)"""
EVENTS = f"{DATED}, ev as (select e.*, d.iso_value from ent e left join dated d using (id) where entity_type <> 'DATE' and (entity_type in ({', '.join(map(repr, temporal.SUBSTANTIVE))}) or d.id is not null))"


@query(f"with {DATED} select id, iso_value, 'EXACT_DAY' as precision from dated")
def m_event_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.event_dates(sql(spark, sf_dir, LINKS), sql(spark, sf_dir, ENTITIES)).select("id", "iso_value", "precision")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = sql(spark, sf_dir, ENTITIES)
    return temporal.timeline(entities, temporal.event_dates(sql(spark, sf_dir, LINKS), entities))


@query(f"with {EVENTS} select document_id, id, entity_type as event_type, entity_type || ': ' || name as description, iso_value as event_date, case when iso_value is null then 'UNKNOWN_PARTIAL' else 'EXACT_DAY' end as date_precision, 'RESOLVED' as temporal_status from ev")
def m_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).drop("start_date", "end_date", "pos")


@query(f"with {EVENTS} select l.id, relationship_type, source_id, target_id from lnk l join ev s on s.id = source_id join ev t on t.id = target_id where relationship_type in ('BEFORE', 'AFTER', 'HAS_DEADLINE', 'OCCURRED_ON', 'OCCURRED_IN')")
def m_edges_explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.explicit_edges(sql(spark, sf_dir, LINKS), _events(spark, sf_dir)).select("id", "relationship_type", "source_id", "target_id")


@query("""select document_id, source_event_id, target_event_id from (select document_id, event_id as source_event_id, event_date, lead(event_id) over w as target_event_id, lead(event_date) over w as next_date
  from timeline where event_date is not null and temporal_status = 'RESOLVED' window w as (partition by document_id order by event_date, pos)) where next_date <> event_date""")
def m_infer_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.inferred_before(frame(spark, sf_dir, "timeline")).select("document_id", "source_event_id", "target_event_id")


@query("""select event_id, row_number() over (partition by document_id order by case when coalesce(event_date, start_date) is null then 1 else 0 end, coalesce(event_date, start_date, ''),
  case when coalesce(event_date, start_date) is null then coalesce(source_page, 9999) else coalesce(source_page, 0) end, span_start, pos) as place from timeline""")
def m_sort_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.sorted_timeline(frame(spark, sf_dir, "timeline")).select("event_id", F.col("place").cast("long").alias("place"))


PAGES = """select 'd_' || cast(o_custkey as string) as document_id, cast(o_orderkey as int) as page_number, case o_orderkey % 7 when 0 then 'Reply is due within ' || cast(o_orderkey % 40 + 1 as string) || ' days of the hearing as set.' when 1 then 'Served two weeks later by mail.'
  when 2 then 'File within 14 days or else.' when 3 then 'Motions heard before the hearing were denied.' when 4 then 'some days after notice' when 5 then 'Counsel called yesterday.' else 'Nothing of note.' end as text, o_orderkey % 7 as form, o_orderkey as pos from orders"""
PARSED = f"""expr as (select document_id, page_number, case form when 0 then 'AFTER' when 1 then 'AFTER' when 2 then 'AFTER' when 3 then 'BEFORE' else 'OFFSET' end as direction,
  cast(case form when 0 then pos % 40 + 1 when 1 then 14 when 2 then 14 when 5 then -1 end as int) as delta_days, case when form in (0, 3) then 'HEARING' end as reference from ({PAGES}) where form in (0, 1, 2, 3, 5))"""


@query(f"with {PARSED} select * replace (coalesce(delta_days, 0) as delta_days) from expr")
def m_parse_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.relative_expressions(sql(spark, sf_dir, PAGES)).drop("raw_text").na.fill(0, ["delta_days"])


@query(f"""with {PARSED}, j as (select e.*, t.event_id, t.event_date, row_number() over (partition by e.document_id, page_number order by case when reference is null then -pos else pos end) as rn
  from expr e left join timeline t on t.document_id = e.document_id and t.event_date is not null and (reference is null or contains(t.event_type, reference) or contains(upper(t.description), reference))),
  r as (select *, strftime(try_strptime(event_date, '%Y-%m-%d') + to_days(case when direction = 'BEFORE' then -coalesce(delta_days, 0) else coalesce(delta_days, 0) end), '%Y-%m-%d') as resolved_date from j where rn = 1)
  select document_id, page_number, case when resolved_date is not null then event_id end as anchor_id, resolved_date, case when resolved_date is null then 'REVIEW_REQUIRED' else 'RESOLVED' end as temporal_status from r""")
def m_resolve_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = temporal.resolve_relative(temporal.relative_expressions(sql(spark, sf_dir, PAGES)), frame(spark, sf_dir, "timeline"))
    return found.select("document_id", "page_number", "anchor_id", "resolved_date", "temporal_status")


# An event that is named is one of the timeline's; without a name, what the last page before came to counts, if any did.
@query(f"""with recursive {PARSED}, j as (select e.*, t.event_id, t.event_date, row_number() over (partition by e.document_id, page_number order by case when reference is null then -pos else pos end) as rn
  from expr e left join timeline t on t.document_id = e.document_id and t.event_date is not null and (reference is null or contains(t.event_type, reference) or contains(upper(t.description), reference))),
  b as (select document_id, page_number, reference, event_id, case when direction = 'BEFORE' then -coalesce(delta_days, 0) else coalesce(delta_days, 0) end as step, try_strptime(event_date, '%Y-%m-%d') as day, row_number() over (partition by document_id order by page_number) as k from j where rn = 1),
  f as (select document_id, page_number, k, case when day is not null then event_id end as anchor_id, day + to_days(cast(step as int)) as resolved, day + to_days(cast(step as int)) as held, case when day is not null then page_number end as held_page from b where k = 1
    union all select b.document_id, b.page_number, b.k, case when b.reference is null and held is not null then 'derived_' || b.document_id || '_' || cast(held_page as string) when b.day is not null then b.event_id end,
      case when b.reference is null and held is not null then held else b.day end + to_days(cast(b.step as int)), coalesce(case when b.reference is null and held is not null then held else b.day end + to_days(cast(b.step as int)), held),
      case when b.reference is null and held is not null or b.day is not null then b.page_number else held_page end from f join b on b.document_id = f.document_id and b.k = f.k + 1)
  select document_id, page_number, anchor_id, strftime(resolved, '%Y-%m-%d') as resolved_date, case when resolved is null then 'REVIEW_REQUIRED' else 'RESOLVED' end as temporal_status from f""")
def m_derived_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in order, resolved expressions serving as anchors of later ones."""
    found = temporal.derived_events(temporal.relative_expressions(sql(spark, sf_dir, PAGES)), frame(spark, sf_dir, "timeline"))
    return found.select("document_id", "page_number", "anchor_id", "resolved_date", "temporal_status")


@query("select canonical_entity_id, string_agg(distinct event_date, ',' order by event_date) as dates from timeline where event_date is not null group by 1 having count(distinct event_date) > 1")
def m_contradictory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.contradictory_dates(frame(spark, sf_dir, "timeline")).select("canonical_entity_id", F.array_join("dates", ",").alias("dates"))


@query("select 'INVALID_CALENDAR_DATE' as validation_rule, canonical_entity_id as entity_id, event_id from timeline where (event_date is not null or start_date is not null) and temporal_status = 'REVIEW_REQUIRED'")
def m_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.invalid_dates(frame(spark, sf_dir, "timeline"))


CONFLICTS = "select x.relationship_id, x.relationship_type, substr(s.event_date, 1, 10) as source_date, substr(t.event_date, 1, 10) as target_date from timeline_edges x join timeline s on s.event_id = source_event_id join timeline t on t.event_id = target_event_id"


@query(f"select * from ({CONFLICTS}) where (relationship_type = 'BEFORE' and source_date > target_date) or (relationship_type = 'AFTER' and source_date < target_date)")
def m_chronology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.edge_conflicts(frame(spark, sf_dir, "timeline_edges"), frame(spark, sf_dir, "timeline")).where("validation_rule = 'CONFLICTING_CHRONOLOGY'").drop("validation_rule")


@query(f"select * from ({CONFLICTS}) where relationship_type = 'HAS_DEADLINE' and target_date < source_date")
def m_deadline_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.edge_conflicts(frame(spark, sf_dir, "timeline_edges"), frame(spark, sf_dir, "timeline")).where("validation_rule = 'DEADLINE_BEFORE_TRIGGER'").drop("validation_rule")


@query("""select document_id, count(*) as total_events, count(*) filter (where date_precision = 'EXACT_DAY') as exact_dates, count(*) filter (where date_precision in ('MONTH', 'YEAR')) as partial_dates,
  count(*) filter (where event_type = 'DEADLINE' or contains(lower(description), 'deadline')) as deadlines from timeline group by 1""")
def m_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.summary(frame(spark, sf_dir, "timeline"))
