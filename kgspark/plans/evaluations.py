"""Queries on evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate, resolve, validate
from .entities import VALIDATED, canonical
from .fixtures import frame, sql
from .registry import query

# One gold row and one prediction at most for each (document, category, page, place), so that a greedy match is a join: texts
# carry their place, which no other text of the group holds.
KEYS = "select document_id, lower(entity_type) as category, pos, page_number as page, '<' || cast(pos as string) || '> ' || lower(trim(text)) as text, '#' || cast(pos as string) || '#' as norm from mentions"
GOLD = f"select * from ({KEYS}) k where pos % 5 <> 0"
PRED = f"select document_id, category, pos, case when pos % 41 = 0 then page + 1 else page end as page, case when pos % 3 = 0 then text || ' more' else text end as text, norm from ({KEYS}) k where pos % 7 <> 0 union all select document_id, category, pos + 1000000000, page, '<<none ' || cast(pos as string) || '>>', '!' || cast(pos as string) || '!' from ({KEYS}) k where pos % 13 = 0"


def _counts(page: bool) -> str:
    same = "and g.page = p.page" if page else ""
    return f"""with g as ({GOLD}), p as ({PRED}), m as (select p.category, g.pos as hit from p left join g on g.document_id = p.document_id and g.category = p.category and g.pos = p.pos {same}),
  a as (select category, count(hit) as tp, count(*) - count(hit) as fp from m group by 1), b as (select category, count(*) as n from g group by 1), c as (select category, coalesce(tp, 0) as tp, coalesce(fp, 0) as fp, coalesce(n, 0) - coalesce(tp, 0) as fn from a full join b using (category)),
  counts as (select * from c union all select 'OVERALL', cast(sum(tp) as bigint), cast(sum(fp) as bigint), cast(sum(fn) as bigint) from c)"""


def _pairs(spark: SparkSession, sf_dir: str, match: str) -> DataFrame:
    return evaluate.by_category(evaluate.matched_pairs(sql(spark, sf_dir, PRED), sql(spark, sf_dir, GOLD), match))


R4 = "round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 4) as precision, round(case when tp + fn > 0 then tp / (tp + fn) else 0 end, 4) as recall"
F4 = "round(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end, 4) as f1"


@query(f"{_counts(True)}, s as (select *, case when tp + fp > 0 then tp / (tp + fp) else 1 end as p, case when tp + fn > 0 then tp / (tp + fn) else 1 end as r from counts) select category, tp, fp, fn, round(p, 8) as precision, round(r, 8) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 8) as f1 from s")
def e_rules_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.scores(_pairs(spark, sf_dir, "rule"), "one")
    return out.select("category", "tp", "fp", "fn", *[F.round(c, 8).alias(c) for c in ("precision", "recall", "f1")])


@query(f"{_counts(True)}, s as (select *, {R4} from counts) select *, {F4} from s")
def e_model_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.scores(_pairs(spark, sf_dir, "model"), "zero")


@query(f"{_counts(False)}, s as (select *, {R4} from counts) select *, {F4} from s")
def e_entity_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.scores(_pairs(spark, sf_dir, "entity"), "null")


@query(f"{_counts(False)}, s as (select *, {R4} from counts) select *, {F4} from s")
def e_relation_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations: source and target texts both have to be within each other."""
    ends = lambda text: text.replace("'#' || cast(pos as string) || '#' as norm", "'[' || cast(pos as string) || ']' as norm")
    return evaluate.scores(evaluate.by_category(evaluate.matched_pairs(sql(spark, sf_dir, ends(PRED)), sql(spark, sf_dir, ends(GOLD)), "relation")), "null")


PAIRS = "select mention_id as pair_id, lower(text) as text_1, case when pos % 3 = 0 then text when pos % 3 = 1 then brand else 'small ring' end as text_2, pos % 3 = 0 as are_equivalent from mentions where trim(text) <> '' and pos % 2 = 0"


@query(f"""with t as (select lower(replace(replace(trim(text), '_', ' '), '-', ' ')) as k, arg_max(canonical_id, first_pos) as id from (select 'e' || cast(min(pos) as string) as canonical_id, text, min(pos) as first_pos from mentions where trim(text) <> '' and pos % 4 <> 1 group by text) group by 1),
  r as (select are_equivalent as eq, coalesce(a.id = b.id, false) as same from ({PAIRS}) p left join t a on a.k = lower(trim(text_1)) left join t b on b.k = lower(trim(replace(replace(text_2, '_', ' '), '-', ' ')))),
  c as (select count(*) filter (where eq and same) as tp, count(*) filter (where not eq and same) as fp, count(*) filter (where eq and not same) as fn, count(*) filter (where not eq and not same) as tn from r), s as (select *, {R4} from c) select *, {F4}, round((tp + tn) / (tp + fp + fn + tn), 4) as accuracy from s""")
def e_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = frame(spark, sf_dir, "mentions").where("trim(text) <> '' and pos % 4 <> 1").groupBy("text").agg(F.min("pos").alias("pos"))
    entities = own.select(F.concat(F.lit("e"), F.col("pos").cast("string")).alias("canonical_id"), "pos", F.array("text").alias("texts"))
    return evaluate.resolution(entities, sql(spark, sf_dir, PAIRS))


GOLD_EVENTS = "select document_id, pos, 'x' || cast(pos as string) || 'x' as description, event_date as date from timeline where pos % 5 <> 0"
SEEN_EVENTS = "select document_id, pos, 'seen x' || cast(pos as string) || 'x' as description, case when pos % 8 = 0 then substr(event_date, 1, 4) when pos % 9 = 0 then '1900-01-01' else event_date end as date from timeline where pos % 6 <> 0"


@query(f"""with g as ({GOLD_EVENTS}), p as ({SEEN_EVENTS}), m as (select g.date as a, p.date as b from g join p using (document_id, pos)), c as (select (select count(*) from g) as total_gold, (select count(*) from p) as total_predicted, count(*) as matched, count(*) filter (where a = b) as exact_dates,
  count(*) filter (where a <> b and (contains(a, b) or contains(b, a) or substr(a, 1, 4) = substr(b, 1, 4))) as partial_dates from m), s as (select *, round(matched / total_predicted, 4) as precision, round(matched / total_gold, 4) as recall from c) select *, {F4} from s""")
def e_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.temporal(sql(spark, sf_dir, SEEN_EVENTS), sql(spark, sf_dir, GOLD_EVENTS))


@query(f"{VALIDATED} select count(*) as total_items, count(*) filter (where rank = 3) as invalid_items, round(count(*) filter (where rank = 3) / count(*), 4) as invalid_rate, round(count(*) filter (where rank < 3) / count(*), 4) as valid_rate from entity_worst")
def e_validation_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.validation_rate(validate.check_entities(canonical(spark, sf_dir)))


ITEMS = "select mention_id, case when pos % 11 = 0 then 0 else page_number end as page_number, start_offset, case when pos % 13 = 0 then start_offset - 1 else end_offset end as end_offset, text from mentions"


@query(f"""with i as ({ITEMS}) select count(*) as total, count(*) filter (where page_number >= 1) as with_page, count(*) filter (where end_offset >= start_offset) as with_offsets, count(*) filter (where trim(text) <> '') as with_text,
  count(*) filter (where page_number >= 1 and end_offset >= start_offset and trim(text) <> '') as complete, round(count(*) filter (where page_number >= 1 and end_offset >= start_offset and trim(text) <> '') / count(*), 4) as completeness from i""")
def e_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.provenance(sql(spark, sf_dir, ITEMS))


@query(f"{VALIDATED} select (select count(*) from mentions) as total, count(*) as escalated, (select count(*) from mentions) - count(*) as approved, round(count(*) / (select count(*) from mentions), 4) as escalation_rate from entity_records where status = 'REVIEW_REQUIRED'")
def e_escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.escalation(frame(spark, sf_dir, "mentions"), validate.entity_records(resolve.canonical(frame(spark, sf_dir, "mentions"))).where("status = 'REVIEW_REQUIRED'"))


@query(f"""{_counts(True)}, s as (select *, {R4} from counts), f as (select *, {F4} from s) select category, rpad(substr(category, 1, 24), 24, ' ') || ' |' || printf('%8.4f', precision) || ' |' || printf('%8.4f', recall) || ' |' || printf('%8.4f', f1) as line from f""")
def e_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.report_lines(evaluate.scores(_pairs(spark, sf_dir, "model"), "zero"))
