"""Queries on model predictions, review and arbitration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunks, graph, review, temporal, validate
from ..session import shared_folder
from .entities import VALIDATED, canonical, resolved
from .fixtures import frame, sql
from .registry import query
from .timelines import PAGES

# Predictions from mentions: a chunk is an order, places are those of the mention.
CHUNKS = "select 'k_' || cast(okey as string) as chunk_id, 'd_' || cast(cast(floor(okey / 32) as bigint) as string) as document_id, cast(okey % 32 + 1 as int) as page_number, cast(okey % 100 * 10 as int) as start_char_offset from (select distinct okey from lines) x"
PRED = """select 'k_' || split_part(mention_id, '_', 2) as chunk_id, pos, lower(entity_type) as label, text || ' ' as text, start_offset as start, end_offset as end, confidence as score, mention_id from mentions"""
ENTITIES = f"""ck as ({CHUNKS}), pr as ({PRED}), ents as (select p.chunk_id, c.document_id, c.page_number, p.pos, upper(label) as entity_type, trim(text) as text, p.start, p.end, c.start_char_offset + p.start as start_offset, c.start_char_offset + p.end as end_offset, round(score, 4) as confidence
  from pr p join ck c using (chunk_id) where score >= 0.4 and upper(label) in (select entity_type from dim_type) and trim(text) <> '')"""
# Heads are exact, a few characters off, or made up; tails as they are.
HEADS = """select m.mention_id as mention_key, 'k_' || split_part(m.mention_id, '_', 2) as chunk_id, case when pos % 9 = 0 then 'nobody' else entity_type end as label, case when pos % 4 = 2 then 'unseen text' else upper(text) end as text,
  start_offset + cast(case pos % 4 when 1 then 3 when 2 then 17 else 0 end as int) as start, end_offset + cast(case pos % 4 when 1 then 3 when 2 then 17 else 0 end as int) as end from mentions m where trim(text) <> ''"""
ENDS = f"""{ENTITIES}, hd as ({HEADS}), j as (select h.mention_key, h.label, e.pos as e_pos, e.entity_type as e_type, case when e.start = h.start and e.end = h.end and lower(e.text) = lower(trim(h.text)) then 0 when (e.start = h.start or lower(e.text) = lower(trim(h.text))) and abs(e.start - h.start) <= 5 then 1 end as k
  from hd h left join ents e using (chunk_id)), r as (select *, row_number() over (partition by mention_key order by case when k is null then 1 else 0 end, k, case when k = 0 then -e_pos else e_pos end) as rn from j),
  ends as (select mention_key, case when k is not null then e_type when upper(label) in (select entity_type from dim_type) then upper(label) end as entity_type, case when k = 0 then 'exact' when k = 1 then 'near' when upper(label) in (select entity_type from dim_type) then 'made' else 'none' end as how, case when k is not null then e_pos end as entity_pos from r where rn = 1)"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, CHUNKS)


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.entities(sql(spark, sf_dir, PRED), _chunks(spark, sf_dir))


@query(f"with {ENTITIES} select chunk_id, pos, document_id, page_number, entity_type, text, start_offset, end_offset, confidence from ents")
def c_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(spark, sf_dir).select("chunk_id", "pos", "document_id", "page_number", "entity_type", "text", "start_offset", "end_offset", "confidence")


@query(f"with {ENDS} select mention_key, coalesce(entity_type, '') as entity_type, how, coalesce(entity_pos, -1) as entity_pos from ends")
def c_fuzzy_endpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.endpoints(sql(spark, sf_dir, HEADS), _entities(spark, sf_dir)).select("mention_key", F.coalesce("entity_type", F.lit("")).alias("entity_type"), "how", F.coalesce("entity_pos", F.lit(-1)).alias("entity_pos"))


RELS = "select r.candidate_id, lower(r.relation_type) as relation, r.confidence as score, s.mention_id as h, t.mention_id as t from relations r join mentions s on s.mention_id = r.source_id join mentions t on t.mention_id = r.target_id where trim(s.text) <> '' and trim(t.text) <> ''"
RELATIONS = f"""{ENDS}, rel as (select candidate_id as rel_id, upper(relation) as relation_type, round(score, 4) as confidence, s.entity_type as source_type, t.entity_type as target_type, c.source_type is not null as is_valid from ({RELS}) x
  join ends s on s.mention_key = x.h join ends t on t.mention_key = x.t left join dim_closure c on c.source_type = s.entity_type and c.relationship_type = upper(relation) and c.target_type = t.entity_type where score >= 0.4 and s.entity_type is not null and t.entity_type is not null)"""


# The same without the mentions: heads and tails are joined, which are the mentions with a text.
CLAIMED = "select candidate_id, lower(relation_type) as relation, confidence as score, source_id as h, target_id as t from relations"


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = sql(spark, sf_dir, HEADS)
    side = lambda name, key: heads.select(F.col("mention_key").alias(key), F.col("chunk_id").alias(f"{name}_chunk"), F.struct("label", "text", "start", "end").alias(name))
    rows = sql(spark, sf_dir, CLAIMED).join(side("head", "h"), "h").join(side("tail", "t"), "t")
    return chunks.relations(rows.select(F.col("candidate_id").alias("rel_id"), F.col("head_chunk").alias("chunk_id"), "relation", "score", "head", "tail"), _entities(spark, sf_dir))


@query(f"with {RELATIONS} select * from rel")
def c_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relations(spark, sf_dir).select("rel_id", "relation_type", "confidence", "source_type", "target_type", "is_valid")


@query(f"with {RELATIONS} select 'entity' as kind, entity_type as value, count(*) as n from ents group by 2 union all select case when is_valid then 'valid' else 'rejected' end, relation_type, count(*) from rel group by 1, 2")
def c_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.summary(_entities(spark, sf_dir), _relations(spark, sf_dir))


@query(f"with {ENTITIES} select 'model' as source, text, page_number, '' as brand from ents union all select 'rule', text, page_number, brand from mentions where extraction_method = 'RULE'")
def c_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = frame(spark, sf_dir, "mentions").where("extraction_method = 'RULE'").select("text", "page_number", "brand")
    return chunks.combined(rules, _entities(spark, sf_dir).select("text", "page_number")).select("source", "text", "page_number", F.coalesce("brand", F.lit("")).alias("brand"))


@query("select doc_id, length(text) as chars, sha256(text) as text_sha from documents where text is not null")
def c_infer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for a model, the text's length, run once per distinct text and joined back."""
    docs = sql(spark, sf_dir, "select doc_id, text from documents where text is not null")
    return chunks.infer_distinct(docs, lambda once: once.select("text_sha", F.length("text").cast("long").alias("chars")))


@query("""with d as (select doc_id, text from documents where text is not null) select doc_id, length(text) as chars, case when text in (select text from d where doc_id % 2 = 0) then 1 else 2 end as run from d""")
def c_infer_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over a growing table: the second one asks the model, here the text's length, for what the first didn't see."""
    docs = sql(spark, sf_dir, "select doc_id, text from documents where text is not null")
    cache = chunks.inference_cache(spark, shared_folder(spark, "inference"), "chars long, run int")
    ask = lambda run: lambda once: once.select("text_sha", F.length("text").cast("long").alias("chars"), F.lit(run).alias("run"))
    chunks.infer_cached(docs.where("doc_id % 2 = 0"), "length-1", ask(1), cache)
    return chunks.infer_cached(docs, "length-1", ask(2), cache).select("doc_id", "chars", "run")


# --- Review --------------------------------------------------------------------------------------------------------

ITEMS = f"""{VALIDATED}, items as (select 'ENTITY' as item_type, canonical_id as ref, document_id, 1 as source_page from entity_records where status in ('REVIEW_REQUIRED', 'WARNING')
  union all select 'RELATIONSHIP', relation_id, document_id, 1 from relation_records where status in ('REVIEW_REQUIRED', 'WARNING')
  union all select 'ENTITY', canonical_id, document_id, coalesce(first_page, 1) from entities where coalesce(first_confidence, 1.0) < 0.75
  union all select 'TEMPORAL', '', document_id, page_number from ({PAGES}) where form = 5
  union all select 'EVENT', event_id, document_id, coalesce(source_page, 1) from timeline where temporal_status in ('AMBIGUOUS', 'CONTRADICTORY', 'REVIEW_REQUIRED', 'UNRESOLVED') or confidence < 0.75)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, found = canonical(spark, sf_dir), resolved(spark, sf_dir, typed=True)
    es = validate.entity_records(entities).select("document_id", F.lit("entity").alias("kind"), F.col("canonical_id").alias("id"), "status", "validation_rule", "message", "confidence")
    rs = validate.relation_records(found, entities).select("document_id", F.lit("relationship").alias("kind"), F.col("relation_id").alias("id"), "status", "validation_rule", "message", "confidence")
    open_ones = temporal.relative_expressions(sql(spark, sf_dir, PAGES)).where("direction = 'OFFSET'")
    return review.generate(es.union(rs), entities, open_ones, frame(spark, sf_dir, "timeline"))


@query(f"{ITEMS} select item_type, ref, document_id, source_page, 'PENDING' as status from items")
def h_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = F.when(F.col("item_type") == "EVENT", F.col("event_id")).otherwise(F.coalesce("entity_id", "relationship_id", F.lit("")))
    return _items(spark, sf_dir).select("item_type", ref.alias("ref"), F.col("source_document_id").alias("document_id"), "source_page", "status")


REVIEWS = "select 'rev_' || event_id as review_id, 'c' || cast(pos % 5 as string) as case_id, case when pos % 2 = 0 then 'EVENT' else 'ENTITY' end as item_type, case when pos % 3 = 0 then 'APPROVED' else 'PENDING' end as status, pos from timeline"


@query(f"select review_id from ({REVIEWS}) where case_id = 'c2' and status = 'PENDING' and item_type = 'EVENT'")
def h_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.queue(sql(spark, sf_dir, REVIEWS), "c2", "PENDING", "EVENT").select("review_id")


VERDICTS = f"select review_id, n.k as at, case when n.k = 0 then 'APPROVE' when pos % 7 = 0 then 'CORRECT' else 'REJECT' end as decision from ({REVIEWS}) x cross join (select 0 as k union all select 1) n where pos % (n.k + 2) = 0"


@query(f"""select review_id, case when pos % 3 = 0 then case when pos % 7 = 0 then 'CORRECTED' else 'REJECTED' end when pos % 2 = 0 then 'APPROVED' else 'PENDING' end as status,
  case when pos % 3 = 0 then case when pos % 7 = 0 then 'HUMAN_CORRECTED' else 'HUMAN_REJECTED' end when pos % 2 = 0 then 'HUMAN_APPROVED' else 'UNREVIEWED' end as trust_status from ({REVIEWS})""")
def h_apply_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.apply_decisions(sql(spark, sf_dir, REVIEWS), sql(spark, sf_dir, VERDICTS)).select("review_id", "status", "trust_status")


TYPED = """select r.candidate_id as relation_id, r.relation_type, case when r.pos % 17 = 0 then cast(null as string) else s.entity_type end as source_type, t.entity_type as target_type, r.pos from relations r join mentions s on s.mention_id = r.source_id join mentions t on t.mention_id = r.target_id"""
FIXES = f"select relation_id, case when pos % 5 = 0 then 'NOT_A_TYPE' when pos % 5 = 1 then 'MENTIONED_IN' else cast(null as string) end as new_type, case when pos % 3 = 0 then 'PERSON' else cast(null as string) end as new_source_type, case when pos % 5 = 1 then 'CASE' else cast(null as string) end as new_target_type from ({TYPED}) x where pos % 2 = 0"


@query(f"""with x as (select y.*, coalesce(f.new_type, y.relation_type) as t, coalesce(f.new_source_type, y.source_type, 'PARTY') as s, coalesce(f.new_target_type, y.target_type, 'PARTY') as o from ({TYPED}) y join ({FIXES}) f using (relation_id)),
  z as (select x.*, case when t not in (select relationship_type from dim_relationship) then 'INVALID_RELATIONSHIP_TYPE' when s not in (select entity_type from dim_type) or o not in (select entity_type from dim_type) then 'INVALID_ENTITY_TYPE' when c.source_type is null then 'INVALID_TRIPLET' else 'CORRECTED' end as outcome
  from x left join dim_closure c on c.source_type = s and c.relationship_type = t and c.target_type = o) select relation_id, relation_type as original_type, case when outcome = 'CORRECTED' then t else relation_type end as relation_type, outcome from z""")
def h_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.correct_relations(sql(spark, sf_dir, TYPED).drop("pos"), sql(spark, sf_dir, FIXES))


ASKED = "select 'q' || id as request_id, case_id, id as primary_id, case when ord % 4 = 0 then id when ord % 4 = 1 then 'S' || cast(ord + 1 as string) else 'S' || cast(ord + 25 as string) end as secondary_id from nodes where id like 'S%'"


@query(f"""select request_id, case when s.id is null then 'NOT_FOUND' when s.case_id <> q.case_id then 'CASE_MISMATCH' when primary_id = secondary_id then 'SAME_ENTITY' else 'MERGED' end as outcome from ({ASKED}) q left join nodes s on s.id = secondary_id""")
def h_merge_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.check_merges(sql(spark, sf_dir, ASKED), frame(spark, sf_dir, "nodes"))


# --- Arbitration ---------------------------------------------------------------------------------------------------

RAW = """select o_orderkey as request_id, case when o_orderkey % 11 = 0 then 'not json {' when o_orderkey % 13 = 0 then '' else '{"decision": "' || case o_orderkey % 4 when 0 then 'resolved' when 1 then 'RESOLVED' when 2 then 'Uncertain' else 'MAYBE' end || '", "confidence": ' || cast(o_orderkey % 15 as string) || '.5e-1, "selected_entity_type": "'
  || case o_orderkey % 3 when 0 then 'PERSON' when 1 then 'PARTY' else '' end || '", "selected_relationship_type": "' || case o_orderkey % 5 when 0 then 'CITES' when 1 then 'BOGUS' else '' end || '"}' end as raw,
  case when o_orderkey % 2 = 0 then 'CASE' else cast(null as string) end as source_type, 'STATUTE' as target_type, o_orderkey % 7 < 4 as has_candidates, case o_orderkey % 4 when 0 then 'RELATIONSHIP_TYPE' when 1 then 'TEMPORAL_INTERPRETATION' when 2 then 'ENTITY_IDENTITY' else 'ENTITY_TYPE' end as ambiguity_type from orders"""
PARSED = """parsed as (select o_orderkey as request_id, o_orderkey % 11 <> 0 and o_orderkey % 13 <> 0 as well_formed, case when o_orderkey % 11 = 0 or o_orderkey % 13 = 0 then 'UNCERTAIN' when o_orderkey % 4 < 2 then 'RESOLVED' else 'UNCERTAIN' end as decision,
  case when o_orderkey % 11 = 0 or o_orderkey % 13 = 0 then 0.0 else least((o_orderkey % 15 * 10 + 5) / 100.0, 1.0) end as confidence, case when o_orderkey % 11 = 0 or o_orderkey % 13 = 0 then null when o_orderkey % 3 = 0 then 'PERSON' when o_orderkey % 3 = 1 then 'PARTY' else '' end as entity_type,
  case when o_orderkey % 11 = 0 or o_orderkey % 13 = 0 then null when o_orderkey % 5 = 0 then 'CITES' when o_orderkey % 5 = 1 then 'BOGUS' else '' end as relation_type, o_orderkey % 2 = 0 as cited, o_orderkey % 7 < 4 as has_candidates, o_orderkey % 4 as kind from orders)"""
CHECKED = f"""with {PARSED}, chk as (select *, case when decision <> 'RESOLVED' then null when entity_type = 'PARTY' then 'INVALID_ENTITY_TYPE' when relation_type = 'BOGUS' then 'INVALID_RELATIONSHIP_TYPE' when relation_type = 'CITES' and has_candidates and not cited then 'TRIPLET_VIOLATION' end as ontology_error from parsed),
  bands as (select *, case when decision = 'RESOLVED' and ontology_error is null and confidence >= 0.85 then 'ACCEPTED' when decision = 'RESOLVED' and ontology_error is null and confidence >= 0.5 then 'REVIEW' else 'REJECTED' end as band from chk)"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sql(spark, sf_dir, RAW).withColumn("p", review.parse_response(F.col("raw")))
    return rows.select("request_id", "source_type", "target_type", "has_candidates", "ambiguity_type", "p.*")


@query(f"with {PARSED} select request_id, decision, round(confidence, 4) as confidence, well_formed, coalesce(entity_type, '') as entity_type from parsed")
def l_parse_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("request_id", "decision", F.round("confidence", 4).alias("confidence"), "well_formed", F.coalesce("entity_type", F.lit("")).alias("entity_type"))


@query(f"{CHECKED} select request_id, ontology_error from chk")
def l_ontology_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.check_answers(_answers(spark, sf_dir)).select("request_id", "ontology_error")


@query(f"{CHECKED} select request_id, band, case when band = 'REJECTED' then 'REJECTED' else decision end as final_decision, round(case when ontology_error is not null then 0.0 else confidence end, 4) as final_confidence, band <> 'ACCEPTED' as needs_human_review from bands")
def l_decision_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = review.decide(review.check_answers(_answers(spark, sf_dir)))
    return out.select("request_id", "band", "final_decision", F.round("final_confidence", 4).alias("final_confidence"), "needs_human_review")


@query(f"{CHECKED} select request_id, case kind when 0 then 'RELATIONSHIP' when 1 then 'TEMPORAL' when 2 then 'ENTITY_MERGE' else 'ENTITY' end as item_type, 'PENDING' as status from bands where band <> 'ACCEPTED'")
def l_escalate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.escalate(review.decide(review.check_answers(_answers(spark, sf_dir)))).drop("confidence")


@query("select case_id, id, false as merged from nodes where id like 'N%'")
def h_merge_flag_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merging by mark alone: edges stay as they are."""
    nodes = frame(spark, sf_dir, "nodes").withColumn("aliases", F.array("alias"))
    marked, _ = graph.merge(nodes, frame(spark, sf_dir, "edges"), sql(spark, sf_dir, "select case_id, id as primary_id, 'gone' as secondary_id from nodes where id like 'N%'"), flag_only=True)
    return marked.where("id like 'N%'").select("case_id", "id", F.col("merged_into").isNotNull().alias("merged"))
