"""Queries on vocabulary, resolution and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ontology, resolve, validate
from .fixtures import frame, sql
from .registry import query

# --- SQL twins, built up from the fixtures -------------------------------------------------------------------------

KEYED = "keyed as (select *, trim(lower(coalesce(nullif(normalized_value, ''), text))) as norm_key from mentions where trim(lower(coalesce(nullif(normalized_value, ''), text))) <> '')"
ENT = "'ent_' || substr(sha256(document_id || '|' || entity_type || '|' || norm_key), 1, 12)"
FORMS = "forms as (select document_id, entity_type, norm_key, text, count(*) as n, min(pos) as pos from keyed group by all)"
NAMES = "names as (select *, row_number() over (partition by document_id, entity_type, norm_key order by n desc, pos) as rn from forms)"
ENTITIES = f"""entities as (
  select {ENT} as canonical_id, document_id, entity_type, norm_key, count(*) as n_mentions, sum(coalesce(confidence, 1.0)) / count(*) as avg_confidence,
         arg_min(confidence, pos) as first_confidence, arg_min(page_number, pos) as first_page, min(pos) as first_pos
  from keyed group by document_id, entity_type, norm_key)"""
CANON = f"{KEYED}, {FORMS}, {NAMES}, {ENTITIES}, canon as (select e.*, n.text as canonical_name from entities e join names n using (document_id, entity_type, norm_key) where n.rn = 1)"
RESOLVED = f"""mapped as (select mention_id, {ENT} as canonical_id from keyed),
 redirected as (select r.*, s.canonical_id as source_canonical, t.canonical_id as target_canonical from relations r join mapped s on s.mention_id = r.source_id join mapped t on t.mention_id = r.target_id),
 resolved as (select 'rel_' || substr(sha256(document_id || '|' || relation_type || '|' || source_canonical || '|' || target_canonical), 1, 12) as relation_id, document_id, relation_type, source_canonical, target_canonical,
   arg_min(is_valid, pos) as is_valid, first(validation_error order by pos) as validation_error, count(*) as n_mentions, avg(confidence) as avg_confidence, max(confidence) as max_confidence, min(pos) as first_pos
   from redirected group by document_id, relation_type, source_canonical, target_canonical)"""
BASE = f"with {CANON}, {RESOLVED}"
TYPED = f"""{BASE}, typed as (select r.*, s.entity_type as source_type, t.entity_type as target_type, c.source_type is not null as triplet_ok
  from resolved r left join entities s on s.canonical_id = source_canonical left join entities t on t.canonical_id = target_canonical
  left join dim_closure c on c.source_type = s.entity_type and c.relationship_type = relation_type and c.target_type = t.entity_type)"""
ENTITY_RECORDS = """entity_records as (
  select document_id, canonical_id, 'INVALID_ENTITY_TYPE' as validation_rule, 'INVALID' as status, 'CRITICAL' as severity from canon where entity_type not in (select entity_type from dim_type)
  union all select document_id, canonical_id, 'MISSING_NAME', 'INVALID', 'HIGH' from canon where trim(canonical_name) = ''
  union all select document_id, canonical_id, 'LOW_CONFIDENCE', 'REVIEW_REQUIRED', 'MEDIUM' from canon where round(avg_confidence, 9) < 0.6)"""
RELATION_RECORDS = """relation_records as (
  select document_id, relation_id, 'PREVIOUSLY_INVALIDATED' as validation_rule, 'INVALID' as status, 'HIGH' as severity from typed where not is_valid
  union all select document_id, relation_id, 'INVALID_TRIPLET', 'INVALID', 'HIGH' from typed where is_valid and not triplet_ok
  union all select document_id, relation_id, 'LOW_CONFIDENCE', 'REVIEW_REQUIRED', 'MEDIUM' from typed where is_valid and round(avg_confidence, 9) < 0.6)"""
WORST = """entity_worst as (select c.document_id, c.canonical_id, c.entity_type, max(case status when 'INVALID' then 3 when 'REVIEW_REQUIRED' then 2 else 0 end) as rank from canon c left join entity_records r using (canonical_id) group by all),
 relation_worst as (select t.document_id, t.relation_id, max(case status when 'INVALID' then 3 when 'REVIEW_REQUIRED' then 2 else 0 end) as rank from typed t left join relation_records r using (relation_id) group by all)"""
VALIDATED = f"{TYPED}, {ENTITY_RECORDS}, {RELATION_RECORDS}, {WORST}"


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "mentions")


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.canonical(mentions(spark, sf_dir))


def resolved(spark: SparkSession, sf_dir: str, typed: bool = False) -> DataFrame:
    return resolve.resolve_relations(frame(spark, sf_dir, "relations"), mentions(spark, sf_dir), typed)


def valid_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, entities = resolved(spark, sf_dir), canonical(spark, sf_dir)
    return validate.check_relations(found, entities).where("worst_status <> 'INVALID'").select(found.columns)


# --- Vocabulary ----------------------------------------------------------------------------------------------------


#: A tree of types from the part table, each type's parent being a seventh of its number: depth 4 at two thousand parts.
TREE = "select 'T' || cast(p_partkey as string) as entity_type, case when p_partkey >= 7 then 'T' || cast(cast(floor(p_partkey / 7) as bigint) as string) end as parent from part"
UP = f"tree as ({TREE}), up as (select entity_type, entity_type as ancestor, 0 as depth from tree union all select up.entity_type, t.parent, up.depth + 1 from up join tree t on t.entity_type = up.ancestor where t.parent is not null)"
PAIRS = """select r.candidate_id, s.entity_type as source_type, r.relation_type, t.entity_type as target_type
  from relations r join mentions s on s.mention_id = r.source_id join mentions t on t.mention_id = r.target_id"""


@query(f"with recursive {UP} select * from up")
def o_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ontology.hierarchy(sql(spark, sf_dir, TREE))


TREE_FACTS = "select 'f_' || cast(a.okey as string) || '_' || cast(a.line as string) as fact_id, 'T' || cast(a.pkey as string) as source_type, 'R' || cast(a.line % 3 as string) as relation_type, 'T' || cast(b.pkey as string) as target_type from lines a join lines b on b.okey = a.okey and b.line = a.line + 1"
TREE_NAMED = "select 'T' || cast(p_partkey as string) as source_type, 'R' || cast(p_partkey % 3 as string) as relationship_type, 'T' || cast(p_partkey * 5 % 40 + 1 as string) as target_type from part where p_partkey <= 40"


@query(f"""with recursive {UP}, f as ({TREE_FACTS}), n as ({TREE_NAMED}), ok as (select distinct fact_id from f join up a on a.entity_type = f.source_type join up b on b.entity_type = f.target_type join n on n.source_type = a.ancestor and n.target_type = b.ancestor and n.relationship_type = f.relation_type)
  select f.fact_id, ok.fact_id is not null as triplet_ok from f left join ok on ok.fact_id = f.fact_id""")
def o_triplet_inherited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts held against triplets named for supertypes some levels up, on either end."""
    return ontology.with_inherited_check(sql(spark, sf_dir, TREE_FACTS), sql(spark, sf_dir, TREE), sql(spark, sf_dir, TREE_NAMED)).select("fact_id", "triplet_ok")


def _usage(dim: str) -> str:
    return f"with p as ({PAIRS}) select d.source_type, d.relationship_type, d.target_type, count(p.candidate_id) as n from {dim} d left join p on p.source_type = d.source_type and p.relation_type = d.relationship_type and p.target_type = d.target_type group by 1, 2, 3"


@query(_usage("dim_triplet"))
def o_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ontology.usage(sql(spark, sf_dir, PAIRS), closed=False)


@query(_usage("dim_closure"))
def o_triplet_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ontology.usage(sql(spark, sf_dir, PAIRS), closed=True)


@query("""with t as (select distinct case_id, entity_type from nodes) select s.case_id, d.source_type, d.relationship_type, string_agg(distinct d.target_type, ',' order by d.target_type) as targets
  from t s join dim_triplet d on d.source_type = s.entity_type join t o on o.case_id = s.case_id and o.entity_type = d.target_type group by 1, 2, 3""")
def o_editor_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ontology.editor_matrix(frame(spark, sf_dir, "nodes"))


@query("""with s as (select 'entity' as kind, entity_type as name, category, parent, null as inverse, null as sources, null as targets from dim_type
  union all select 'relationship', relationship_type, null, null, case relationship_type when 'REPRESENTED_BY' then 'REPRESENTS' when 'REPRESENTS' then 'REPRESENTED_BY' when 'BEFORE' then 'AFTER' when 'AFTER' then 'BEFORE' end,
    string_agg(distinct source_type, ',' order by source_type), string_agg(distinct target_type, ',' order by target_type) from dim_triplet group by relationship_type),
  n as (select 'entity' as kind, entity_type as name, count(*) as n from mentions group by 2 union all select 'relationship', relation_type, count(*) from relations group by 2)
  select s.*, coalesce(n.n, 0) as n from s left join n using (kind, name)""")
def o_ontology_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ontology.ontology_spec(mentions(spark, sf_dir), frame(spark, sf_dir, "relations"))


@query("""with t as (select distinct entity_type from mentions where entity_type in (select entity_type from dim_type)), p as (select * from dim_triplet where source_type in (select entity_type from t) and target_type in (select entity_type from t))
  select (select count(*) from t) as num_entity_types, count(distinct relationship_type) as num_relation_types, count(*) as num_valid_pairs,
  string_agg(relationship_type || '|' || source_type || '|' || target_type, ',' order by relationship_type, source_type, target_type) as pairs from p""")
def o_model_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exported JSON, read back."""
    schema = "num_entity_types long, num_relation_types long, num_valid_pairs long, allowed_pairs array<struct<relation:string,head:string,tail:string>>"
    read = ontology.model_config(mentions(spark, sf_dir)).select(F.from_json("config", schema).alias("c")).select("c.*")
    return read.select("num_entity_types", "num_relation_types", "num_valid_pairs", F.array_join(F.transform("allowed_pairs", lambda p: F.concat_ws("|", p["relation"], p["head"], p["tail"])), ",").alias("pairs"))


@query("""with t as (select distinct entity_type from nodes where entity_type in (select entity_type from dim_type))
  select unnest(['CREATE CONSTRAINT constraint_' || lower(entity_type) || '_id_unique IF NOT EXISTS FOR (n:`' || entity_type || '`) REQUIRE n.id IS UNIQUE;', 'CREATE INDEX index_' || lower(entity_type) || '_case_id IF NOT EXISTS FOR (n:`' || entity_type || '`) ON (n.case_id);',
  'CREATE INDEX index_' || lower(entity_type) || '_name IF NOT EXISTS FOR (n:`' || entity_type || '`) ON (n.name);', 'CREATE CONSTRAINT constraint_' || lower(entity_type) || '_provenance_case IF NOT EXISTS FOR (n:`' || entity_type || '`) REQUIRE n.case_id IS NOT NULL;']) as statement from t
  union all select '// Relationship: [' || relationship_type || '] | Sources: ' || string_agg(distinct source_type, ', ' order by source_type) || ' | Targets: ' || string_agg(distinct target_type, ', ' order by target_type)
  from dim_triplet where relationship_type in (select relationship_type from edges) group by relationship_type""")
def o_store_ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ontology.store_ddl(frame(spark, sf_dir, "nodes"), frame(spark, sf_dir, "edges"))


@query(f"with u as ({_usage('dim_closure')}) select relationship_type, string_agg(distinct source_type, ',' order by source_type) as sources, string_agg(distinct target_type, ',' order by target_type) as targets, count(*) as triplets, cast(sum(n) as bigint) as n_facts from u group by 1")
def o_rule_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ontology.rule_schema(sql(spark, sf_dir, PAIRS))


@query("select mention_id, entity_type, entity_type in (select entity_type from dim_type) as is_valid from mentions")
def o_label_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions(spark, sf_dir).select("mention_id", "entity_type", ontology.is_entity_type(F.col("entity_type")).alias("is_valid"))


@query(f"""with pairs as ({PAIRS}) select p.*, c.source_type is not null as triplet_ok from pairs p left join dim_closure c
  on c.source_type = p.source_type and c.relationship_type = p.relation_type and c.target_type = p.target_type""")
def o_triplet_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ontology.with_triplet_check(sql(spark, sf_dir, PAIRS))


ROWS = """select m.mention_id, case when pos % 101 = 0 then ' ' else case_id end as case_id, case when pos % 103 = 0 then cast(null as string) else document_id end as document_id,
  case when pos % 107 = 0 then 1.5 else confidence end as confidence, case when pos % 109 = 0 then 0 else page_number end as page_number, start_offset, case when pos % 113 = 0 then start_offset else end_offset end as end_offset,
  cast(case when pos % 127 = 0 then '2024-02-01' else '2024-01-01' end as date) as start_date, cast('2024-01-15' as date) as end_date from mentions m"""


@query(f"""with r as ({ROWS}), e as (select mention_id, list_filter([case when trim(coalesce(case_id, '')) = '' then 'EMPTY_CASE_ID' end, case when trim(coalesce(document_id, '')) = '' then 'EMPTY_DOCUMENT_ID' end,
  case when not confidence between 0 and 1 then 'CONFIDENCE_RANGE' end, case when page_number < 1 then 'PAGE_RANGE' end, case when start_offset < 0 or start_offset >= end_offset then 'SPAN_ORDER' end,
  case when start_date > end_date then 'DATE_ORDER' end], lambda x: x is not null) as errors from r) select mention_id, errors[1] as first_error, array_to_string(errors, ',') as errors from e""")
def o_row_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ontology.row_errors(sql(spark, sf_dir, ROWS)).select("mention_id", "first_error", F.array_join("errors", ",").alias("errors"))


@query("select event_id, case when status = 'completed' then false else timestamp '1998-06-01 00:00:00' > starts_at end as overdue from docket where kind = 'deadline'")
def o_overdue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "docket").where("kind = 'deadline'")
    now = F.lit("1998-06-01 00:00:00").cast("timestamp")
    return rows.select("event_id", ontology.is_overdue(F.col("starts_at"), F.upper("status"), now).alias("overdue"))


# --- Resolution ----------------------------------------------------------------------------------------------------


@query(f"with {KEYED} select document_id, entity_type, norm_key, count(*) as n_mentions, min(pos) as first_pos from keyed group by all")
def r_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.groups(mentions(spark, sf_dir))


@query(f"with {CANON} select canonical_id, document_id, entity_type, canonical_name, n_mentions, round(avg_confidence, 4) as avg_confidence, first_confidence, first_page from canon")
def r_canonical_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical(spark, sf_dir).select("canonical_id", "document_id", "entity_type", "canonical_name", "n_mentions", F.round("avg_confidence", 4).alias("avg_confidence"), "first_confidence", "first_page")


@query(f"with {CANON} select c.canonical_id, coalesce(string_agg(n.text, '|' order by n.text), '') as aliases from canon c left join names n on n.document_id = c.document_id and n.entity_type = c.entity_type and n.norm_key = c.norm_key and n.text <> c.canonical_name group by 1")
def r_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.aliases(mentions(spark, sf_dir)).select("canonical_id", F.array_join("aliases", "|").alias("aliases"))


@query(f"with {KEYED} select mention_id, {ENT} as canonical_id from keyed")
def r_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.mapping(mentions(spark, sf_dir)).select("mention_id", "canonical_id")


@query(f"{BASE} select candidate_id, relation_type, source_canonical, target_canonical from redirected")
def r_redirect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.redirect(frame(spark, sf_dir, "relations"), mentions(spark, sf_dir)).select("candidate_id", "relation_type", "source_canonical", "target_canonical")


@query(f"{BASE} select relation_id, document_id, relation_type, source_canonical, target_canonical, is_valid, validation_error, n_mentions, round(avg_confidence, 4) as avg_confidence, max_confidence from resolved")
def r_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(spark, sf_dir).drop("first_pos").withColumn("avg_confidence", F.round("avg_confidence", 4))


@query(f"""{BASE} select m.document_id, m.n as total_candidate_entities, coalesce(e.n, 0) as total_canonical_entities, coalesce(r.n, 0) as total_candidate_relations, coalesce(x.n, 0) as total_resolved_relations
  from (select document_id, count(*) as n from mentions group by 1) m left join (select document_id, count(*) as n from canon group by 1) e using (document_id)
  left join (select document_id, count(*) as n from relations group by 1) r using (document_id) left join (select document_id, count(*) as n from resolved group by 1) x using (document_id)""")
def r_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.summary(mentions(spark, sf_dir), frame(spark, sf_dir, "relations"))


# --- Validation ----------------------------------------------------------------------------------------------------


@query(f"with {CANON}, {ENTITY_RECORDS} select * from entity_records")
def v_entity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.entity_records(canonical(spark, sf_dir)).drop("message", "confidence")


@query(f"with {CANON} select canonical_id, round(avg_confidence, 4) as confidence from canon where round(avg_confidence, 9) < 0.6")
def v_low_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.entity_records(canonical(spark, sf_dir)).where("validation_rule = 'LOW_CONFIDENCE'").select("canonical_id", F.round("confidence", 4).alias("confidence"))


@query(f"{TYPED}, {RELATION_RECORDS} select * from relation_records")
def v_relation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.relation_records(resolved(spark, sf_dir), canonical(spark, sf_dir)).drop("message", "confidence")


@query(f"""{BASE}, known as (select * from entities where first_pos % 10 < 6) select relation_id, s.canonical_id is null as missing_source, t.canonical_id is null as missing_target from resolved
  left join known s on s.canonical_id = source_canonical left join known t on t.canonical_id = target_canonical where is_valid and (s.canonical_id is null or t.canonical_id is null)""")
def v_missing_endpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = canonical(spark, sf_dir).where("first_pos % 10 < 6")
    found = validate.relation_records(resolved(spark, sf_dir), known).where(F.col("validation_rule").startswith("MISSING_"))
    has = lambda rule: (F.count_if(F.col("validation_rule") == rule) > 0)
    return found.groupBy("relation_id").agg(has("MISSING_SOURCE_ENTITY").alias("missing_source"), has("MISSING_TARGET_ENTITY").alias("missing_target"))


@query(f"{VALIDATED} select canonical_id, case rank when 3 then 'INVALID' when 2 then 'REVIEW_REQUIRED' else 'VALID' end as worst_status from entity_worst")
def v_worst_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.check_entities(canonical(spark, sf_dir)).select("canonical_id", "worst_status")


@query(f"{VALIDATED} select relation_id, rank < 3 as valid from relation_worst")
def v_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = validate.check_relations(resolved(spark, sf_dir), canonical(spark, sf_dir))
    return checked.select("relation_id", (F.col("worst_status") != "INVALID").alias("valid"))


@query(f"""{BASE}, twice as (select * from resolved union all select * from resolved where first_pos % 3 = 0)
  select document_id, relation_id, 'Relationship extracted ' || cast(count(*) as string) || ' times.' as message, max(max_confidence) as confidence from twice group by 1, 2 having count(*) > 1""")
def v_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolved(spark, sf_dir)
    return validate.duplicates(found.union(found.where("first_pos % 3 = 0")))


@query("""select case_id as document_id, source_id as source_canonical from (select case_id, source_id, relationship_type from edges union all select case_id, source_id, 'DEFENDANT_IN' from edges where source_id like 'P%7')
  where relationship_type in ('PLAINTIFF_IN', 'DEFENDANT_IN') group by 1, 2 having count(distinct relationship_type) = 2""")
def v_contradiction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "edges").select(F.col("case_id").alias("document_id"), F.col("source_id").alias("source_canonical"), F.col("target_id").alias("target_canonical"), F.col("relationship_type").alias("relation_type"))
    return validate.contradictions(rows.union(rows.where("source_canonical like 'P%7'").withColumn("relation_type", F.lit("DEFENDANT_IN"))))


# Every fifth relation twice, under another id: a fact that is found twice is a warning.
TWICE = VALIDATED.replace(" resolved as (", " once as (", 1).replace(", typed as (", ", resolved as (select * from once union all select * replace (relation_id || '_again' as relation_id) from once where first_pos % 5 = 0), typed as (", 1)


@query(f"""{TWICE}, ec as (select document_id, count(*) as total_entities_checked, count(*) filter (where rank < 3) as valid_entities, count(*) filter (where rank = 3) as invalid_entities from entity_worst group by 1),
  rc as (select document_id, count(*) as total_relations_checked, count(*) filter (where rank < 3) as valid_relations, count(*) filter (where rank = 3) as invalid_relations from relation_worst group by 1),
  parties as (select document_id, source_canonical from resolved join relation_worst using (document_id, relation_id) where rank < 3 and relation_type in ('PLAINTIFF_IN', 'DEFENDANT_IN') group by 1, 2 having count(distinct relation_type) = 2),
  reviews as (select document_id, count(*) as reviews_required from (select document_id from entity_records where status = 'REVIEW_REQUIRED' union all select document_id from relation_records where status = 'REVIEW_REQUIRED' union all select document_id from parties) group by 1),
  again as (select document_id, count(*) as warnings from (select document_id from resolved group by document_id, source_canonical, relation_type, target_canonical having count(*) > 1) group by 1)
  select document_id, total_entities_checked, valid_entities, invalid_entities, coalesce(total_relations_checked, 0) as total_relations_checked, coalesce(valid_relations, 0) as valid_relations, coalesce(invalid_relations, 0) as invalid_relations,
    coalesce(warnings, 0) as warnings_generated, coalesce(reviews_required, 0) as reviews_required from ec left join rc using (document_id) left join reviews using (document_id) left join again using (document_id)""")
def v_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    again = F.when(F.col("first_pos") % 5 == 0, F.array(F.lit(""), F.lit("_again"))).otherwise(F.array(F.lit("")))
    found = resolved(spark, sf_dir, typed=True).withColumn("again", F.explode(again)).withColumn("relation_id", F.concat("relation_id", "again")).drop("again")
    return validate.summary(canonical(spark, sf_dir), found)


# --- Flagship ------------------------------------------------------------------------------------------------------


@query(f"""{VALIDATED}, d as (select distinct document_id, case_id from mentions), e as (select case_id, count(*) as entities, count(*) filter (where rank = 3) as invalid_entities from entity_worst join d using (document_id) group by 1),
  r as (select case_id, count(*) as relations, count(*) filter (where rank < 3) as valid_relations from relation_worst join d using (document_id) group by 1)
  select case_id, entities, invalid_entities, coalesce(relations, 0) as relations, coalesce(valid_relations, 0) as valid_relations from e left join r using (case_id)""")
def flagship_case_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions to canonical entities to validated relations to counts per case."""
    own, entities, found = mentions(spark, sf_dir), canonical(spark, sf_dir), resolved(spark, sf_dir, typed=True)
    cases = own.select("document_id", "case_id").distinct()
    totals = validate.summary(entities, found).join(cases, "document_id")
    return totals.groupBy("case_id").agg(
        F.sum("total_entities_checked").alias("entities"), F.sum("invalid_entities").alias("invalid_entities"), F.sum("total_relations_checked").alias("relations"), F.sum("valid_relations").alias("valid_relations")
    )
