"""Queries on the graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, merging, ontology, search, validate
from .entities import VALIDATED, canonical, resolved
from .fixtures import frame, sql
from ..operators.store import GraphStore
from ..session import shared_folder
from .registry import query

EDGE_COLUMNS = "case_id, id, source_id, target_id, relationship_type, confidence"
CATEGORY = "case " + " ".join(f"when upper(entity_type) in ({', '.join(repr(t) for t, c, _ in ontology.ENTITY_TYPES if c == k)}) then '{k}'" for k in dict.fromkeys(c for _, c, _ in ontology.ENTITY_TYPES)) + " else 'PARTY_LEGAL_ACTOR' end"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "nodes")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "edges")


def with_aliases(df: DataFrame) -> DataFrame:
    return df.withColumn("aliases", F.array("alias"))


@query(f"""{VALIDATED}, reviewed as (select distinct relation_id from relation_records where status = 'REVIEW_REQUIRED')
  select 'node' as kind, canonical_id as id, first_page as source_page from entities join entity_worst using (canonical_id) where rank < 3
  union all select 'edge', relation_id, 0 from resolved join relation_worst using (relation_id) where rank < 3 and is_valid and relation_id not in (select relation_id from reviewed)""")
def g_import_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a case import takes: entities that aren't invalid, with the page of their first mention; relations that are
    valid and need no review."""
    entities, found = canonical(spark, sf_dir), resolved(spark, sf_dir, typed=True)
    es, rs = validate.check_entities(entities), validate.check_relations(found, entities)
    a = es.where("worst_status <> 'INVALID'").select(F.lit("node").alias("kind"), F.col("canonical_id").alias("id"), F.col("first_page").alias("source_page"))
    b = rs.where("is_valid and worst_status not in ('INVALID', 'REVIEW_REQUIRED')").select(F.lit("edge").alias("kind"), F.col("relation_id").alias("id"), F.lit(0).alias("source_page"))
    return a.union(b)


VERSIONS = "select case_id, id, name || case when v.version > 0 then ' v' || cast(v.version as string) else '' end as name, entity_type, v.version as version from nodes cross join (select 0 as version union all select 1 union all select 2) v where v.version = 0 or ord % (v.version + 1) = 0"


@query(f"select case_id, id, name, entity_type, version from (select *, row_number() over (partition by case_id, id order by version desc) as rn from ({VERSIONS})) where rn = 1")
def g_upsert_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sql(spark, sf_dir, VERSIONS)
    return graph.upsert(rows.where("version = 0"), rows.where("version > 0"))


@query(f"""with x as (select *, row_number() over (partition by case_id, id order by version desc) as rn from ({VERSIONS.replace("v.version as version", "v.version as version, ord")}))
  select case_id, id, name, entity_type from x where rn = 1 and not (ord % 5 = 0 and version < 2)""")
def g_store_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three changes and a deletion in a store of keyed tables, then what it holds."""
    store = GraphStore(spark, shared_folder(spark, "graph"))
    rows = sql(spark, sf_dir, VERSIONS.replace("v.version as version", "v.version as version, ord"))
    for version in (0, 1):
        store.upsert_nodes(rows.where(F.col("version") == version))
    store.delete_nodes(rows.where("version = 0 and ord % 5 = 0"))
    store.upsert_nodes(rows.where("version = 2"))
    return store.nodes.read()


NEW_EDGES = f"select case_id, id, source_id, case when confidence = 0.9 and id like '%7' then 'O_missing' else target_id end as target_id, relationship_type, confidence from edges"


@query(f"""with n as ({NEW_EDGES}), ok as (select n.* from n where (case_id, source_id) in (select case_id, id from nodes) and (case_id, target_id) in (select case_id, id from nodes)) select {EDGE_COLUMNS} from ok""")
def g_upsert_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = sql(spark, sf_dir, NEW_EDGES).withColumn("version", F.lit(1))
    return graph.upsert_edges(new.where("false"), new, nodes(spark, sf_dir)).drop("version")


@query(f"""with n as ({NEW_EDGES}), ok as (select n.* from n where (case_id, source_id) in (select case_id, id from nodes) and (case_id, target_id) in (select case_id, id from nodes))
  select case_id, id, source_id, target_id, relationship_type, case when id like '%3' then 0.25 else confidence end as confidence from ok""")
def g_store_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges into a store: the ends are looked up in it, edges without both are dropped, later ones replace earlier."""
    store = GraphStore(spark, shared_folder(spark, "graph"))
    store.upsert_nodes(nodes(spark, sf_dir))
    new = sql(spark, sf_dir, NEW_EDGES)
    store.upsert_edges(new)
    store.upsert_edges(new.where("id like '%3'").withColumn("confidence", F.lit(0.25)))
    return store.edges.read().select("case_id", "id", "source_id", "target_id", "relationship_type", "confidence")


PREFERRED = "select case_id, id, name, ord from nodes where id like 'N%' or id like 'S%'"


@query(f"""with p as ({PREFERRED}) select case_id, id, case when ord % 3 = 0 then 'second note on ' || name when ord % 2 = 0 then 'note on ' || name else '' end as note,
  case when ord % 4 = 0 and case_id <> 'c3' then '#ef4444' end as colour, case when case_id = 'c3' then 'cose' else 'grid' end as layout from p""")
def g_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes by node and a record of preferences by case, written twice; a case without one has the usual layout."""
    store, own = GraphStore(spark, shared_folder(spark, "graph")), sql(spark, sf_dir, PREFERRED)
    store.upsert_nodes(own.withColumn("entity_type", F.lit("COURT")))
    store.put_notes(own.where("ord % 2 = 0").select("case_id", "id", F.concat(F.lit("note on "), "name").alias("note")))
    store.put_notes(own.where("ord % 3 = 0").select("case_id", "id", F.concat(F.lit("second note on "), "name").alias("note")))
    record = own.where("case_id <> 'c3' and ord % 4 = 0").groupBy("case_id")
    for colour in ("#10b981", "#ef4444"):
        store.put_preferences(record.agg(F.map_from_entries(F.collect_list(F.struct("id", F.lit(colour)))).alias("colours"), F.lit("grid").alias("layout")))
    return store.overlaid().join(store.preferences_of(own.select("case_id")), "case_id").select("case_id", "id", "note", "colour", "layout")


@query(f"""with n as ({NEW_EDGES}) select case_id, relationship_type, count(*) as requested, count(*) filter (where (case_id, source_id) in (select case_id, id from nodes) and (case_id, target_id) in (select case_id, id from nodes)) as written from n group by 1, 2""")
def g_upsert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.upsert_counts(sql(spark, sf_dir, NEW_EDGES), nodes(spark, sf_dir))


EVENTS = "select 'c' || cast(pos % 5 as string) as case_id, event_id as id, event_date, description, canonical_entity_id, pos from timeline"


@query(f"with e as ({EVENTS}) select 'vertex' as kind, case_id, id, cast(null as string) as target from e union all select 'edge', case_id, 'assoc_' || id, 'O' || cast(pos as string) from e where pos % 2 = 0")
def g_upsert_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timeline events become vertices; those with an entity get an association edge."""
    e = sql(spark, sf_dir, EVENTS)
    a = e.select(F.lit("vertex").alias("kind"), "case_id", "id", F.lit(None).cast("string").alias("target"))
    return a.union(e.where("pos % 2 = 0").select(F.lit("edge"), "case_id", F.concat(F.lit("assoc_"), "id"), F.concat(F.lit("O"), F.col("pos").cast("string"))))


@query("select x.relationship_id, x.relationship_type from timeline_edges x where source_event_id in (select event_id from timeline) and target_event_id in (select event_id from timeline)")
def g_upsert_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = frame(spark, sf_dir, "timeline").select(F.lit("t").alias("case_id"), F.col("event_id").alias("id"))
    x = frame(spark, sf_dir, "timeline_edges").select(F.lit("t").alias("case_id"), F.col("relationship_id").alias("id"), F.col("source_event_id").alias("source_id"), F.col("target_event_id").alias("target_id"), "relationship_type")
    return graph.complete(x, ids).select(F.col("id").alias("relationship_id"), "relationship_type")


@query("select id, name, entity_type from nodes where case_id = 'c1'")
def g_case_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.case_entities(nodes(spark, sf_dir), "c1").select("id", "name", "entity_type")


@query("""select e.id, e.relationship_type, e.source_id, s.name as source_name, e.target_id, t.name as target_name, e.confidence from edges e join nodes s on s.case_id = e.case_id and s.id = e.source_id
  join nodes t on t.case_id = e.case_id and t.id = e.target_id where e.case_id = 'c1' and e.relationship_type <> 'ASSOCIATED_WITH'""")
def g_case_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.case_relationships(edges(spark, sf_dir), nodes(spark, sf_dir), "c1").select("id", "relationship_type", "source_id", "source_name", "target_id", "target_name", F.col("confidence").cast("double").alias("confidence"))


@query(f"with e as ({EVENTS}) select e.id, e.event_date, n.id as associated_entity_id, n.name as associated_entity_name from e left join nodes n on n.case_id = e.case_id and n.id = 'O' || cast(e.pos as string) where e.case_id = 'c1'")
def g_timeline_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a case by date and id, each with its entity if that is in the case."""
    e = sql(spark, sf_dir, EVENTS).where("case_id = 'c1'").withColumn("entity", F.concat(F.lit("O"), F.col("pos").cast("string")))
    n = nodes(spark, sf_dir).select("case_id", F.col("id").alias("associated_entity_id"), F.col("name").alias("associated_entity_name"))
    out = e.join(n, (e["case_id"] == n["case_id"]) & (e["entity"] == n["associated_entity_id"]), "left")
    return out.select("id", "event_date", "associated_entity_id", "associated_entity_name").orderBy("event_date", "id")


COMPLETE = f"""select n.case_id, n.entity_count, coalesce(r.c, 0) as relationship_count, coalesce(t.c, 0) as timeline_event_count from (select case_id, count(*) as entity_count from nodes group by 1) n
  left join (select case_id, count(*) as c from edges where relationship_type <> 'ASSOCIATED_WITH' group by 1) r using (case_id) left join (select case_id, count(*) as c from ({EVENTS}) group by 1) t using (case_id)"""


@query(COMPLETE)
def g_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three counts of every case's graph."""
    return graph.counts(nodes(spark, sf_dir), edges(spark, sf_dir).where("relationship_type <> 'ASSOCIATED_WITH'"), sql(spark, sf_dir, EVENTS))


@query(f"""with store as ({COMPLETE}) select case_id, 0 as source_rank, upper(substr(case_id, 1, 1)) || substr(case_id, 2) as title, entity_count, relationship_count, timeline_event_count from store where case_id < 'c3'
  union all select case_id, 1, 'Cached ' || case_id, entity_count, cast(0 as bigint), cast(0 as bigint) from store where case_id = 'c3'
  union all select 'd_' || cast(c_custkey as string), 2, 'D ' || cast(c_custkey as string), cast(0 as bigint), cast(0 as bigint), cast(0 as bigint) from customer where c_custkey < 20
  union all select case_id, 2, 'Parsed', cast(0 as bigint), cast(0 as bigint), cast(0 as bigint) from store where case_id = 'c4'""")
def g_list_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = g_complete(spark, sf_dir)
    zero = F.lit(0).cast("long")
    first = store.where("case_id < 'c3'").withColumn("title", graph.title_of(F.col("case_id")))
    cached = store.where("case_id < 'c4'").select("case_id", "entity_count", zero.alias("relationship_count"), zero.alias("timeline_event_count"), F.concat(F.lit("Cached "), "case_id").alias("title"))
    parsed = store.select("case_id", F.lit("Parsed").alias("title")).union(sql(spark, sf_dir, "select 'd_' || cast(c_custkey as string) as case_id, '' as title from customer where c_custkey < 20").withColumn("title", graph.title_of(F.col("case_id"))))
    return graph.list_cases(first, cached, parsed.select("case_id", "title", zero.alias("entity_count"), zero.alias("relationship_count"), zero.alias("timeline_event_count")))


@query("""select case_id, id, name from nodes where contains(lower(name), 'r 11') or contains(lower(entity_type), 'r 11') or contains(lower(alias), 'r 11') order by ord, id limit 12""")
def g_search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search by way of trigram posting lists."""
    own, at = with_aliases(nodes(spark, sf_dir)), shared_folder(spark, "postings")
    search.build(own, at)
    return search.find(own, at, "R 11").select("case_id", "id", "name")


SEEDS = "select case_id, id from nodes where id in ('P1', 'S3', 'N5')"
BOTH = "both_ways as (select case_id, source_id as id, target_id as other from edges union all select case_id, target_id, source_id from edges)"


@query(f"with {BOTH}, seeds as ({SEEDS}) select case_id, id from seeds union select b.case_id, b.other from both_ways b join seeds s on s.case_id = b.case_id and s.id = b.id")
def g_neighbors_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(edges(spark, sf_dir), sql(spark, sf_dir, SEEDS), 1)


SOME = "select case_id, id from nodes where id in ('P1', 'S3')"


@query(f"""with {BOTH}, h0 as ({SOME}), h1 as (select * from h0 union select b.case_id, b.other from both_ways b join h0 using (case_id, id)), h2 as (select * from h1 union select b.case_id, b.other from both_ways b join h1 using (case_id, id))
  select n.case_id, n.id from nodes n join h2 using (case_id, id) where {CATEGORY} = 'PARTY_LEGAL_ACTOR'""")
def g_neighbors_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hops over all edges, then the people among them."""
    near = graph.neighbours(edges(spark, sf_dir), sql(spark, sf_dir, SOME), 2)
    return graph.in_view(nodes(spark, sf_dir), "people").join(near, graph.NODE, "left_semi").select("case_id", "id")


@query(f"select case_id, id, entity_type, {CATEGORY} as category from nodes where {CATEGORY} = 'DOCUMENTARY_EVIDENCE'")
def g_view_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.in_view(nodes(spark, sf_dir), "evidence", ["DOCUMENTARY_EVIDENCE", "CASE_MATTER"])
    return found.select("case_id", "id", "entity_type", ontology.category_of(F.col("entity_type")).alias("category"))


@query(f"""with v as (select case_id, id from nodes where {CATEGORY} in ('PARTY_LEGAL_ACTOR', 'CASE_MATTER')) select {EDGE_COLUMNS} from edges where relationship_type in ('PLAINTIFF_IN', 'FILED_IN')
  and (case_id, source_id) in (select case_id, id from v) and (case_id, target_id) in (select case_id, id from v)""")
def g_visible_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.visible_edges(edges(spark, sf_dir), graph.in_view(nodes(spark, sf_dir), categories=["PARTY_LEGAL_ACTOR", "CASE_MATTER"]), ["PLAINTIFF_IN", "FILED_IN"])


@query(f"select 'category' as facet, {CATEGORY} as value, count(*) as n from nodes group by 2 union all select 'relationship_type', relationship_type, count(*) from edges group by 2")
def g_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.facets(nodes(spark, sf_dir), edges(spark, sf_dir))


@query("select case_id, id, name from nodes where contains(lower(name), 'machine') or contains(lower(entity_type), 'machine') or contains(alias, 'machine') order by ord, id limit 12")
def g_search_top12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.search(with_aliases(nodes(spark, sf_dir)), "Machine").select("case_id", "id", "name")


GONE = "select case_id, id from nodes where id like 'O%9' or id = 'S1'"


@query(f"with g as ({GONE}) select g.case_id, g.id, count(distinct e.id) as detached from g left join edges e on e.case_id = g.case_id and (e.source_id = g.id or e.target_id = g.id) group by 1, 2")
def g_delete_detach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.delete_detach(nodes(spark, sf_dir), edges(spark, sf_dir), sql(spark, sf_dir, GONE))[2]


@query(f"with g as ({GONE}) select {EDGE_COLUMNS} from edges e where (case_id, source_id) not in (select case_id, id from g) and (case_id, target_id) not in (select case_id, id from g)")
def g_delete_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.delete_detach(nodes(spark, sf_dir), edges(spark, sf_dir), sql(spark, sf_dir, GONE))[1]


@query("select case_id, id, case when id like 'S%' and ord % 5 = 0 then 'Renamed ' || name else name end as name, case when id like 'S%' and ord % 5 = 0 and ord % 2 = 0 then 'ORGANIZATION' else entity_type end as entity_type from nodes where id like 'S%'")
def g_update_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = nodes(spark, sf_dir).where("id like 'S%'")
    changes = own.where("ord % 5 = 0").select("case_id", "id", F.concat(F.lit("Renamed "), "name").alias("name"), F.when(F.col("ord") % 2 == 0, "ORGANIZATION").alias("entity_type"))
    return graph.update(own, changes, ["name", "entity_type"]).select("case_id", "id", "name", "entity_type")


REQUESTS = "select case_id, id, source_id, case when id like '%3' then source_id when id like '%5' then 'nobody' else target_id end as target_id, case when id like '%8' then 'OWNS' else relationship_type end as relationship_type from edges where relationship_type <> 'ASSOCIATED_WITH'"


@query(f"""with q as ({REQUESTS}) select q.id, case when q.source_id = q.target_id then 'SELF_LOOP' when s.id is null or t.id is null then 'MISSING' when c.source_type is null then 'INVALID_TRIPLET' else 'OK' end as outcome from q
  left join nodes s on s.case_id = q.case_id and s.id = q.source_id left join nodes t on t.case_id = q.case_id and t.id = q.target_id
  left join dim_closure c on c.source_type = s.entity_type and c.relationship_type = q.relationship_type and c.target_type = t.entity_type""")
def g_create_edge_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.check_new_edges(sql(spark, sf_dir, REQUESTS), nodes(spark, sf_dir)).select("id", "outcome")


@query("select case_id, count(*) as n from nodes where case_id <> 'c2' group by 1")
def g_clear_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.clear_case(nodes(spark, sf_dir), "c2").groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))


@query("select case_id, id, case when ord % 3 = 0 then 'note on ' || name else '' end as note, case when ord % 4 = 0 then '#10b981' end as colour from nodes where id like 'N%' or id like 'S%'")
def g_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = nodes(spark, sf_dir).where("id like 'N%' or id like 'S%'")
    notes = own.where("ord % 3 = 0").select("case_id", "id", F.concat(F.lit("note on "), "name").alias("note"))
    colours = own.where("ord % 4 = 0").select("case_id", "id", F.lit("#10b981").alias("colour"))
    return graph.overlay(own, notes, colours).select("case_id", "id", "note", "colour")


@query(f"select {EDGE_COLUMNS} from edges where source_id = 'P7' or target_id = 'P7'")
def g_connected_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.connected_edges(edges(spark, sf_dir), "P7")


DECISIONS = """select case_id, id, k.k as at, case k.k when 0 then 'HUMAN_APPROVED' else 'HUMAN_CORRECTED' end as trust_status, case when k.k = 1 then 'Corrected ' || name else cast(null as string) end as name, cast(null as string) as entity_type
  from nodes cross join (select 0 as k union all select 1) k where (id like 'S%' or id like 'N%') and ord % (k.k + 2) = 0"""


@query("""select case_id, id, case when ord % 3 = 0 then 'Corrected ' || name else name end as name, entity_type, case when ord % 3 = 0 then 'HUMAN_CORRECTED' when ord % 2 = 0 then 'HUMAN_APPROVED' else 'UNREVIEWED' end as trust_status
  from nodes where id like 'S%' or id like 'N%'""")
def h_trust_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = nodes(spark, sf_dir).where("id like 'S%' or id like 'N%'").select("case_id", "id", "name", "entity_type")
    return graph.trust(own, sql(spark, sf_dir, DECISIONS), ["name", "entity_type"])


MERGES = "select a.case_id, a.id as primary_id, b.id as secondary_id from nodes a join nodes b on a.case_id = b.case_id and a.id like 'S%' and b.id like 'S%' and b.ord = a.ord + 3 where a.ord % 6 = 0"


@query(f"""with m as ({MERGES}) select e.case_id, e.id, case when s.primary_id = e.target_id or t.primary_id = e.source_id then e.source_id else coalesce(s.primary_id, e.source_id) end as source_id,
  case when s.primary_id = e.target_id or t.primary_id = e.source_id then e.target_id else coalesce(t.primary_id, e.target_id) end as target_id, e.relationship_type, e.confidence
  from edges e left join m s on s.case_id = e.case_id and s.secondary_id = e.source_id left join m t on t.case_id = e.case_id and t.secondary_id = e.target_id""")
def h_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.merge(with_aliases(nodes(spark, sf_dir)), edges(spark, sf_dir), sql(spark, sf_dir, MERGES))[1]


@query(f"""with m as ({MERGES}), more as (select m.case_id, m.primary_id as id, n.name, n.alias from m join nodes n on n.case_id = m.case_id and n.id = m.secondary_id)
  select n.case_id, n.id, w.primary_id as merged_into, (select string_agg(distinct x, ',' order by x) from (select n.alias as x union all select o.alias from more o where o.case_id = n.case_id and o.id = n.id union all select o.name from more o where o.case_id = n.case_id and o.id = n.id)) as aliases
  from nodes n left join m w on w.case_id = n.case_id and w.secondary_id = n.id where n.id like 'S%'""")
def h_merge_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.merge(with_aliases(nodes(spark, sf_dir)), edges(spark, sf_dir), sql(spark, sf_dir, MERGES))[0]
    return found.where("id like 'S%'").select("case_id", "id", "merged_into", F.array_join("aliases", ",").alias("aliases"))


# Chains of twenty merges in rising time, others in falling time, and cycles of three.
MEMBERS = "select case_id, id, k, floor(k / 24) as g, k % 24 as j from (select case_id, id, row_number() over (partition by case_id order by ord) - 1 as k from nodes where id like 'P%') x"
CHAINED = f"""select a.case_id, b.id as primary_id, a.id as secondary_id, cast(a.g * 100 + case when a.j > 20 then 59 + a.j when a.g % 2 = 0 then a.j else 60 - a.j end as bigint) as seq_no
  from ({MEMBERS}) a join ({MEMBERS}) b on b.case_id = a.case_id and b.k = case when a.j = 23 then a.k - 2 else a.k + 1 end where a.j < 20 or a.j > 20"""
CHAIN_EDGES = f"""select a.case_id, 'F' || cast(b.k - a.k as string) || '_' || a.id as id, a.id as source_id, b.id as target_id from ({MEMBERS}) a join ({MEMBERS}) b on b.case_id = a.case_id and b.k in (a.k + 1, a.k + 5)
  union all select case_id, id, source_id, target_id from edges where id like 'E1%'"""
# The same with a row for each of the two steps: Spark joins by equal keys, not by a list, and would pair all members of a case. Steps
# of a cross join it would put off until members had met by case alone, which pairs them too; what explode makes stays where it is.
CHAIN_STEPS = CHAIN_EDGES.replace(f"from ({MEMBERS}) a join", f"from (select *, explode(array(k + 1, k + 5)) as step from ({MEMBERS}) x) a join").replace("b.k in (a.k + 1, a.k + 5)", "b.k = a.step")
# Ids tell the kinds of edges and nodes apart only row by row; types are constants of a kind, so Spark leaves the other kinds out.
OF_KIND = {"where id like 'E1%'": "where id like 'E1%' and relationship_type = 'PLAINTIFF_IN'", "where id like 'P%'": "where id like 'P%' and entity_type = 'PERSON'"}


def _of_kind(text: str) -> str:
    for a, b in OF_KIND.items():
        text = text.replace(a, b)
    return text


CHAIN_SQL = f"""with recursive ev as ({CHAINED}),
  nx as (select *, (select min(f.seq_no) from ev f where f.case_id = e.case_id and f.secondary_id = e.primary_id and f.seq_no > e.seq_no) as onward, (select min(f.seq_no) from ev f where f.case_id = e.case_id and f.secondary_id = e.secondary_id and f.seq_no > e.seq_no) as again from ev e),
  fst as (select case_id, secondary_id as s, min(seq_no) as n from ev group by 1, 2), g as ({CHAIN_EDGES})"""


def _chained(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = with_aliases(nodes(spark, sf_dir)).where("id like 'P%' and entity_type = 'PERSON'")
    return own, merging.merge_events(own, sql(spark, sf_dir, _of_kind(CHAINED)).withColumnRenamed("seq_no", "at"))


@query(f"""{CHAIN_SQL}, st as (select g.case_id, g.id, g.source_id as u, g.target_id as v, a.n as x, b.n as y from g left join fst a on a.case_id = g.case_id and a.s = g.source_id left join fst b on b.case_id = g.case_id and b.s = g.target_id
    union all
    select st.case_id, st.id, case when coalesce(x, 1e18) < coalesce(y, 1e18) and a.primary_id <> v then a.primary_id else u end, case when coalesce(y, 1e18) < coalesce(x, 1e18) and b.primary_id <> u then b.primary_id else v end,
      case when coalesce(x, 1e18) < coalesce(y, 1e18) then case when a.primary_id = v then a.again else a.onward end else x end, case when coalesce(y, 1e18) < coalesce(x, 1e18) then case when b.primary_id = u then b.again else b.onward end else y end
    from st left join nx a on a.case_id = st.case_id and a.seq_no = st.x left join nx b on b.case_id = st.case_id and b.seq_no = st.y where x is not null or y is not null)
  select case_id, id, u as source_id, v as target_id from st where x is null and y is null""")
def h_merge_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where edges are after merges that build on each other."""
    return merging.merged_edges(sql(spark, sf_dir, _of_kind(CHAIN_STEPS)), _chained(spark, sf_dir)[1])


@query(f"""{CHAIN_SQL}, r as (select case_id, secondary_id as o, primary_id as x, seq_no as n from ev union select r.case_id, r.o, e.primary_id, e.seq_no from r join ev e on e.case_id = r.case_id and e.secondary_id = r.x and e.seq_no > r.n),
  own as (select case_id, id, alias as a from nodes where id like 'P%' union select r.case_id, r.x, n.name from r join nodes n on n.case_id = r.case_id and n.id = r.o union select r.case_id, r.x, n.alias from r join nodes n on n.case_id = r.case_id and n.id = r.o),
  al as (select case_id, id, string_agg(distinct a, ',' order by a) as aliases from own group by 1, 2), li as (select case_id, secondary_id as id, arg_max(primary_id, seq_no) as merged_into from ev group by 1, 2)
  select al.case_id, al.id, merged_into, aliases, exists (select 1 from r where r.case_id = al.case_id and r.x = al.id and r.o = al.id) as in_cycle from al left join li using (case_id, id)""")
def h_merge_chain_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whose names a node has after merges that build on each other, and whether its own came back to it."""
    return merging.merged_nodes(*_chained(spark, sf_dir)).select("case_id", "id", "merged_into", F.array_join("aliases", ",").alias("aliases"), "in_cycle")


CONSISTENT = "select id, source_id, case when id like 'E1%5' then 'gone' else target_id end as target_id, id not like 'E2%3' as is_valid from edges"


@query(f"""with e as ({CONSISTENT}), ids as (select distinct id from nodes), c as (select count(*) as total_edges, count(*) filter (where source_id not in (select id from ids) or target_id not in (select id from ids)) as dangling_edges, count(*) filter (where not is_valid) as invalid_triplets from e),
  o as (select count(*) as total_nodes, count(*) filter (where id not in (select source_id from e) and id not in (select target_id from e)) as orphan_nodes from ids)
  select *, round(greatest(0, total_edges - dangling_edges - invalid_triplets) / total_edges, 4) as consistency_score from o, c""")
def e_graph_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.consistency(nodes(spark, sf_dir), sql(spark, sf_dir, CONSISTENT))
