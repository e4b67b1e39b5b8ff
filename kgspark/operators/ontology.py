"""The controlled vocabulary: entity types, relationship types and the triplets that are allowed between them.

All tables here are of fixed size (25 types, 24 relationships, 502 triplets, 629 with inheritance), which bounds every
broadcast of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

# Entity types as (type, category, parent).
ENTITY_TYPES = [
    ("CASE", "CASE_MATTER", None),
    ("PERSON", "PARTY_LEGAL_ACTOR", None),
    ("LAWYER", "PARTY_LEGAL_ACTOR", "PERSON"),
    ("JUDGE", "PARTY_LEGAL_ACTOR", "PERSON"),
    ("WITNESS", "PARTY_LEGAL_ACTOR", "PERSON"),
    ("ORGANIZATION", "PARTY_LEGAL_ACTOR", None),
    ("COMPANY", "PARTY_LEGAL_ACTOR", "ORGANIZATION"),
    ("LAW_FIRM", "PARTY_LEGAL_ACTOR", "ORGANIZATION"),
    ("GOVERNMENT_AGENCY", "PARTY_LEGAL_ACTOR", "ORGANIZATION"),
    ("COURT", "PARTY_LEGAL_ACTOR", None),
    ("STATUTE", "LEGAL_SOURCE_NORMATIVE", None),
    ("REGULATION", "LEGAL_SOURCE_NORMATIVE", None),
    ("LEGAL_CONCEPT", "LEGAL_SOURCE_NORMATIVE", None),
    ("LEGAL_ISSUE", "CASE_MATTER", None),
    ("CLAIM", "CASE_MATTER", None),
    ("DOCUMENT", "DOCUMENTARY_EVIDENCE", None),
    ("CONTRACT", "DOCUMENTARY_EVIDENCE", "DOCUMENT"),
    ("EVIDENCE", "DOCUMENTARY_EVIDENCE", None),
    ("EXHIBIT", "DOCUMENTARY_EVIDENCE", "EVIDENCE"),
    ("FILING", "DOCUMENTARY_EVIDENCE", "DOCUMENT"),
    ("TESTIMONY", "DOCUMENTARY_EVIDENCE", "EVIDENCE"),
    ("EVENT", "TEMPORAL_EVENT", None),
    ("DATE", "TEMPORAL_EVENT", None),
    ("DEADLINE", "TEMPORAL_EVENT", None),
    ("HEARING", "TEMPORAL_EVENT", "EVENT"),
]
# Relationship types as (type, inverse, sources, targets).
RELATIONSHIPS = [
    ("PLAINTIFF_IN", None, "PERSON LAWYER ORGANIZATION COMPANY LAW_FIRM GOVERNMENT_AGENCY", "CASE"),
    ("DEFENDANT_IN", None, "PERSON LAWYER ORGANIZATION COMPANY LAW_FIRM GOVERNMENT_AGENCY", "CASE"),
    ("REPRESENTED_BY", "REPRESENTS", "PERSON ORGANIZATION COMPANY GOVERNMENT_AGENCY CASE", "LAWYER LAW_FIRM"),
    ("DECIDED_BY", None, "CASE LEGAL_ISSUE CLAIM HEARING FILING", "JUDGE COURT"),
    ("FILED_IN", None, "CASE FILING DOCUMENT CONTRACT EVIDENCE EXHIBIT", "COURT CASE"),
    ("CITES", None, "CASE DOCUMENT CONTRACT FILING TESTIMONY STATUTE REGULATION", "CASE STATUTE REGULATION DOCUMENT CONTRACT"),
    ("APPLIES", None, "CASE JUDGE COURT FILING DOCUMENT", "STATUTE REGULATION LEGAL_CONCEPT LEGAL_ISSUE"),
    ("INTERPRETS", None, "CASE JUDGE COURT DOCUMENT FILING", "STATUTE REGULATION CONTRACT LEGAL_CONCEPT"),
    ("OVERRULES", None, "CASE COURT", "CASE"),
    ("FOLLOWS", None, "CASE COURT", "CASE"),
    ("DISTINGUISHES", None, "CASE COURT FILING", "CASE"),
    ("SUPPORTED_BY", None, "CLAIM LEGAL_ISSUE FILING TESTIMONY CASE", "EVIDENCE EXHIBIT TESTIMONY DOCUMENT STATUTE REGULATION CONTRACT"),
    ("CONTRADICTED_BY", None, "CLAIM LEGAL_ISSUE TESTIMONY EVIDENCE FILING", "EVIDENCE EXHIBIT TESTIMONY DOCUMENT"),
    ("EVIDENCED_BY", None, "CLAIM LEGAL_ISSUE EVENT HEARING CASE", "EVIDENCE EXHIBIT DOCUMENT TESTIMONY CONTRACT"),
    ("MENTIONED_IN", None, "*", "DOCUMENT FILING CONTRACT TESTIMONY EXHIBIT CASE"),
    ("WORKS_FOR", None, "PERSON LAWYER WITNESS", "ORGANIZATION COMPANY LAW_FIRM GOVERNMENT_AGENCY COURT"),
    ("EMPLOYED_BY", None, "PERSON LAWYER WITNESS", "ORGANIZATION COMPANY LAW_FIRM GOVERNMENT_AGENCY COURT"),
    ("OWNS", None, "PERSON ORGANIZATION COMPANY LAW_FIRM GOVERNMENT_AGENCY", "COMPANY ORGANIZATION EVIDENCE EXHIBIT DOCUMENT CONTRACT"),
    ("REPRESENTS", "REPRESENTED_BY", "LAWYER LAW_FIRM", "PERSON ORGANIZATION COMPANY GOVERNMENT_AGENCY CASE"),
    ("OCCURRED_ON", None, "EVENT HEARING FILING DOCUMENT CONTRACT CASE", "DATE"),
    ("OCCURRED_IN", None, "EVENT HEARING TESTIMONY DOCUMENT", "CASE COURT"),
    ("BEFORE", "AFTER", "EVENT HEARING DATE DEADLINE FILING", "EVENT HEARING DATE DEADLINE FILING"),
    ("AFTER", "BEFORE", "EVENT HEARING DATE DEADLINE FILING", "EVENT HEARING DATE DEADLINE FILING"),
    ("HAS_DEADLINE", None, "CASE FILING HEARING EVENT LEGAL_ISSUE CLAIM", "DEADLINE DATE"),
]
TYPES = [t for t, _, _ in ENTITY_TYPES]
CATEGORY = {t: c for t, c, _ in ENTITY_TYPES}
RELATIONSHIP_TYPES = [r[0] for r in RELATIONSHIPS]


def triplets() -> list[tuple[str, str, str]]:
    """Every triplet that the vocabulary names."""
    return [(s, r, t) for r, _, sources, targets in RELATIONSHIPS for s in (TYPES if sources == "*" else sources.split()) for t in targets.split()]


def closed_triplets() -> list[tuple[str, str, str]]:
    """With inheritance: either end may be a subtype of what is named."""
    parent = {t: p for t, _, p in ENTITY_TYPES}
    own: dict[str, set[str]] = {}
    for t in TYPES:
        own[t], up = set(), t
        while up:
            own[t].add(up)
            up = parent[up]
    named = set(triplets())
    return [(s, r, t) for r in RELATIONSHIP_TYPES for s in TYPES for t in TYPES if any((a, r, b) in named for a in own[s] for b in own[t])]


def entity_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENTITY_TYPES, "entity_type string, category string, parent string")


def relationship_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r[0], r[1], True) for r in RELATIONSHIPS], "relationship_type string, inverse string, is_directed boolean")


def triplet_dim(spark: SparkSession, closed: bool = True) -> DataFrame:
    return spark.createDataFrame(closed_triplets() if closed else triplets(), "source_type string, relationship_type string, target_type string")


def hierarchy(types: DataFrame) -> DataFrame:
    """Each type with itself (depth 0) and all its ancestors, however many levels and types there are. types: entity_type, parent.

    Jumps to ancestors 1, 2, 4 and so on levels up are made from each other, and a depth is walked by its binary digits, so the
    rounds grow with the logarithm of the depth. Jumps lie in shared storage. A cycle fails instead of giving part of the answer.
    """
    spark = types.sparkSession

    def written(df: DataFrame) -> DataFrame:
        at = shared_folder(spark, "hierarchy")
        df.write.parquet(at)
        return spark.read.schema(df.schema).parquet(at)

    own = written(types.select("entity_type", "parent"))
    jump, jumps = own.where("entity_type is not null and parent is not null").select(F.col("entity_type").alias("ancestor"), F.col("parent").alias("to")), []
    while not jump.isEmpty():
        # No way without a cycle is longer than there are types.
        if 2 ** len(jumps) > 1 and 2 ** len(jumps) > own.select("entity_type").distinct().count():
            raise ValueError("the hierarchy has a cycle")
        jumps.append(jump)
        again = jump.select(F.col("ancestor").alias("to"), F.col("to").alias("further"))
        jump = written(jump.join(again, "to").select("ancestor", F.col("further").alias("to")))
    up = own.select("entity_type", F.col("entity_type").alias("ancestor"), F.lit(0).alias("depth"))
    stays = lambda: F.struct(F.col("ancestor"), F.lit(0).alias("by"))
    for k, jump in enumerate(jumps):
        on = jump.groupBy("ancestor").agg(F.collect_list(F.struct(F.col("to").alias("ancestor"), F.lit(2**k).alias("by"))).alias("on"))
        ways = F.explode(F.concat(F.array(stays()), F.coalesce("on", F.array().cast("array<struct<ancestor:string,by:int>>"))))
        up = up.join(on, "ancestor", "left").select("entity_type", "depth", ways.alias("x")).select("entity_type", F.col("x.ancestor").alias("ancestor"), (F.col("depth") + F.col("x.by")).alias("depth"))
    return up


def with_inherited_check(facts: DataFrame, types: DataFrame, named: DataFrame, to: str = "triplet_ok") -> DataFrame:
    """facts (source_type, relation_type, target_type) with a flag: whether the triplet, or one of supertypes of either end, is
    named.

    Types take up what is named for their ancestors, either end by itself, and a fact meets one row of each: what its source
    may have as target by its relation, and what its target counts as. So no pair of types is ever made. Both lists hold
    named types of the ancestors only.
    """
    up = hierarchy(types).select("entity_type", "ancestor")
    allowed = up.join(named.withColumnRenamed("source_type", "ancestor"), "ancestor").groupBy(F.col("entity_type").alias("source_type"), F.col("relationship_type").alias("relation_type")).agg(F.collect_set("target_type").alias("_allowed"))
    counts = up.join(named.select(F.col("target_type").alias("ancestor")).distinct(), "ancestor").groupBy(F.col("entity_type").alias("target_type")).agg(F.collect_set("ancestor").alias("_counts"))
    found = facts.join(allowed, ["source_type", "relation_type"], "left").join(counts, "target_type", "left")
    return found.withColumn(to, F.coalesce(F.arrays_overlap("_allowed", "_counts"), F.lit(False))).select(*facts.columns, to)


def is_entity_type(c: Column) -> Column:
    return F.coalesce(c.isin(TYPES), F.lit(False))


def is_relationship_type(c: Column) -> Column:
    return F.coalesce(c.isin(RELATIONSHIP_TYPES), F.lit(False))


def category_of(c: Column) -> Column:
    """Category of a type in any case; unknown types count as parties, as in the client's view."""
    out: Column = F.lit("PARTY_LEGAL_ACTOR")
    for category in dict.fromkeys(CATEGORY.values()):
        out = F.when(F.upper(c).isin([t for t in TYPES if CATEGORY[t] == category]), category).otherwise(out)
    return out


def with_triplet_check(relations: DataFrame, source: str = "source_type", relation: str = "relation_type", target: str = "target_type", to: str = "triplet_ok") -> DataFrame:
    """relations with a flag: whether the triplet is allowed, inheritance included (a broadcast of 629 rows)."""
    allowed = triplet_dim(relations.sparkSession).select(F.col("source_type").alias("__s"), F.col("relationship_type").alias("__r"), F.col("target_type").alias("__t"), F.lit(True).alias("__ok"))
    joined = relations.join(F.broadcast(allowed), (F.col(source) == F.col("__s")) & (F.col(relation) == F.col("__r")) & (F.col(target) == F.col("__t")), "left")
    return joined.withColumn(to, F.coalesce("__ok", F.lit(False))).drop("__s", "__r", "__t", "__ok")


def usage(facts: DataFrame, closed: bool) -> DataFrame:
    """Every allowed triplet, and how many facts (source_type, relation_type, target_type) are of it."""
    own = facts.groupBy("source_type", F.col("relation_type").alias("relationship_type"), "target_type").agg(F.count(F.lit(1)).alias("n"))
    return triplet_dim(facts.sparkSession, closed).join(own, ["source_type", "relationship_type", "target_type"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def editor_matrix(nodes: DataFrame) -> DataFrame:
    """What an editor may offer in each case: for every source type that the case has and every relationship the target types
    that it has, sorted, joined by commas. nodes: case_id, entity_type."""
    own = nodes.select("case_id", "entity_type").distinct()
    named = F.broadcast(triplet_dim(nodes.sparkSession, closed=False))
    pairs = own.withColumnRenamed("entity_type", "source_type").join(named, "source_type").join(own.withColumnRenamed("entity_type", "target_type"), ["case_id", "target_type"])
    return pairs.groupBy("case_id", "source_type", "relationship_type").agg(F.array_join(F.array_sort(F.collect_set("target_type")), ",").alias("targets"))


def ontology_spec(mentions: DataFrame, facts: DataFrame) -> DataFrame:
    """The vocabulary as an export: a row per entity or relationship type, with what it may stand between and how often the
    corpus has it. mentions: entity_type; facts: relation_type."""
    spark = mentions.sparkSession
    named = triplet_dim(spark, closed=False)
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    between = named.groupBy("relationship_type").agg(listed("source_type").alias("sources"), listed("target_type").alias("targets"))
    none = F.lit(None).cast("string")
    types = entity_dim(spark).select(F.lit("entity").alias("kind"), F.col("entity_type").alias("name"), "category", "parent", none.alias("inverse"), none.alias("sources"), none.alias("targets"))
    rels = relationship_dim(spark).join(between, "relationship_type").select(F.lit("relationship"), "relationship_type", none, none, "inverse", "sources", "targets")
    seen = mentions.groupBy(F.lit("entity").alias("kind"), F.col("entity_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    seen = seen.union(facts.groupBy(F.lit("relationship"), "relation_type").agg(F.count(F.lit(1))))
    return types.union(rels).join(seen, ["kind", "name"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


# Thresholds that a joint extraction model is configured with.
ENTITY_THRESHOLD, RELATION_THRESHOLD = 0.50, 0.55


def model_config(mentions: DataFrame) -> DataFrame:
    """What a joint extraction model is told of a corpus, as one row of JSON: the labels that it has, the pairs allowed between
    these, counts, thresholds. mentions: entity_type."""
    spark = mentions.sparkSession
    own = entity_dim(spark).select("entity_type").join(mentions.select("entity_type").distinct(), "entity_type", "left_semi")
    side = lambda c: F.broadcast(own.select(F.col("entity_type").alias(c)))
    named = triplet_dim(spark, closed=False).join(side("source_type"), "source_type", "left_semi").join(side("target_type"), "target_type", "left_semi")
    pairs = named.agg(F.array_sort(F.collect_list(F.struct(F.col("relationship_type").alias("relation"), F.col("source_type").alias("head"), F.col("target_type").alias("tail")))).alias("allowed_pairs"))
    labels = own.agg(F.array_sort(F.collect_list("entity_type")).alias("entity_labels"))
    relations = F.array_sort(F.array_distinct(F.transform("allowed_pairs", lambda p: p["relation"])))
    config = F.struct(
        "entity_labels", relations.alias("relation_labels"), "allowed_pairs", F.size("entity_labels").alias("num_entity_types"), F.size(relations).alias("num_relation_types"), F.size("allowed_pairs").alias("num_valid_pairs"),
        F.struct(F.lit(ENTITY_THRESHOLD).alias("entity_threshold"), F.lit(RELATION_THRESHOLD).alias("relation_threshold")).alias("threshold_config"),
    )
    # One row on either side.
    return pairs.crossJoin(labels).select(F.to_json(config).alias("config"))


# Statements that a graph store's schema consists of, one of each for every entity type.
STORE_STATEMENTS = [
    "CREATE CONSTRAINT constraint_{low}_id_unique IF NOT EXISTS FOR (n:`{name}`) REQUIRE n.id IS UNIQUE;",
    "CREATE INDEX index_{low}_case_id IF NOT EXISTS FOR (n:`{name}`) ON (n.case_id);",
    "CREATE INDEX index_{low}_name IF NOT EXISTS FOR (n:`{name}`) ON (n.name);",
    "CREATE CONSTRAINT constraint_{low}_provenance_case IF NOT EXISTS FOR (n:`{name}`) REQUIRE n.case_id IS NOT NULL;",
]


# Fixed value: how the schema lists what a relationship may stand between.
RELATIONSHIP_LINE = ("// Relationship: [", "] | Sources: ", " | Targets: ")


def store_ddl(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """statement: constraints and indexes of a property graph store for the entity types that nodes have, and a line for each
    relationship type that edges have. nodes: entity_type; edges: relationship_type."""
    spark = nodes.sparkSession
    fill = lambda x: F.replace(F.replace(F.lit(x), F.lit("{low}"), F.lower("entity_type")), F.lit("{name}"), F.col("entity_type"))
    types = entity_dim(spark).join(nodes.select("entity_type").distinct(), "entity_type", "left_semi")
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ", ")
    own = triplet_dim(spark, closed=False).join(edges.select("relationship_type").distinct(), "relationship_type", "left_semi")
    head, sources, targets = (F.lit(x) for x in RELATIONSHIP_LINE)
    lines = own.groupBy("relationship_type").agg(F.concat(head, F.first("relationship_type"), sources, listed("source_type"), targets, listed("target_type")).alias("statement")).select("statement")
    return types.select(F.explode(F.array(*[fill(x) for x in STORE_STATEMENTS])).alias("statement")).union(lines)


def rule_schema(facts: DataFrame) -> DataFrame:
    """For each relationship the types on either side with their subtypes, as rule authors need them, and how many facts
    (source_type, relation_type, target_type) the rule lets pass."""
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return usage(facts, closed=True).groupBy("relationship_type").agg(listed("source_type").alias("sources"), listed("target_type").alias("targets"), F.count(F.lit(1)).alias("triplets"), F.sum("n").alias("n_facts"))


def row_errors(rows: DataFrame) -> DataFrame:
    """rows (case_id, document_id, confidence, page_number, start_offset, end_offset, start_date, end_date) with `errors`:
    the rules that fail, and `first_error`: the one that would be raised."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rules = [
        (blank("case_id"), "EMPTY_CASE_ID"),
        (blank("document_id"), "EMPTY_DOCUMENT_ID"),
        (~F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False)), "CONFIDENCE_RANGE"),
        (F.col("page_number") < 1, "PAGE_RANGE"),
        ((F.col("start_offset") < 0) | (F.col("start_offset") >= F.col("end_offset")), "SPAN_ORDER"),
        (F.col("start_date") > F.col("end_date"), "DATE_ORDER"),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in rules]))
    return rows.withColumn("errors", found).withColumn("first_error", F.get(F.col("errors"), F.lit(0)))


def is_overdue(deadline: Column, status: Column, now: Column) -> Column:
    return F.coalesce((status.isNull() | (status != "COMPLETED")) & (now > deadline), F.lit(False))
