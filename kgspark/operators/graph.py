"""The property graph as two tables, nodes and edges, both keyed within a case.

Reads are joins and filters that Catalyst plans: a case_id predicate prunes partitions of tables written by case. Writes are
folds: the latest version of a key wins. Nothing here needs a graph library; a neighbourhood of k hops is k joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ontology
from .resolve import latest

NODE, EDGE = ["case_id", "id"], ["case_id", "id"]
VIEW = {"evidence": "DOCUMENTARY_EVIDENCE", "people": "PARTY_LEGAL_ACTOR", "authorities": "LEGAL_SOURCE_NORMATIVE", "timeline": "TEMPORAL_EVENT"}


def ends(edges: DataFrame, nodes: DataFrame, how: str = "inner") -> DataFrame:
    """Edges with the name and type of both ends, found in the same case."""
    side = lambda p: nodes.select("case_id", F.col("id").alias(f"{p}_id"), F.col("name").alias(f"{p}_name"), F.col("entity_type").alias(f"{p}_type"))
    return edges.join(side("source"), ["case_id", "source_id"], how).join(side("target"), ["case_id", "target_id"], how)


def complete(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are among the nodes."""
    keys = nodes.select("case_id", "id")
    out = edges.join(keys.select("case_id", F.col("id").alias("source_id")), ["case_id", "source_id"], "left_semi")
    return out.join(keys.select("case_id", F.col("id").alias("target_id")), ["case_id", "target_id"], "left_semi").select(edges.columns)


def upsert(stored: DataFrame, new: DataFrame, key: list[str] = NODE, version: str = "version") -> DataFrame:
    """New rows replace stored ones of the same key, all properties at once; of several the last version."""
    return latest(stored.unionByName(new, allowMissingColumns=True), key, [version])


def upsert_edges(stored: DataFrame, new: DataFrame, nodes: DataFrame, version: str = "version") -> DataFrame:
    """As upsert; edges without both ends are dropped. Versions of an edge are few, so rows are sorted once they are together only,
    not also in the tasks that look the ends up and sort for that."""
    rows = stored.unionByName(complete(new, nodes), allowMissingColumns=True)
    return latest(rows.repartition(*EDGE), EDGE, [version])


def upsert_counts(new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per case and type: edges asked for, and edges written."""
    written = complete(new, nodes).select(*EDGE, F.lit(1).alias("w"))
    return new.join(written, EDGE, "left").groupBy("case_id", "relationship_type").agg(F.count(F.lit(1)).alias("requested"), F.sum(F.coalesce("w", F.lit(0))).alias("written"))


def case_entities(nodes: DataFrame, case_id: str) -> DataFrame:
    return nodes.where(F.col("case_id") == case_id).orderBy("name", "id")


def case_relationships(edges: DataFrame, nodes: DataFrame, case_id: str) -> DataFrame:
    """Without association edges, ordered by id."""
    own = edges.where((F.col("case_id") == case_id) & (F.col("relationship_type") != "ASSOCIATED_WITH"))
    return ends(own, nodes.where(F.col("case_id") == case_id)).orderBy("id")


def counts(nodes: DataFrame, edges: DataFrame, events: DataFrame) -> DataFrame:
    """Entities, relationships and events of each case that has entities."""
    n = lambda df, name: df.groupBy("case_id").agg(F.count(F.lit(1)).alias(name))
    out = n(nodes, "entity_count").join(n(edges, "relationship_count"), "case_id", "left").join(n(events, "timeline_event_count"), "case_id", "left")
    return out.na.fill(0, ["relationship_count", "timeline_event_count"])


def list_cases(*sources: DataFrame) -> DataFrame:
    """Summaries (case_id, title, entity_count, relationship_count, timeline_event_count) of several sources, the first
    source that knows a case wins; sorted by case."""
    ranked = [s.withColumn("source_rank", F.lit(i)) for i, s in enumerate(sources)]
    both = reduce(lambda a, b: a.unionByName(b), ranked).withColumn("order", -F.col("source_rank"))
    return latest(both, ["case_id"], ["order"]).drop("order").orderBy("case_id")


def title_of(case_id: F.Column) -> F.Column:
    return F.initcap(F.replace(case_id, F.lit("_"), F.lit(" ")))


def neighbours(edges: DataFrame, seeds: DataFrame, hops: int = 1) -> DataFrame:
    """case_id, id of the seeds and of all nodes within some hops, edges taken in both directions."""
    both = edges.select("case_id", F.col("source_id").alias("id"), F.col("target_id").alias("other")).union(edges.select("case_id", "target_id", "source_id"))
    reached = seeds.select("case_id", "id").distinct()
    for _ in range(hops):
        reached = reached.union(both.join(reached, ["case_id", "id"]).select("case_id", F.col("other").alias("id"))).distinct()
    return reached


def in_view(nodes: DataFrame, mode: str = "complete", categories: list[str] | None = None) -> DataFrame:
    """Nodes of a view mode and of the chosen categories."""
    category = ontology.category_of(F.col("entity_type"))
    if mode in VIEW:
        nodes = nodes.where(category == VIEW[mode])
    return nodes if categories is None else nodes.where(category.isin(categories))


def visible_edges(edges: DataFrame, nodes: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Edges between visible nodes, of the chosen types (none chosen: all)."""
    return complete(edges.where(F.col("relationship_type").isin(types)) if types else edges, nodes)


def facets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts per category and per relationship type."""
    a = nodes.groupBy(ontology.category_of(F.col("entity_type")).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("category").alias("facet"), "value", "n")
    b = edges.groupBy(F.col("relationship_type").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("relationship_type").alias("facet"), "value", "n")
    return a.union(b)


def search(nodes: DataFrame, text: str, top: int = 12) -> DataFrame:
    """The first nodes, by `ord`, that hold the text in name, type or an alias, in any case; none for blank text."""
    if not text.strip():
        return nodes.where("false")
    has = lambda c: F.contains(F.lower(c), F.lit(text.lower()))
    found = has(F.col("name")) | has(F.col("entity_type")) | F.exists("aliases", has)
    return nodes.where(found).orderBy("ord", "id").limit(top)


def connected_edges(edges: DataFrame, node_id: str) -> DataFrame:
    return edges.where((F.col("source_id") == node_id) | (F.col("target_id") == node_id))


def delete_detach(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges that stay, and for each deleted node the edges detached with it. gone: case_id, id."""
    gone = gone.select("case_id", "id").join(nodes.select("case_id", "id"), NODE, "left_semi").distinct()
    out = edges.join(gone.withColumnRenamed("id", "source_id"), ["case_id", "source_id"], "left_anti").join(gone.withColumnRenamed("id", "target_id"), ["case_id", "target_id"], "left_anti").select(edges.columns)
    touch = edges.select("case_id", F.col("source_id").alias("id"), F.col("id").alias("edge")).union(edges.select("case_id", "target_id", "id"))
    detached = gone.join(touch, NODE, "left").groupBy(*NODE).agg(F.count_distinct("edge").alias("detached"))
    return nodes.join(gone, NODE, "left_anti"), out, detached


def update(nodes: DataFrame, changes: DataFrame, fields: list[str]) -> DataFrame:
    """Partial update: a field that a change leaves null stays."""
    new = changes.select(*NODE, *[F.col(f).alias(f"__{f}") for f in fields])
    return nodes.join(new, NODE, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in nodes.columns])


def check_new_edges(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """requests (case_id, source_id, target_id, relationship_type) with `outcome`: OK or why the edge is refused."""
    typed = ontology.with_triplet_check(ends(requests, nodes, "left"), "source_type", "relationship_type", "target_type")
    outcome = (
        F.when(F.col("source_id") == F.col("target_id"), "SELF_LOOP")
        .when(F.col("source_type").isNull() | F.col("target_type").isNull(), "MISSING")
        .when(~F.col("triplet_ok"), "INVALID_TRIPLET")
        .otherwise("OK")
    )
    return typed.withColumn("outcome", outcome).select(*requests.columns, "outcome")


def clear_case(rows: DataFrame, case_id: str) -> DataFrame:
    return rows.where(F.col("case_id") != case_id)


def overlay(nodes: DataFrame, notes: DataFrame, colours: DataFrame) -> DataFrame:
    """Nodes with their notes and colours, empty where there are none."""
    return nodes.join(notes, NODE, "left").join(colours, NODE, "left").na.fill("", ["note"])


def trust(rows: DataFrame, decisions: DataFrame, corrected: list[str]) -> DataFrame:
    """Trust status and corrected fields of the latest decision on each row. decisions: case_id, id, trust_status, at, and
    the corrected fields, null where untouched."""
    last = latest(decisions, NODE, ["at"]).select(*NODE, F.col("trust_status").alias("__trust"), *[F.col(c).alias(f"__{c}") for c in corrected])
    out = rows.join(last, NODE, "left")
    return out.select(*[F.coalesce(f"__{c}", c).alias(c) if c in corrected else F.col(c) for c in rows.columns], F.coalesce("__trust", F.lit("UNREVIEWED")).alias("trust_status"))


def merge(nodes: DataFrame, edges: DataFrame, merges: DataFrame, flag_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Merge entities. merges: case_id, primary_id, secondary_id, not chained, one per secondary.

    The secondary is marked; the primary takes its name and aliases; its edges go to the primary, but for those between the
    two, which stay as they are. flag_only marks and does no more.
    """
    pairs = merges.select("case_id", "primary_id", "secondary_id")
    pairs = pairs.join(nodes.select("case_id", F.col("id").alias("primary_id")), ["case_id", "primary_id"], "left_semi").join(nodes.select("case_id", F.col("id").alias("secondary_id")), ["case_id", "secondary_id"], "left_semi")
    marked = nodes.join(pairs.select("case_id", F.col("secondary_id").alias("id"), F.col("primary_id").alias("merged_into")), NODE, "left")
    if flag_only:
        return marked, edges
    taken = nodes.select("case_id", F.col("id").alias("secondary_id"), "name", "aliases").join(pairs, ["case_id", "secondary_id"])
    taken = taken.groupBy("case_id", F.col("primary_id").alias("id")).agg(F.flatten(F.collect_list(F.array_append("aliases", F.col("name")))).alias("more"))
    marked = marked.join(taken, NODE, "left").withColumn("aliases", F.array_sort(F.array_distinct(F.concat("aliases", F.coalesce("more", F.array().cast("array<string>")))))).drop("more")
    a = pairs.select("case_id", F.col("secondary_id").alias("source_id"), F.col("primary_id").alias("new_source"))
    b = pairs.select("case_id", F.col("secondary_id").alias("target_id"), F.col("primary_id").alias("new_target"))
    moved = edges.join(a, ["case_id", "source_id"], "left").join(b, ["case_id", "target_id"], "left")
    between = F.coalesce(F.col("new_source") == F.col("target_id"), F.lit(False)) | F.coalesce(F.col("new_target") == F.col("source_id"), F.lit(False))
    moved = moved.withColumn("source_id", F.when(between, F.col("source_id")).otherwise(F.coalesce("new_source", "source_id"))).withColumn(
        "target_id", F.when(between, F.col("target_id")).otherwise(F.coalesce("new_target", "target_id"))
    )
    return marked, moved.select(edges.columns)


def consistency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: dangling edges, orphan nodes, invalid edges, share of sound edges. edges: source_id, target_id, is_valid."""
    ids = nodes.select("id").where("id <> ''").distinct()
    s = ids.select(F.col("id").alias("source_id"), F.lit(1).alias("s"))
    t = ids.select(F.col("id").alias("target_id"), F.lit(1).alias("t"))
    seen = edges.join(s, "source_id", "left").join(t, "target_id", "left")
    e = seen.agg(F.count(F.lit(1)).alias("total_edges"), F.count_if(F.col("s").isNull() | F.col("t").isNull()).alias("dangling_edges"), F.count_if(~F.coalesce("is_valid", F.lit(True))).alias("invalid_triplets"))
    used = edges.select(F.col("source_id").alias("id")).union(edges.select("target_id")).distinct()
    n = ids.agg(F.count(F.lit(1)).alias("total_nodes")).crossJoin(ids.join(used, "id", "left_anti").agg(F.count(F.lit(1)).alias("orphan_nodes")))  # one row each
    sound = F.greatest(F.lit(0), F.col("total_edges") - F.col("dangling_edges") - F.col("invalid_triplets"))
    score = F.when(F.col("total_edges") > 0, F.round(sound / F.col("total_edges"), 4)).when(F.col("total_nodes") > 0, F.lit(1.0))
    return n.crossJoin(e).withColumn("consistency_score", score)
