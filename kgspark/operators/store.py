"""A case graph in keyed tables: nodes, edges, events, notes and preferences, each changed by the rows that change.

An upsert reads the buckets that it touches, not the graph: the ends of new edges are looked up by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.keyed import KeyedTable
from . import graph

NODES = "case_id string, id string, name string, entity_type string"
EDGES = "case_id string, relationship_type string, id string, source_id string, target_id string, confidence double"
EVENTS = "case_id string, id string, event_date string, description string, entity_id string"
NOTES = "case_id string, id string, note string"
PREFERENCES = "case_id string, colours map<string,string>, layout string"
#: What a case without a record of its own has.
LAYOUT = "cose"


class GraphStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 32, most: int = 6) -> None:
        table = lambda name, schema, key: KeyedTable(spark, f"{path}/{name}", schema, key, buckets, most)
        self.spark = spark
        self.nodes = table("nodes", NODES, ["case_id", "id"])
        self.edges = table("edges", EDGES, ["case_id", "relationship_type", "id"])
        self.events = table("events", EVENTS, ["case_id", "id"])
        self.notes = table("notes", NOTES, ["case_id", "id"])
        self.preferences = table("preferences", PREFERENCES, ["case_id"])

    def upsert_nodes(self, rows: DataFrame) -> int:
        return self.nodes.upsert(rows)

    def upsert_edges(self, rows: DataFrame) -> int:
        """Edges without both ends among the stored nodes or events are dropped."""
        side = lambda c: rows.select("case_id", F.col(c).alias("id"))
        ends = side("source_id").union(side("target_id"))
        known = self.nodes.beside(ends).select("case_id", "id").union(self.events.beside(ends).select("case_id", "id"))
        return self.edges.upsert(graph.complete(rows, known))

    def upsert_events(self, rows: DataFrame) -> int:
        """Events, and an association edge for those with an entity that the case has."""
        version = self.events.upsert(rows)
        linked = rows.where(F.col("entity_id").isNotNull())
        self.upsert_edges(linked.select("case_id", F.lit("ASSOCIATED_WITH").alias("relationship_type"), F.concat(F.lit("assoc_"), "id").alias("id"), F.col("id").alias("source_id"), F.col("entity_id").alias("target_id"), F.lit(1.0).alias("confidence")))
        return version

    def delete_nodes(self, keys: DataFrame) -> None:
        """Nodes with their edges and notes."""
        own = keys.select("case_id", "id").distinct()
        edges = self.edges.read()
        touching = lambda c: edges.join(own.withColumnRenamed("id", c), ["case_id", c], "left_semi").select("case_id", "relationship_type", "id")
        self.edges.delete(touching("source_id").union(touching("target_id")))
        self.nodes.delete(own)
        self.notes.delete(own)

    def clear_case(self, case_id: str) -> None:
        for t in (self.edges, self.nodes, self.events, self.notes):
            t.delete(t.read().where(F.col("case_id") == case_id))

    def put_notes(self, rows: DataFrame) -> int:
        return self.notes.upsert(rows)

    def put_preferences(self, rows: DataFrame) -> int:
        return self.preferences.upsert(rows)

    def preferences_of(self, cases: DataFrame) -> DataFrame:
        """Each case's record; without one no colours, and the usual layout."""
        held = self.preferences.lookup(cases)
        none = F.create_map().cast("map<string,string>")
        return cases.select("case_id").distinct().join(held, "case_id", "left").select("case_id", F.coalesce("colours", none).alias("colours"), F.coalesce("layout", F.lit(LAYOUT)).alias("layout"))

    def overlaid(self) -> DataFrame:
        """Nodes with their notes and the colours that their case prefers."""
        colours = self.preferences.read().select("case_id", F.explode("colours").alias("id", "colour"))
        return graph.overlay(self.nodes.read(), self.notes.read(), colours)
