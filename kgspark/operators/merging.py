"""Merges of entities one after another, as reviews make them: a merge finds what the ones before it left.

A merge moves the edges of the secondary to the primary, but for those between the two, and gives the primary the secondary's
name and aliases as they are by then. Where a primary is merged itself, later, its edges move on, so an edge's end follows
a chain of merges of rising time. The end of each chain is found by pointer jumping, in a number of rounds that grows with
the logarithm of its length. Ends of an edge whose chains end at one node meet on the way, and only these: the merge at which
they would meet is read off the next AHEAD merges of both, and the end that it would move is pinned until its node is merged
again. Rounds are written to shared storage, which cuts their lineage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder
from .graph import NODE

#: Merges of a chain that lie in one row. Ends that meet further on are looked for so many at a time.
AHEAD = 64


def _written(df: DataFrame) -> DataFrame:
    at = shared_folder(df.sparkSession, "merges")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def steps(nodes: DataFrame, merges: DataFrame) -> DataFrame:
    """case_id, s, p, seq of the merges between two different nodes that the case has; seq is their order, and their name.

    merges: case_id, primary_id, secondary_id, at. Of one time, the lesser secondary, then primary, comes first.
    """
    known = lambda c: nodes.select("case_id", F.col("id").alias(c))
    own = merges.where("primary_id <> secondary_id").join(known("primary_id"), ["case_id", "primary_id"], "left_semi").join(known("secondary_id"), ["case_id", "secondary_id"], "left_semi")
    return own.select("case_id", F.col("secondary_id").alias("s"), F.col("primary_id").alias("p"), F.struct("at", "secondary_id", "primary_id").alias("seq")).distinct()


def numbered(events: DataFrame) -> DataFrame:
    """events with `n`, a number for each that rises with seq in a case."""
    return events.orderBy("case_id", "seq").withColumn("n", F.monotonically_increasing_id())


def linked(events: DataFrame) -> DataFrame:
    """events with `onward`, the first later merge of the primary, and `again`, the next merge of the secondary itself. events: numbered()."""
    at = lambda c, own: events.select("case_id", F.col(c).alias("node"), "n", F.lit(own).alias("own"))
    # Later ones come first, so the least number so far is the next one's.
    later = Window.partitionBy("case_id", "node").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    rows = at("s", True).union(at("p", False)).withColumn("then", F.min(F.when(F.col("own"), F.col("n"))).over(later))
    return events.join(rows.groupBy("n").agg(F.max(F.when(~F.col("own"), F.col("then"))).alias("onward"), F.max(F.when(F.col("own"), F.col("then"))).alias("again")), "n")


def _spread(c: str, *by: str) -> Column:
    """The number in c; where there is none one below nought, which no merge has, so that rows without one aren't in one task."""
    return F.coalesce(F.col(c), -1 - F.pmod(F.xxhash64(*by), F.lit(1 << 40)))


def chains(events: DataFrame) -> DataFrame:
    """events with `road`, the merges that what a merge moves goes through, itself first and AHEAD at most, `more`, whether they go
    on, `root`, where it is in the end, and `back`, where it is if it is pinned instead. events: linked()."""
    rows, size = _written(events.select("n", F.array("n").alias("road"), F.col("p").alias("root"), "onward")), 1
    roads = rows
    while not rows.where("onward is not null").isEmpty():
        grows = size < AHEAD
        ahead = rows.select(F.col("n").alias("_n"), F.col("root").alias("_root"), F.col("onward").alias("_onward"), *([F.col("road").alias("_road")] if grows else []))
        road = [F.concat("road", F.coalesce("_road", F.array().cast("array<long>"))).alias("road")] if grows else []
        rows = _written(rows.join(ahead, _spread("onward", "n") == F.col("_n"), "left").select("n", *road, F.coalesce("_root", "root").alias("root"), F.col("_onward").alias("onward")))
        size *= 2
        roads = rows if grows else roads
    roads = roads.select("n", "road", F.col("onward").isNotNull().alias("more"))
    known = events.join(roads, "n").join(rows.select("n", "root"), "n")
    back = rows.select(F.col("n").alias("_n"), F.col("root").alias("_root"))
    return _written(known.join(back, _spread("again", "n") == F.col("_n"), "left").select(*known.columns, F.coalesce("_root", "s").alias("back")))


def taken(events: DataFrame) -> DataFrame:
    """case_id, id, origin: every node whose name and aliases a node has in the end, over chains of rising time."""
    new = _written(events.groupBy("case_id", F.col("s").alias("origin"), F.col("p").alias("id")).agg(F.min("seq").alias("seq")))
    every = new
    step = events.select("case_id", F.col("s").alias("id"), F.col("p").alias("_id"), F.col("seq").alias("_seq"))
    while not new.isEmpty():
        reached = new.join(step, ["case_id", "id"]).where("_seq > seq").groupBy("case_id", "origin", F.col("_id").alias("id")).agg(F.min("_seq").alias("seq"))
        known = every.groupBy("case_id", "origin", "id").agg(F.min("seq").alias("_known"))
        # One that was reached before comes again if it is sooner now.
        new = _written(reached.join(known, ["case_id", "origin", "id"], "left").where("_known is null or seq < _known").select("case_id", "origin", "id", "seq"))
        every = every.union(new)
    return every.select("case_id", "id", "origin").distinct()


def _followed(edges: DataFrame, merges: DataFrame) -> DataFrame:
    """Where edges are in the end whose ends meet. edges: with a and b, the next merges of their ends. merges: chains()."""
    columns = [c for c in edges.columns if c not in ("a", "b")]
    road = lambda e: merges.select(F.col("n").alias(f"{e}_n"), F.col("road").alias(f"{e}_road"), F.col("more").alias(f"{e}_more"))
    merge = merges.select(F.col("n").alias("m_n"), "onward", "again", "root", "back")
    last = lambda r: F.get(r, F.size(r) - 1)
    none, state, done = F.array().cast("array<long>"), edges, []
    while not state.isEmpty():
        both = state
        for e in ("a", "b"):
            both = both.join(road(e), _spread(e, "case_id", "id") == F.col(f"{e}_n"), "left").withColumns({f"{e}_road": F.coalesce(f"{e}_road", none), f"{e}_more": F.coalesce(f"{e}_more", F.lit(False))})
        both = both.withColumn("z", F.get(F.array_intersect("a_road", "b_road"), F.lit(0)))
        # The last merge of each end before the first that both go through, or of all.
        for e in ("a", "b"):
            both = both.withColumn(f"{e}_last", F.when(F.col("z").isNotNull(), F.get(f"{e}_road", (F.array_position(f"{e}_road", F.col("z")) - 2).cast("int"))).otherwise(last(F.col(f"{e}_road"))))
        both = both.withColumn("m", F.when(F.col("z").isNotNull() | ~(F.col("a_more") | F.col("b_more")), F.greatest("a_last", "b_last")))
        # Where they don't meet yet, the road that ends first is left behind: the other one has none of its merges.
        skips_a = F.col("a_more") & (~F.col("b_more") | (F.col("a_last") < F.col("b_last")))
        both = both.select(*columns, (F.col("m") == F.coalesce("a_last", F.lit(-1))).alias("by_a"), F.when(skips_a, F.col("a_last")).otherwise(F.col("a")).alias("a"), F.when(skips_a, F.col("b")).otherwise(F.col("b_last")).alias("b"), "m")
        met, by_a = both.join(merge, _spread("m", "case_id", "id") == F.col("m_n"), "left"), F.col("by_a")
        new = {"source_id": F.when(by_a, F.col("back")).otherwise(F.col("root")), "target_id": F.when(by_a, F.col("root")).otherwise(F.col("back"))}
        on = {"a": F.when(by_a, F.col("again")).otherwise(F.col("onward")), "b": F.when(by_a, F.col("onward")).otherwise(F.col("again"))}
        found = F.col("m").isNotNull()
        rows = _written(
            met.select(
                *[F.when(found, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in columns], *[F.when(found, on[e]).otherwise(F.col(e)).alias(e) for e in on], F.coalesce(F.col("back") != F.col("root"), F.lit(False)).alias("_done")
            )
        )
        done.append(rows.where("_done").select(*columns))
        state = rows.where("not _done").drop("_done")
    return reduce(DataFrame.union, done, edges.select(*columns).where("false"))


def merge_events(nodes: DataFrame, merges: DataFrame) -> DataFrame:
    return _written(linked(_written(numbered(_written(steps(nodes, merges))))))


def merged_nodes(nodes: DataFrame, events: DataFrame) -> DataFrame:
    """Nodes (case_id, id, name, aliases, ...) with merged_into (the last merge counts), aliases, and in_cycle: whether a node's
    own name came back to it over a chain of merges. events: merge_events()."""
    last = events.groupBy("case_id", F.col("s").alias("id")).agg(F.max_by("p", "seq").alias("merged_into"))
    origin = nodes.select("case_id", F.col("id").alias("origin"), F.array_append("aliases", F.col("name")).alias("more"))
    more = taken(events).join(origin, ["case_id", "origin"]).groupBy("case_id", "id").agg(F.flatten(F.collect_list("more")).alias("more"), F.max(F.col("id") == F.col("origin")).alias("in_cycle"))
    none = F.array().cast("array<string>")
    out = nodes.join(last, NODE, "left").join(more, NODE, "left")
    return out.withColumn("aliases", F.array_sort(F.array_distinct(F.concat(F.coalesce("aliases", none), F.coalesce("more", none))))).withColumn("in_cycle", F.coalesce("in_cycle", F.lit(False))).drop("more")


def merged_edges(edges: DataFrame, events: DataFrame) -> DataFrame:
    """Edges (case_id, id, source_id, target_id, ...) where they are in the end. events: merge_events()."""
    merges = chains(events)
    first = merges.groupBy("case_id", "s").agg(F.min_by(F.struct("n", "root"), "n").alias("first"))
    end = lambda e, c: first.select("case_id", F.col("s").alias(c), F.col("first.n").alias(e), F.col("first.root").alias(f"_{c}"))
    rows = edges.join(end("a", "source_id"), ["case_id", "source_id"], "left").join(end("b", "target_id"), ["case_id", "target_id"], "left")
    place = {c: F.coalesce(f"_{c}", c) for c in ("source_id", "target_id")}
    # A loop of one node moves with both of its ends at once.
    meet = F.coalesce((F.col("source_id") != F.col("target_id")) & (place["source_id"] == place["target_id"]), F.lit(False))
    rows = _written(rows.select(*[place[c].alias(c) if c in place else F.col(c) for c in edges.columns], "a", "b", meet.alias("_meet")))
    return rows.where("not _meet").select(*edges.columns).union(_followed(rows.where("_meet").drop("_meet"), merges))


def merge_in_order(nodes: DataFrame, edges: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """merges (case_id, primary_id, secondary_id, at), one after another: nodes and edges as they are in the end."""
    events = merge_events(nodes, merges)
    return merged_nodes(nodes, events), merged_edges(edges, events)
