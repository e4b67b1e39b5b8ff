import random

import pytest
from pyspark.sql import functions as F

from kgspark.operators.store import GraphStore
from kgspark.sources.keyed import Conflict, KeyedTable

SCHEMA = "case_id string, id long, name string, n int"


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, f"file://{tmp_path}/t", SCHEMA, ["case_id", "id"], buckets=8, most=4)


def rows(spark, own):
    return spark.createDataFrame(own, SCHEMA)


def contents(df):
    return {(r.case_id, r.id): (r.name, r.n) for r in df.collect()}


def test_changes_over_many_versions(spark, table):
    rng, want, after = random.Random(1), {}, []
    for k in range(9):
        own = {("c", i): (f"v{k}", k if i % 3 else None) for i in rng.sample(range(40), 12)}
        table.upsert(rows(spark, [(*key, *v) for key, v in own.items()]))
        want |= own
        gone = [("c", i) for i in rng.sample(range(40), 3)]
        table.delete(rows(spark, [(*g, None, None) for g in gone]))
        for g in gone:
            want.pop(g, None)
        after.append((table.manifest()["version"], dict(want)))
        assert all(len(v) < 4 for v in table.manifest()["buckets"].values())
    assert contents(table.read()) == want
    for version, then in after[-2:]:
        assert contents(table.read(version)) == then
    keys = rows(spark, [("c", i, None, None) for i in range(5)])
    assert contents(table.lookup(keys)) == {k: v for k, v in want.items() if k[1] < 5}
    assert table.vacuum() and contents(table.read()) == want


def test_bytes_written_follow_the_change(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/b", SCHEMA, ["case_id", "id"], buckets=16, most=50)
    first = t.upsert(spark.range(200_000).select(F.lit("c").alias("case_id"), "id", F.sha2(F.col("id").cast("string"), 256).alias("name"), F.lit(1).alias("n")))
    sizes = {m: t.bytes_of(t.upsert(spark.range(m).select(F.lit("c").alias("case_id"), "id", F.sha2((F.col("id") + 7).cast("string"), 256).alias("name"), F.lit(2).alias("n")))) for m in (10, 2_000, 20_000)}
    assert sizes[10] < 0.01 * t.bytes_of(first) and sizes[2_000] < 0.03 * t.bytes_of(first) and sizes[20_000] < 0.2 * t.bytes_of(first)
    assert t.read().agg(F.sum("n")).first()[0] == 220_000


def test_only_full_buckets_are_written_anew(spark, table):
    for k in range(6):
        table.upsert(rows(spark, [("c", 1, f"v{k}", k)]))
    table.upsert(rows(spark, [("c", i, "x", i) for i in range(2, 30)]))
    kinds = {len(v) for v in table.manifest()["buckets"].values()}
    assert kinds & {1} and contents(table.read())["c", 1] == ("v5", 5)


def test_a_writer_that_dies_leaves_nothing_and_of_two_one_fails(spark, table, monkeypatch):
    table.upsert(rows(spark, [("c", 1, "a", 1)]))

    def die(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(table, "_commit_as", die)
        with pytest.raises(RuntimeError):
            table.upsert(rows(spark, [("c", 1, "b", 2), ("c", 2, "b", 2)]))
    assert contents(table.read()) == {("c", 1): ("a", 1)}
    table.upsert(rows(spark, [("c", 3, "d", 3)]))
    assert contents(table.read()) == {("c", 1): ("a", 1), ("c", 3): ("d", 3)}
    other, before = KeyedTable(spark, table.path, SCHEMA, ["case_id", "id"]), table.manifest()
    assert other.buckets == 8
    other.upsert(rows(spark, [("c", 4, "e", 4)]))
    with pytest.raises(Conflict):
        table._commit_as(before["version"] + 1, before)
    assert contents(table.read())["c", 4] == ("e", 4)


def test_the_graph_store(spark, tmp_path):
    g = GraphStore(spark, f"file://{tmp_path}/g", buckets=4)
    node = "case_id string, id string, name string, entity_type string"
    edge = "case_id string, relationship_type string, id string, source_id string, target_id string, confidence double"
    g.upsert_nodes(spark.createDataFrame([("c", "a", "A", "PERSON"), ("c", "b", "B", "CASE"), ("d", "a", "Z", "PERSON")], node))
    g.upsert_nodes(spark.createDataFrame([("c", "a", "A2", None)], node))
    g.upsert_edges(spark.createDataFrame([("c", "PLAINTIFF_IN", "1", "a", "b", 0.5), ("c", "PLAINTIFF_IN", "2", "a", "gone", 0.5), ("d", "PLAINTIFF_IN", "3", "a", "b", 0.5)], edge))
    g.upsert_events(spark.createDataFrame([("c", "t1", "2024-01-01", "filed", "b"), ("c", "t2", None, "heard", None), ("c", "t3", None, "heard", "gone")], "case_id string, id string, event_date string, description string, entity_id string"))
    assert sorted((r.case_id, r.id, r.name, r.entity_type) for r in g.nodes.read().collect()) == [("c", "a", "A2", None), ("c", "b", "B", "CASE"), ("d", "a", "Z", "PERSON")]
    assert sorted(r.id for r in g.edges.read().collect()) == ["1", "assoc_t1"]
    g.put_notes(spark.createDataFrame([("c", "a", "seen")], "case_id string, id string, note string"))
    g.put_preferences(spark.createDataFrame([("c", {"a": "#fff"}, "grid")], "case_id string, colours map<string,string>, layout string"))
    assert {(r.case_id, r.id): (r.note, r.colour) for r in g.overlaid().collect()} == {("c", "a"): ("seen", "#fff"), ("c", "b"): ("", None), ("d", "a"): ("", None)}
    assert {r.case_id: (r.colours, r.layout) for r in g.preferences_of(spark.createDataFrame([("c",), ("x",)], "case_id string")).collect()} == {"c": ({"a": "#fff"}, "grid"), "x": ({}, "cose")}
    g.delete_nodes(spark.createDataFrame([("c", "b")], "case_id string, id string"))
    assert g.edges.read().count() == 0 and g.nodes.read().count() == 2
    g.clear_case("c")
    assert [r.case_id for r in g.nodes.read().collect()] == ["d"] and g.notes.read().count() == 0
