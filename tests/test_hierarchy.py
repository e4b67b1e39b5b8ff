import pytest

from kgspark.operators import ontology


def test_a_hierarchy_has_no_limit_of_rows_or_levels(spark):
    n = 300
    types = spark.range(n).selectExpr("cast(id as string) as entity_type", "case when id > 0 then cast(id - 1 as string) end as parent")
    up = ontology.hierarchy(types)
    assert up.count() == n * (n + 1) // 2
    assert up.where("depth <> cast(entity_type as int) - cast(ancestor as int)").isEmpty()
    wide = spark.range(1_000_001).selectExpr("cast(id as string) as entity_type", "case when id > 0 then '0' end as parent")
    assert ontology.hierarchy(wide).count() == 2_000_001


def test_a_hierarchy_with_two_parents_strangers_and_nulls(spark):
    types = spark.createDataFrame([("a", None), ("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("e", "gone"), (None, "a")], "entity_type string, parent string")
    want = [("a", "a", 0), ("b", "b", 0), ("b", "a", 1), ("c", "c", 0), ("c", "a", 1), ("d", "d", 0), ("d", "d", 0), ("e", "e", 0), ("e", "gone", 1)]
    want += [("d", "b", 1), ("d", "c", 1)] * 2 + [("d", "a", 2), ("d", "a", 2)] * 2
    got = [tuple(r) for r in ontology.hierarchy(types).collect()]
    # Null meets nothing but is a row; a type that is there twice has every way twice.
    assert sorted(r for r in got if r[0]) == sorted(want)
    assert [r for r in got if not r[0] and r[2] == 0] == [(None, None, 0)]


def test_a_cycle_fails(spark):
    types = spark.createDataFrame([("a", "c"), ("b", "a"), ("c", "b"), ("d", "a"), ("e", "d")], "entity_type string, parent string")
    with pytest.raises(ValueError, match="cycle"):
        ontology.hierarchy(types)


def test_the_inherited_check_makes_no_pairs_of_types(spark):
    n = 20_000
    leaf = lambda k: f"'{k}' || cast(id as string)"
    types = spark.range(n).selectExpr(f"{leaf('s')} as entity_type", "'S' as parent").union(spark.range(n).selectExpr(f"{leaf('t')} as entity_type", "'T' as parent"))
    types = types.union(spark.createDataFrame([("S", None), ("T", None)], "entity_type string, parent string"))
    named = spark.createDataFrame([("S", "r", "T"), ("s1", "q", "t2")], "source_type string, relationship_type string, target_type string")
    facts = spark.range(100).selectExpr(f"{leaf('s')} as source_type", "case when id % 2 = 0 then 'r' else 'q' end as relation_type", "'t' || cast(id + 1 as string) as target_type")
    facts = facts.union(spark.createDataFrame([("S", "r", "T"), ("T", "r", "S"), (None, "r", "T"), ("x", "r", "T")], "source_type string, relation_type string, target_type string"))
    checked = ontology.with_inherited_check(facts, types, named)
    # Pairs of types would be four hundred million.
    assert {(r.source_type, r.target_type) for r in checked.where("triplet_ok").collect()} == {("S", "T"), ("s1", "t2"), *((f"s{k}", f"t{k + 1}") for k in range(0, 100, 2))}
    assert checked.count() == 104
