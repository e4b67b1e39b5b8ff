from kgspark.plans import graphs
from kgspark.plans.fixtures import sql

DIR = "/root/testdata/sf0.001"


def test_edges_of_chains_are_joined_by_their_places(spark):
    found = sql(spark, DIR, graphs.CHAIN_STEPS)
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x]
    assert joins and not [x for x in joins if " IN (" in x or " OR " in x]
    columns = ["case_id", "id", "source_id", "target_id"]
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, sql(spark, DIR, graphs.CHAIN_EDGES).select(columns).collect()))


def test_members_of_a_case_meet_by_place_in_all_texts_of_chains(spark):
    for text in (graphs.CHAINED, graphs.CHAIN_STEPS):
        plan = sql(spark, DIR, graphs._of_kind(text))._jdf.queryExecution().optimizedPlan().toString().splitlines()
        cases = [x for x in plan if "Join" in x and "case_id" in x]
        assert cases and all("(k#" in x for x in cases) and not [x for x in plan if "Join Cross" in x]
        # Suppliers and lines can't be of the kinds that are asked for.
        assert not [x for x in plan if "l_orderkey" in x or "s_suppkey" in x]
        found, want = sql(spark, DIR, graphs._of_kind(text)), sql(spark, DIR, text)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
