import re

from kgspark.plans.fixtures import frame


def test_suppliers_are_users_before_they_meet_customers(spark, tmp_path):
    spark.range(30).selectExpr("id as c_custkey", "cast(id % 2 as int) as c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(1000).selectExpr("id as s_suppkey", "cast(id % 2 as int) as s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    members = frame(spark, str(tmp_path), "members")
    assert members.count() == 30 * 10
    plan = members._jdf.queryExecution().optimizedPlan().toString()
    # Two nations of ten users, not of five hundred suppliers, go into the join.
    assert re.search(r"Aggregate \[s_nationkey", plan[plan.index("Join") :])
