from pyspark.sql import functions as F

from kgspark.sources.keyed import KeyedTable


def test_an_empty_table_asks_for_no_keys_and_others_give_whole_buckets(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", "id string, v long", ["id"], buckets=2)
    broken = spark.range(1).select(F.raise_error(F.lit("asked")).cast("string").alias("id"))
    assert table.beside(broken).count() == 0
    table.upsert(spark.range(20).select(F.col("id").cast("string").alias("id"), F.col("id").alias("v")))
    keys = spark.createDataFrame([("3",)], "id string")
    assert [r.v for r in table.lookup(keys).collect()] == [3]
    assert "3" in {r.id for r in table.beside(keys).collect()}
