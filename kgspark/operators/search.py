"""Entity search over posting lists of trigrams, built once, read by the few that a pattern names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import search

GRAM, BUCKETS = 3, 64


def grams_of(text: Column) -> Column:
    """Distinct trigrams of a lower-case text."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - GRAM + 1, F.lit(1)))
    return F.when(F.length(text) >= GRAM, F.array_distinct(F.transform(places, lambda i: F.substr(text, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def build(nodes: DataFrame, path: str) -> None:
    """Write the posting lists of nodes (case_id, id, name, entity_type, aliases): gram, case_id, id, sorted by gram."""
    texts = F.array_compact(F.concat(F.array("name", "entity_type"), F.coalesce("aliases", F.array().cast("array<string>"))))
    rows = nodes.select("case_id", "id", F.explode(F.array_distinct(F.flatten(F.transform(texts, lambda t: grams_of(F.lower(t)))))).alias("gram"))
    rows.withColumn("bucket", _bucket(F.col("gram"))).repartition("bucket").sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(path)


def postings(spark: SparkSession, path: str, grams: list[str]) -> DataFrame:
    """The lists of some trigrams; only their buckets' files are read, and in these the row groups that can hold them."""
    buckets = [r[0] for r in spark.createDataFrame([(g,) for g in grams], "g string").select(_bucket(F.col("g"))).distinct().collect()]
    return spark.read.parquet(path).where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))


def find(nodes: DataFrame, path: str, text: str, top: int = 12) -> DataFrame:
    """As graph.search, by way of the index: nodes that have all of the text's trigrams are candidates, and are looked at.

    A text of fewer than three characters names no trigram and is searched without.
    """
    low = text.lower()
    grams = sorted({low[k : k + GRAM] for k in range(len(low) - GRAM + 1)})
    if not grams or not text.strip():
        return search(nodes, text, top)
    lists = postings(nodes.sparkSession, path, grams).groupBy("case_id", "id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams))
    return search(nodes.join(lists, ["case_id", "id"], "left_semi"), text, top)
