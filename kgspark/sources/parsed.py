"""Parsed documents as JSON in shared storage, a document a line, in shards by a hash of the id.

Bad lines, and lines of other shapes, come back as rows with what stands there; the others are read all the same. Reading some
documents opens the shards that these are in, and Spark's own JSON reader, which works with any store, takes filters down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 16
#: A parsed document; more columns may be saved and are read if they are asked for.
DOCUMENT = """document_id string, filename string, file_type string, sha256_hash string, pages array<struct<page_number:int, raw_text:string, blocks:array<struct<block_id:string, block_type:string, raw_text:string>>>>,
  processing_metadata struct<processing_status:string, started_at:string>"""
BAD = "_bad"


def shard(document_id: Column) -> Column:
    return F.pmod(F.xxhash64(document_id), F.lit(SHARDS)).cast("int")


def save(documents: DataFrame, path: str) -> None:
    """Add documents to a folder. A document that is saved again is there twice until `load` takes the one saved last."""
    saved = documents.withColumn("saved_at", F.current_timestamp()).withColumn("shard", shard(F.col("document_id")))
    saved.repartition("shard").write.mode("append").partitionBy("shard").option("ignoreNullFields", "false").json(path)


def read(spark: SparkSession, path: str, ids: list[str] | None = None, schema: str = DOCUMENT) -> DataFrame:
    """Every line: the document's columns, and `_bad`: the text of a line that isn't a document (null: it is one).

    ids: only these documents, and bad lines of their shards.
    """
    rows = spark.read.schema(f"{schema}, saved_at timestamp, {BAD} string, shard int").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).json(path)
    if ids is not None:
        # As literals, so that only these shards' files are listed and read.
        own = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i string").select(shard(F.col("i"))).distinct().collect()]
        rows = rows.where(F.col("shard").isin(own) & (F.col("document_id").isin(ids) | F.col(BAD).isNotNull()))
    # JSON that is something else, an empty object for one, is no document either.
    odd = F.col(BAD).isNull() & F.col("document_id").isNull()
    return rows.withColumn(BAD, F.when(odd, F.to_json(F.struct(*[c for c in rows.columns if c not in (BAD, "shard")]))).otherwise(F.col(BAD))).drop("shard")


def load(spark: SparkSession, path: str, ids: list[str] | None = None, schema: str = DOCUMENT) -> DataFrame:
    """Documents, each as it was saved last; no rows for ids that aren't there."""
    rows = read(spark, path, ids, schema).where(F.col(BAD).isNull()).drop(BAD)
    columns = [c for c in rows.columns if c != "document_id"]
    last = rows.groupBy("document_id").agg(F.max_by(F.struct(*columns), "saved_at").alias("d"))
    return last.select("document_id", "d.*").drop("saved_at")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """A summary of each document; bad lines are passed over."""
    return load(spark, path).select("document_id", "filename", "file_type", "sha256_hash", F.coalesce(F.size("pages"), F.lit(0)).alias("page_count"), F.col("processing_metadata.started_at").alias("created_at"))
