"""The corpus pipeline: documents, stage by stage, from raw rows to token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what a stage returns as Parquet in the shared
folder and gives the next one the table read again, so a lost executor costs one stage's work at most. All stages but the
last return the columns of `documents`, whatever further columns these have and whatever their names are. An empty table
gives empty tables throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kgspark.llm import decontaminate, exact_dedup, pieces, quality, simhash
from kgspark.llm.shared import table, written

#: Documents under this score go: the classifier's own decision, as in op4.
LEAST_QUALITY = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier doesn't reject.

    Null and empty texts are scored as any other. Repeated rows are scored alike. A null id is never learnt from. Of very long
    texts all bytes are compressed, one text at a time.
    """
    return quality.drop_rejected(docs, quality.fit(docs, table(spark, sf_dir, "labels")), LEAST_QUALITY)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id.

    A null text equals an empty one. Of rows with that id one stays, if they repeat each other; a null id is the least. Very
    long texts are compared whole.
    """
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents alike in four fifths of their five-word shingles, linked to groups, the one with the smallest id.

    SimHash fingerprints that meet at three or fewer bits, as in op6, suggest pairs, which are verified on the shingles; a search by
    prefixes adds the pairs that lie farther apart.

    Texts without words, null ones too, are alike. A null id stays only if there is no other in its group; of tied rows one
    stays. A very long text's distinct shingles are held in memory, eight bytes each.
    """
    return simhash.drop_near_copies(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    Null and empty texts hold none. Repeated rows go or stay together; a null id is an id like any other. Very long texts are
    hashed whole.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with counts and digests, and whether decoding gives the text back.

    A row for each row, with null ids and repeated ones. Null and empty texts have no tokens. Very long texts are encoded in
    chunks that tasks share.
    """
    return pieces.report(docs)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]

#: The compression classifier can't be expressed in SQL; tests hold run() against a plain version of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
