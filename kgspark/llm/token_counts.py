"""Token counts as an exact length histogram.

Documents are encoded once and aggregated by their encoded length; nothing else about them is kept. Suffix sums over the
histogram answer, for every context limit: documents and tokens in total, those at or over the limit, quantiles, and what
is left of all tokens when every document is truncated to the limit.

The sums run in two levels: inside blocks of lengths, and over block totals, so no task holds more than a block's lengths
or the list of blocks. Null and empty texts have length 0. Repeated rows count each. An empty table gives an empty
histogram. Extra columns are ignored. Very long texts are encoded whole, one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .shared import file_bytes, prepare, sliced, texts_of, tokenizer_path, written

#: Lengths of a block.
BLOCK = 256


def _lengths(ranks):
    schema = pa.schema([("n_tokens", pa.int64()), ("docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoding(ranks.value)
        for batch in sliced(batches, 0):
            n, docs = np.unique(np.array(tokens.counts(enc, batch.column(0).to_pylist()), np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(docs.astype(np.int64))], schema=schema)

    return run


def histogram(docs: DataFrame, vocabulary: str | None = None, text_col: str = "text") -> DataFrame:
    """n_tokens, docs: documents of each encoded length."""
    spark = docs.sparkSession
    prepare(spark)
    ranks = spark.sparkContext.broadcast(file_bytes(vocabulary or tokenizer_path(tokens.VOCABULARY)))
    found = texts_of(docs, text_col, text_col).select("text").mapInArrow(_lengths(ranks), "n_tokens long, docs long")
    # Written, for the sums read it twice: on every length, and on blocks of lengths.
    return written(found.groupBy("n_tokens").agg(F.sum("docs").alias("docs")), "lengths")


def suffix_sums(lengths: DataFrame) -> DataFrame:
    """A row for each length L: docs, docs_ge and tokens_ge (length >= L), totals, the share of documents at most L long, and
    truncated_tokens (sum of min(length, L))."""
    rows = lengths.select("n_tokens", "docs", (F.col("n_tokens") * F.col("docs")).alias("tokens"), F.floor(F.col("n_tokens") / BLOCK).alias("block"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # One row for each BLOCK lengths up to the longest document.
    blocks = rows.groupBy("block").agg(F.sum("docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("block_docs").over(after), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("block_tokens").over(after), F.lit(0)).alias("tokens_after"),
        F.sum("block_docs").over(everything).alias("docs_total"),
        F.sum("block_tokens").over(everything).alias("tokens_total"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    out = rows.join(blocks, "block").select(
        "n_tokens",
        "docs",
        (F.col("docs_after") + F.sum("docs").over(inside)).alias("docs_ge"),
        (F.col("tokens_after") + F.sum("tokens").over(inside)).alias("tokens_ge"),
        "docs_total",
        "tokens_total",
    )
    return out.select(
        "*",
        ((F.col("docs_total") - F.col("docs_ge") + F.col("docs")) / F.col("docs_total")).alias("share_le"),
        (F.col("tokens_total") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")).alias("truncated_tokens"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """For each stated limit: documents longer than it, and all tokens after truncation to it."""
    rows = sums.select("n_tokens", "docs_ge", "tokens_ge", "docs_total", "tokens_total", F.explode(F.array(*[F.lit(x).cast("long") for x in sorted(set(limits))])).alias("limit"))
    over = F.col("n_tokens") > F.col("limit")
    least = F.when(over, F.col("n_tokens"))
    found = rows.groupBy("limit").agg(F.min_by("docs_ge", least).alias("d"), F.min_by("tokens_ge", least).alias("t"), F.max("docs_total").alias("docs_total"), F.max("tokens_total").alias("tokens_total"))
    d, t = F.coalesce("d", F.lit(0)), F.coalesce("t", F.lit(0))
    return found.select("limit", d.alias("docs_over"), (F.col("tokens_total") - t + F.col("limit") * d).alias("truncated_tokens"), "docs_total", "tokens_total")


def quantile(sums: DataFrame, share: float) -> DataFrame:
    """The smallest length such that at least this share of the documents is no longer."""
    return sums.where(F.col("share_le") >= F.lit(share)).agg(F.min("n_tokens").alias("n_tokens"))
