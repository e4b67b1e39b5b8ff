"""All queries of the engine, and SQL over its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import dockets, entities, evaluations, graphs, jobs, models, streams, texts, timelines  # noqa: F401
from .fixtures import sql
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "run_sql"]


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """SQL text over the driver's tables and the domain tables projected from them."""
    return sql(spark, sf_dir, text)
