"""Session settings in one place."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


#: A union of inputs that are partitioned alike passes for partitioned in 4.1; once adaptive execution has coalesced the inputs
#: differently, rows of a key lie apart, and what follows gives wrong results.
GUARD = {"spark.sql.unionOutputPartitioning": "false"}


def guard(spark: SparkSession) -> None:
    for k, v in GUARD.items():
        spark.conf.set(k, v)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared storage that the session names; a local one only where one machine runs everything."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not at and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    at = at or "file://" + tempfile.mkdtemp(prefix=f"{name}-")
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def session(name: str = "kgspark", **conf: str) -> SparkSession:
    """A session as the engine expects it: UTC, adaptive execution, Arrow exchange."""
    builder = SparkSession.builder.appName(name)
    own = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
    }
    for k, v in (own | GUARD | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
