"""Tenancy and audit: who may do what in a matter, membership, the append-only log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .resolve import latest


def decide(requests: DataFrame, matters: DataFrame, members: DataFrame) -> DataFrame:
    """requests (matter_id, user_id, action: read, write or audit) with the status code that each gets."""
    rows = requests.join(matters.select("matter_id", F.lit(True).alias("__matter")), "matter_id", "left").join(members.select("matter_id", "user_id", "role"), ["matter_id", "user_id"], "left")
    code = (
        F.when(F.col("__matter").isNull(), 404)
        .when(F.col("role").isNull(), 403)
        .when((F.col("action") == "write") & (F.col("role") == "viewer"), 403)
        .when((F.col("action") == "audit") & ~F.col("role").isin("owner", "attorney"), 403)
        .otherwise(200)
    )
    return rows.withColumn("status_code", code).drop("__matter")


def user_matters(matters: DataFrame, members: DataFrame, user_id: str, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of the matters of a user, the newest (largest id) first."""
    return matters.join(members.where(F.col("user_id") == user_id).select("matter_id", "role"), "matter_id").orderBy(F.desc("matter_id")).offset(offset).limit(limit)


def upsert_members(members: DataFrame, changes: DataFrame) -> DataFrame:
    """Membership after changes (matter_id, user_id, role, at): the last role counts."""
    return latest(members.withColumn("at", F.lit(-1)).unionByName(changes), ["matter_id", "user_id"], ["at"]).drop("at")


def audit_page(log: DataFrame, matter_id: int, target_type: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of a matter's audit rows, newest first."""
    rows = log.where(F.col("matter_id") == matter_id)
    if target_type:
        rows = rows.where(F.col("target_type") == target_type)
    return rows.orderBy(F.desc("logged_at"), F.desc("audit_id")).offset(offset).limit(limit)


def append_audit(path: str, rows: DataFrame) -> None:
    """Audit rows are only ever appended: nothing here rewrites or deletes them."""
    rows.write.mode("append").parquet(path)
