"""Retention as a plan table; deleting is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sharegate import policy
from sharegate.operators.ordered import running_sum
from sharegate.session import materialize


def retention_plan(archives: DataFrame, *, now: str, days: int = policy.RETENTION_DAYS, mb: int = policy.RETENTION_MB,
                   keep_name: str | None = None) -> DataFrame:
    """(archive_id, name, mtime, bytes, action, reason) for ``archives``.

    First everything older than ``days`` goes, then the oldest survivors until the total is
    within ``mb``. The archive named ``keep_name`` stays and counts towards the total. A
    limit of 0 or less is switched off."""
    cap = mb * 1024 * 1024
    at = F.lit(now).cast("timestamp")
    age = F.floor((F.unix_timestamp(at) - F.unix_timestamp(F.col("mtime").cast("timestamp"))) / 86400)
    old = F.col("mtime").cast("timestamp") < at - F.make_dt_interval(F.lit(max(days, 0)))
    kept = F.lit(False) if keep_name is None else F.col("name") == keep_name
    rows = archives.select("archive_id", "name", "mtime", "bytes", kept.alias("kept"),
                           (~kept & (F.lit(days > 0) & old)).alias("aged"), age.alias("age"))
    drop = F.lit(False)
    if mb > 0:
        order = ["mtime", "name", "archive_id"]
        rows = running_sum(rows.withColumn("counted", F.when(F.col("aged") | F.col("kept"), 0).otherwise(F.col("bytes"))),
                           [], order, "counted")
        rows = materialize(rows)
        total = rows.agg(F.sum(F.when(~F.col("aged"), F.col("bytes")))).first()[0] or 0
        drop = ~F.col("aged") & ~F.col("kept") & (F.lit(total) - F.col("before") > cap)
    reason = (F.when(F.col("aged"), F.concat(F.lit(f"older than {days}d (age "), F.col("age"), F.lit("d)")))
              .when(drop, F.lit(f"archive over {mb} MB cap")))
    return rows.select("archive_id", "name", "mtime", "bytes",
                       F.when(F.col("aged") | drop, "delete").otherwise("keep").alias("action"), reason.alias("reason"))


def retention_summary(plan: DataFrame) -> DataFrame:
    gone = F.col("action") == "delete"
    return plan.agg(
        F.count_if(gone).alias("deleted_count"), F.coalesce(F.sum(F.when(gone, F.col("bytes"))), F.lit(0)).alias("freed_bytes"),
        F.count_if(~gone).alias("remaining_count"),
        F.coalesce(F.sum(F.when(~gone, F.col("bytes"))), F.lit(0)).alias("remaining_bytes"))


def purge_event(plan: DataFrame, *, now: str, days: int, mb: int) -> DataFrame:
    """One ``purge`` ledger event; the deleted archives are the plan's rows."""
    return retention_summary(plan).select(
        F.lit("purge").alias("event"), F.lit(now).alias("timestamp_utc"), F.lit(days).alias("retention_days"),
        F.lit(mb).alias("retention_mb"), "deleted_count", "freed_bytes", "remaining_count", "remaining_bytes")
