"""Reconciliation and triage: set differences, verification, tallies, top paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sharegate import policy
from sharegate.functions.paths import basename, extension

KEYS = ["share_id", "path"]
UNSCANNED = "(not scanned - filtered before classification)"


def tracked_not_shipped(tracked: DataFrame, included: DataFrame) -> DataFrame:
    return tracked.select(*KEYS).join(included.select(*KEYS), KEYS, "left_anti")


def shipped_not_tracked(tracked: DataFrame, included: DataFrame) -> DataFrame:
    return included.select(*KEYS).join(tracked.select(*KEYS), KEYS, "left_anti")


def tracked_reasons(tracked: DataFrame, included: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Tracked files that did not ship, each with the rule that held it back."""
    return (tracked_not_shipped(tracked, included)
            .join(exclusions.select(*KEYS, "rule"), KEYS, "left")
            .select(*KEYS, F.coalesce("rule", F.lit(UNSCANNED)).alias("rule")))


def diff_decisions(a: DataFrame, b: DataFrame) -> DataFrame:
    """Paths on which two decision maps differ; a side without the path shows NULL."""
    left = a.select(*KEYS, F.col("decision").alias("decision_a"))
    right = b.select(*KEYS, F.col("decision").alias("decision_b"))
    return left.join(right, KEYS, "full_outer").where(~F.col("decision_a").eqNullSafe(F.col("decision_b")))


def gate_verdict(decision_map: DataFrame) -> DataFrame:
    """Per share: would_share, would_hold, and whether a hard secret blocks it."""
    held = F.col("decision") != "INCLUDE"
    return decision_map.groupBy("share_id").agg(
        F.count_if(~held).alias("would_share"), F.count_if(held).alias("would_hold"),
        F.bool_or(F.startswith("decision", F.lit("SEC-"))).alias("blocked"))


def rule_counts(exclusions: DataFrame) -> DataFrame:
    return exclusions.groupBy("share_id", "rule").agg(F.count(F.lit(1)).alias("n"))


def rule_tally(exclusions: DataFrame) -> DataFrame:
    """(share_id, excluded_by_rule): counts per rule as a map in rule order. Rows are counted
    per (share, rule) first, so at most one entry per rule is gathered."""
    entries = F.array_sort(F.collect_list(F.struct("rule", "n")))
    return rule_counts(exclusions).groupBy("share_id").agg(F.map_from_entries(entries).alias("excluded_by_rule"))


# -- triage views --------------------------------------------------------------

def _with_prefix(exclusions: DataFrame, prefix: str) -> DataFrame:
    return exclusions.where(F.startswith("rule", F.lit(prefix))) if prefix else exclusions


def triage_paths(exclusions: DataFrame, prefix: str = "", limit: int | None = policy.TRIAGE_LIMIT) -> DataFrame:
    """First paths per (share, rule) in path order, with the number of further ones.

    The rank limit runs before the shuffle too, so a rule that holds most rows sends only
    ``limit`` of them per task. ``limit=None`` lists every path, without ranks."""
    rows = _with_prefix(exclusions, prefix).select("share_id", "rule", "path")
    totals = rule_counts(rows)
    if limit is None:
        return rows
    rank = F.row_number().over(Window.partitionBy("share_id", "rule").orderBy("path"))
    return (rows.withColumn("rank", rank).where(F.col("rank") <= limit)
                .join(totals, ["share_id", "rule"])
                .select("share_id", "rule", "rank", "path", "n", F.greatest(F.col("n") - limit, F.lit(0)).alias("more")))


def triage_extensions(exclusions: DataFrame, prefix: str = "") -> DataFrame:
    """File extensions per rule, '(none)' for files without one; most frequent first."""
    ext = extension(basename(F.col("path")))
    return (_with_prefix(exclusions, prefix)
            .groupBy("share_id", "rule", F.when(ext == "", "(none)").otherwise(ext).alias("ext"))
            .agg(F.count(F.lit(1)).alias("n"))
            .orderBy("share_id", "rule", F.desc("n"), "ext"))


def triage_tracked(tracked: DataFrame, included: DataFrame, exclusions: DataFrame,
                   limit: int | None = policy.TRIAGE_LIMIT) -> DataFrame:
    """The same view over tracked files that did not ship."""
    return triage_paths(tracked_reasons(tracked, included, exclusions), limit=limit)


# -- verification ----------------------------------------------------------------

def verify_objects(listed: DataFrame, objects: DataFrame) -> DataFrame:
    """Delivered objects against the manifest: MISSING, CORRUPT, UNLISTED or OK.

    ``listed(share_id, path, sha256)`` covers files and shards; so does ``objects``."""
    want = listed.select(*KEYS, F.col("sha256").alias("want"), F.lit(True).alias("is_listed"))
    got = objects.select(*KEYS, F.col("sha256").alias("got"), F.lit(True).alias("is_there"))
    status = (F.when(F.col("is_listed").isNull(), "UNLISTED").when(F.col("is_there").isNull(), "MISSING")
              .when(F.col("want").eqNullSafe(F.col("got")), "OK").otherwise("CORRUPT"))
    return want.join(got, KEYS, "full_outer").select(*KEYS, status.alias("status"))


def verify_hashes(header: DataFrame, recomputed: DataFrame, column: str = "content_sha256") -> DataFrame:
    """Recorded against recomputed hash per share: MATCH or MISMATCH. A share without files has the hash of nothing."""
    new = recomputed.select("share_id", F.col(column).alias("recomputed"))
    same = F.col(column).eqNullSafe(F.coalesce("recomputed", F.sha2(F.lit(""), 256)))
    return header.select("share_id", column).join(new, "share_id", "left") \
                 .select("share_id", F.when(same, "MATCH").otherwise("MISMATCH").alias("result"))


def missing_documents(shares: DataFrame, present: DataFrame, required: list[str]) -> DataFrame:
    """Audit documents each share must have but does not: ``present(share_id, name)``."""
    wanted = shares.select("share_id", F.explode(F.array(*[F.lit(r) for r in required])).alias("name"))
    return wanted.join(present, ["share_id", "name"], "left_anti")


def share_status(problems: DataFrame, hashes: DataFrame, missing: DataFrame | None = None,
                 artifact: DataFrame | None = None) -> DataFrame:
    """(share_id, problems, status): 0 when everything matches, 2 otherwise.

    A mismatched artifact hash or a missing audit document ends a share's check: only that
    is counted then."""
    bad = problems.where("status <> 'OK'").groupBy("share_id").agg(F.count(F.lit(1)).alias("bad"))
    out = hashes.select("share_id", (F.col("result") != "MATCH").cast("long").alias("hash_bad")) \
                .join(bad, "share_id", "full_outer")
    stop = F.lit(0).cast("long")
    if missing is not None:
        lost = missing.groupBy("share_id").agg(F.count(F.lit(1)).alias("lost"))
        out = out.join(lost, "share_id", "full_outer")
        stop = F.coalesce("lost", stop)
    if artifact is not None:
        broken = artifact.select("share_id", (F.col("result") != "MATCH").cast("long").alias("artifact_bad"))
        out = out.join(broken, "share_id", "full_outer")
        stop = F.when(F.coalesce("artifact_bad", F.lit(0)) > 0, F.lit(1)).otherwise(stop)
    count = F.when(stop > 0, stop).otherwise(F.coalesce("hash_bad", F.lit(0)) + F.coalesce("bad", F.lit(0)))
    return out.select("share_id", count.alias("problems"), F.when(count == 0, 0).otherwise(2).alias("status"))
