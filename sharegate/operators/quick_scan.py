"""The quick scan: findings per file, verdict and findings hash per share."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sharegate.functions.quick import quick_findings
from sharegate.functions.text import decode_ignore


def texts_of(files: DataFrame) -> DataFrame:
    """Files as quick-scan texts: malformed bytes dropped, unreadable files as NULL."""
    unread = F.col("read_error").isNotNull()
    return files.select("share_id", "path", F.when(~unread, decode_ignore(F.col("content"))).alias("text"),
                        (unread | F.col("content").isNull()).alias("skipped"))


def quick_scan(texts: DataFrame) -> DataFrame:
    """(share_id, path, rule, severity, detail); one finding per rule and file, no shuffle."""
    return (texts.select("share_id", "path", F.explode(quick_findings(F.col("path"), F.col("text"))).alias("f"))
                 .select("share_id", "path", "f.*"))


@F.pandas_udf(StringType())
def _findings_hash(counts: pd.Series) -> pd.Series:
    """Hash of the comma-joined sorted rule IDs, each as often as it was found."""

    def digest(pairs) -> str:
        state, first = hashlib.sha256(), True
        for pair in sorted(pairs, key=lambda p: p["rule"]):
            item, left = pair["rule"].encode(), int(pair["n"])
            if left and first:
                state.update(item)
                first, left = False, left - 1
            while left:
                step = min(left, 4096)
                state.update((b"," + item) * step)
                left -= step
        return "sha256:" + state.hexdigest()[:12]

    return counts.map(digest)


def quick_verdict(texts: DataFrame, findings: DataFrame) -> DataFrame:
    """(share_id, verdict, findings_hash, n_findings); clean shares get a row too.

    Findings are counted per (share, rule) before anything is gathered, so the hash input
    is one entry per rule even for a share with any number of findings."""
    counts = findings.groupBy("share_id", "rule").agg(F.count(F.lit(1)).alias("n"))
    per_share = counts.groupBy("share_id").agg(F.collect_list(F.struct("rule", "n")).alias("counts"),
                                               F.sum("n").alias("n_findings"))
    none = F.expr("cast(array() AS array<struct<rule:string,n:bigint>>)")
    return (texts.select("share_id").distinct().join(per_share, "share_id", "left")
            .select("share_id", F.when(F.coalesce("n_findings", F.lit(0)) > 0, "BLOCKED").otherwise("CLEAN").alias("verdict"),
                    _findings_hash(F.coalesce("counts", none)).alias("findings_hash"),
                    F.coalesce("n_findings", F.lit(0)).alias("n_findings")))
