"""The gate on streams: the batch column rules, row by row, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sharegate.operators.classify import decide, files_from_texts, scan
from sharegate.operators.settings import Effective
from sharegate.policy import ShareSettings
from sharegate.session import path_exists


#: Messages are texts: none is too long to be scanned.
MESSAGES = ShareSettings(max_scan_bytes=None)


def gate_stream(messages: DataFrame, settings: ShareSettings = MESSAGES, keys: tuple[str, ...] = ()) -> DataFrame:
    """Decisions for ``messages(share_id, path, text[, ts])``, batch or streaming.

    Everything is per row, so the query runs in append mode and keeps no state. ``ts``, if
    there, and the columns ``keys`` pass through."""
    eff, passed = Effective(settings), [*(c for c in messages.columns if c == "ts"), *keys]
    if not passed:
        return decide(scan(files_from_texts(messages), eff))
    keyed = messages.withColumn("share_id", F.struct("share_id", *passed))
    decided = decide(scan(files_from_texts(keyed), eff))
    return decided.withColumns({c: F.col("share_id")[c] for c in passed}).withColumn("share_id", F.col("share_id.share_id"))


def route(decisions: DataFrame, shared: str, withheld: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append each micro-batch to the ``shared`` or ``withheld`` Parquet folder.

    The batch is held while both writes read it, so each message is decided once. Rows carry
    the batch number: a replayed batch leaves a finished folder as it is and writes an unfinished one anew, so it adds no
    duplicates and a stream that reads these folders (``rule_rollup``) sees each file once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        ok = F.col("status") == "included"
        parts = [(rows, f"{folder}/batch={batch_id}") for rows, folder in ((ok, shared), (~ok, withheld))]
        parts = [(rows, folder) for rows, folder in parts if not path_exists(batch.sparkSession, f"{folder}/_SUCCESS")]
        batch = batch.persist()
        try:
            for rows, folder in parts:
                batch.where(rows).write.mode("overwrite").parquet(folder)
        finally:
            batch.unpersist()

    return (decisions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def rule_rollup(decisions: DataFrame, window: str = "1 hour", lateness: str = "1 hour", keys: tuple[str, ...] = ()) -> DataFrame:
    """Withheld messages per tumbling window of ``ts``, the columns ``keys`` and rule; later rows than the
    watermark allows are dropped."""
    return (decisions.where("status = 'excluded'").withWatermark("ts", lateness)
            .groupBy(F.window("ts", window).alias("w"), *keys, "rule").agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "rule", "n"))


def late_rows(decisions: DataFrame, counts: DataFrame, window: str = "1 hour") -> DataFrame:
    """(window_start, window_end, rule, n_late): withheld messages that came after the watermark had closed their window.

    ``decisions`` are all that were routed, ``counts`` the final rows of ``rule_rollup`` over them: what a window holds and its
    count does not is what the watermark dropped. Both sides are pre-aggregated to one row per window and rule."""
    total = (decisions.where("status = 'excluded'").groupBy(F.window("ts", window).alias("w"), "rule").agg(F.count(F.lit(1)).alias("total"))
             .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "rule", "total"))
    both = total.join(counts.select("window_start", "rule", "n"), ["window_start", "rule"], "left")
    late = (F.col("total") - F.coalesce("n", F.lit(0))).alias("n_late")
    return both.select("window_start", "window_end", "rule", late).where("n_late > 0")
