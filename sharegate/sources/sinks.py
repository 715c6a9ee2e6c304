"""Writing result tables. Everything is written by many tasks; one folder per share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sharegate.session import path_exists

FILES_PER_SHARE = 32


def by_share(df: DataFrame) -> DataFrame:
    """Rows of a share in at most FILES_PER_SHARE tasks, instead of a file of every share from every task."""
    key = "path" if "path" in df.columns else df.columns[0]
    return df.repartition("share_id", F.pmod(F.xxhash64(key), F.lit(FILES_PER_SHARE)))


def write_tables(tables: dict[str, DataFrame], folder: str, mode: str = "overwrite") -> None:
    """Each result table as Parquet under ``folder``, cut by share."""
    for name, df in tables.items():
        writer = df.write.mode(mode)
        if "share_id" in df.columns:
            writer = by_share(df).write.mode(mode).partitionBy("share_id")
        writer.parquet(f"{folder}/{name}")


def write_json(df: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """One JSON record per row."""
    df.write.mode(mode).json(folder)


def write_lines(lines: DataFrame, folder: str, order: list[str], mode: str = "overwrite") -> None:
    """A (share_id, .., line) table as text. Range partitions keep the order across files,
    so the files of a share, by name, are the document."""
    (lines.repartitionByRange("share_id", *order).sortWithinPartitions("share_id", *order)
          .select("share_id", F.col("line").alias("value")).write.mode(mode).partitionBy("share_id").text(folder))


def _without(rows: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key (nulls are equal) is not among those of ``have``."""
    known = have.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    return rows.join(known, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_anti")


LEDGER_KEY = ("event", "share_id", "timestamp_utc")


def append_ledger(events: DataFrame, folder: str, keys: tuple[str, ...] = LEDGER_KEY) -> None:
    """Append events as JSON records with sorted keys; earlier records are never rewritten.

    An event is its key: one that the ledger has is not added again, so a run or stream batch that is repeated leaves the ledger as it is. Only the
    days of the new events are looked up in it (a folder per day). One writer at a time, as for any appended folder."""
    day = F.coalesce(F.date_format(F.to_timestamp("timestamp_utc"), "yyyy-MM-dd"), F.lit("none"))
    rows = events.withColumn("day", day).dropDuplicates(list(keys))
    if path_exists(events.sparkSession, folder):
        span = rows.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
        types = {f.name: f.dataType.simpleString() for f in events.schema}
        have = events.sparkSession.read.schema(", ".join([*(f"`{k}` {types[k]}" for k in keys), "day string"])).json(folder)
        rows = _without(rows, have.where(F.col("day").between(span["a"] or "", span["b"] or "")), list(keys))
    rows.select(*sorted(events.columns), "day").repartition("day").write.mode("append").partitionBy("day").json(folder)


def add_objects(objects: DataFrame, folder: str) -> None:
    """Add contents to a store of (sha256, content); a hash that the store has is not written again."""
    if path_exists(objects.sparkSession, folder):
        objects = _without(objects, objects.sparkSession.read.parquet(folder), ["sha256"])
    objects.write.mode("append").option("parquet.block.size.row.check.min", "1").parquet(folder)
