"""What several operators share: words, private column names, ordering over range pieces."""

from __future__ import annotations

import bisect
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharegate.session import ensure_checkpoint_dir

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def text_of(column: str) -> Column:
    """The text of a row as a string; a null text is empty."""
    return F.coalesce(F.col(quoted(column)).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def size_estimate(df: DataFrame, column: str, piece_bytes: int, least: int = 1) -> int:
    """Number of pieces of about ``piece_bytes`` that hold the texts of ``column`` (one aggregate, no shuffle of texts)."""
    total = df.agg(F.sum(F.octet_length(F.col(quoted(column)).cast("string")))).first()[0] or 0
    return max(least, -(-int(total) // piece_bytes))


def range_bounds(df: DataFrame, key: str, pieces: int, accuracy: int = 10_000) -> list:
    """Ascending, distinct lower bounds of the second and later range pieces of an integer key.

    They come from a quantile sketch of the key column; at most ``pieces - 1`` numbers reach the driver.
    Bounds only decide how even the pieces are, never the result."""
    if pieces < 2:
        return []
    at = [i / pieces for i in range(1, pieces)]
    found = df.agg(F.percentile_approx(F.col(quoted(key)), at, accuracy).alias("b")).first()["b"]
    return sorted(set(found or []))


def piece_of(key: Column, bounds: list) -> Column:
    """Number of the range piece: how many bounds are at or below the key. A null key sorts first."""
    if not bounds:
        return F.lit(0)

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(bounds[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return F.when(key.isNull(), F.lit(0)).otherwise(tree(0, len(bounds)))


def piece_of_value(value, bounds: list) -> int:
    return 0 if value is None else bisect.bisect_right(bounds, value)


def shared_folder(spark) -> str:
    """A new folder below the session's checkpoint folder, which all executors and the driver share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage with a table in the shared folder: compressed, and read again by columns."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
