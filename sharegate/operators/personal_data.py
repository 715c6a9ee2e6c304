"""Personal-data operators on any table with a text column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sharegate.functions import pii


def pii_hits(df: DataFrame, column: str, allow=None, skip_author: bool = True) -> DataFrame:
    """One row per hit: the other columns, then rule, offset and length. Values are not kept.

    Texts that cannot match are dropped by the plain patterns before the line work."""
    rest = [c for c in df.columns if c != column]
    hits = df.select(*rest, F.explode(pii.pii_hits(column, allow, str(skip_author).lower())).alias("h"))
    return hits.select(*rest, pii.pii_rule("h.ord").alias("rule"), F.col("h.offset").alias("offset"),
                       F.col("h.match_len").alias("match_len"))


def redact(df: DataFrame, column: str, allow=None, skip_author: bool = True) -> DataFrame:
    return df.withColumn(column, pii.redact_pii(column, allow, str(skip_author).lower()))


def pii_counts(df: DataFrame, column: str, by: list[str], allow=None, skip_author: bool = True) -> DataFrame:
    """Number of matches per rule and the given columns."""
    hits = pii_hits(df.select(*by, column), column, allow, skip_author)
    return hits.groupBy(*by, "rule").agg(F.count(F.lit(1)).alias("n_matches"))
