"""Joins against per-share or per-directory tables without assuming they are small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 32


def measured_bytes(df: DataFrame) -> int:
    """Size of a table, summed over its rows as JSON text (one aggregate job)."""
    row = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))).alias("n")).first()
    return int(row["n"] or 0)


def lookup_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", *,
                spread_by: str = "path", size: int | None = None, max_bytes: int = BROADCAST_BYTES, salts: int = SALTS) -> DataFrame:
    """Join ``left`` to a lookup table whose keys may be used very unevenly.

    The lookup side is measured (or its ``size`` in bytes is passed on). Up to ``max_bytes`` it is broadcast; beyond that every key
    gets ``salts`` copies and ``left`` rows pick one by a hash of ``spread_by``, so a key
    that holds a third of ``left`` still lands in many tasks. Left rows are never copied.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"lookup_join cannot salt a {how} join")
    if (measured_bytes(right) if size is None else size) <= max_bytes:
        return left.join(F.broadcast(right), on, how)
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    spread = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(spread, [*on, "_salt"], how).drop("_salt")
