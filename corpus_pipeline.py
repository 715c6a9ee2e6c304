"""A training corpus from ``documents``: quality rules, near duplicates, repeated passages, source mix, packing.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept. All but the last return the
columns of ``documents``; the last returns one row per packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sharegate.llm import dartminhash, mixing, packing, quality, substrings
from sharegate.llm.common import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the threshold table. Null and empty texts have no words and go; repeated rows are judged one by
    one; a null language spares a text no rule; an empty table stays empty."""
    return quality.keep_good(docs, lang="lang")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near duplicates. Documents without words have no near duplicates."""
    return dartminhash.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that a document with a smaller id has are cut; documents left without a word go."""
    return substrings.without_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, so that sources come near their target words. Texts without words are not
    taken; equal rows are taken together; a null source is the last source; an empty table stays empty."""
    mixed = mixing.mix(docs, keep=True).where("copies > 0")
    return mixed.select("row", F.explode(F.array_repeat(F.lit(True), F.col("copies").cast("int")))).select("row.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences; a document that is taken twice is packed twice. A null text is empty
    and gives its end token; an empty table gives no piece."""
    return packing.pack(stored(packing.token_pieces(docs)))


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("repeated passages", repeated_passages),
          ("source mix", source_mix), ("best-fit packing", best_fit_packing)]

#: Weighted sketches, greedy parsing and packing by evolution have no SQL equivalent; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))  # written and read again: a later stage reads its input several times
    return STAGES[-1][1](spark, docs, sf_dir)
