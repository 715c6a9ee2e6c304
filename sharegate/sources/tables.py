"""Sources that are tables: corpora, path lists, settings."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sharegate.functions.paths import is_source_name, basename
from sharegate.operators.classify import EXPLICIT, WALK
from sharegate.operators.settings import OVERRIDES_SCHEMA, complete_overrides
from sharegate.policy import ShareSettings

PATH_LIST = "path list"


def texts_from(df: DataFrame, share_id: Column, path: Column, text: Column) -> DataFrame:
    """Any table with an identifier and a text column as texts(share_id, path, text)."""
    return df.select(share_id.alias("share_id"), path.alias("path"), text.alias("text"))


def read_path_list(spark: SparkSession, location: str, share_id: str = "", root: str | None = None) -> DataFrame:
    """A path list written by the structural pass: blanks and directory lines are skipped. Absolute lines below
    ``root`` become relative to it."""
    lines = spark.read.text(location).select(F.btrim("value", F.lit(" \t\r")).alias("path"))
    relative = F.regexp_replace("path", r"^\./", "")
    if root is not None:
        top = root.rstrip("/") + "/"
        relative = F.when(F.startswith("path", F.lit(top)), F.expr(f"substring(path, {len(top) + 1})")).otherwise(relative)
    return (lines.where((F.col("path") != "") & ~F.endswith("path", F.lit("/")))
                 .select(F.lit(share_id).alias("share_id"), relative.alias("path")).distinct())


def select_files(files: DataFrame, *, explicit: DataFrame | None = None, path_list: DataFrame | None = None) -> tuple[DataFrame, str]:
    """Files to decide on and the label of how they were chosen.

    An explicit list wins over a path list, which wins over the whole tree. A path list
    that names no existing file falls through to the tree."""
    keys = ["share_id", "path"]
    if explicit is not None:
        return files.join(explicit.select(*keys).distinct(), keys, "left_semi"), EXPLICIT
    if path_list is not None:
        chosen = files.join(path_list.select(*keys).distinct(), keys, "left_semi")
        if not chosen.select(*keys).isEmpty():
            return chosen, PATH_LIST
    return files, WALK


def overrides_from_json(df: DataFrame, share_id: str = "share_id", body: str = "json") -> DataFrame:
    """Per-share settings from JSON text. A text that does not parse marks the share
    ``config_error``; such a share is withheld whole instead of losing its deny rules. So is one whose
    ``share_mode`` is neither public nor private. Ignore files are turned off by ``respect_gitignore`` (or ``respect_ignore``)."""
    fields = [f for f in OVERRIDES_SCHEMA.split(", ") if not f.startswith(("share_id ", "config_error "))]
    schema = ", ".join([*fields, "respect_gitignore boolean", "_corrupt string"])
    parsed = df.select(F.col(share_id).alias("share_id"), F.col(body).alias("_body"), F.from_json(
        F.col(body), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("o"))
    broken = F.col("_body").isNotNull() & (F.col("o").isNull() | F.col("o._corrupt").isNotNull())
    rows = parsed.select("share_id", "o.*", broken.alias("config_error"))
    return complete_overrides(rows.withColumn("respect_ignore", F.coalesce("respect_gitignore", "respect_ignore")))


def structural_config(df: DataFrame, body: str = "json") -> dict[str, list[str]]:
    """Extra directory, extension and file names from one shared JSON config row."""
    kinds = "exclude_dirs array<string>, exclude_exts array<string>, exclude_filenames array<string>"
    row = df.limit(1).select(F.from_json(body, kinds).alias("c")).select("c.*").first()
    values = row.asDict() if row else {}
    return {k: sorted({v.lower() for v in (values.get(k) or [])})
            for k in ("exclude_dirs", "exclude_exts", "exclude_filenames")}


def with_structural_config(settings: ShareSettings, config: dict[str, list[str]]) -> ShareSettings:
    """The run's settings with the shared structural names added; pass the same config to ``structural_filter``."""
    more = {"exclude_folders": "exclude_dirs", "exclude_exts": "exclude_exts", "exclude_names": "exclude_filenames"}
    return replace(settings, **{field: tuple(dict.fromkeys([*getattr(settings, field), *config[kind]])) for field, kind in more.items()})


def source_files(files: DataFrame) -> DataFrame:
    return files.where(is_source_name(basename(F.col("path"))))
