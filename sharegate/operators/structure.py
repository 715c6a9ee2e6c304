"""Structural pre-filter: a coarse listing pass on paths, and folder sums over what is left."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharegate import policy
from sharegate.functions.paths import ancestors, basename, extension
from sharegate.functions.text import rx


def _dir_pattern(extra_dirs: tuple[str, ...]) -> str:
    names = "|".join(re.sub(r"([^\w])", r"\\\1", d.lower()) for d in [*policy.STRUCTURE_DIRS, *extra_dirs])
    marks = "|".join(re.sub(r"([^\w])", r"\\\1", m) for m in policy.BACKUP_FOLDER_MARKS)
    return f"(?s)(?:^|/)(?:(?:{names})|[^/]*(?:{marks})[^/]*)/"


def structural_keep(path: Column, extra_dirs=(), extra_exts=(), extra_names=()) -> Column:
    """True for paths the coarse pass lists. Names at the root of the tree may be exempt."""
    low = F.lower(path)
    name, parent = basename(low), F.regexp_extract(low, "(?s)^(.*/)", 1)
    names = [*policy.STRUCTURE_NAMES, *[n.lower() for n in extra_names]]
    exts = [e.lower() for e in [*policy.STRUCTURE_EXTS, *extra_exts]]
    multi = [F.endswith(name, F.lit(e)) for e in exts if e.count(".") > 1]
    dropped_ext = extension(name).isin(exts)
    for test in multi:
        dropped_ext = dropped_ext | test
    stem = F.ltrim(name, F.lit("."))
    bak_suffix = stem.rlike(r"(?s).\.bak(?:\.|$)")
    bad_dir = parent.rlike(_dir_pattern(tuple(extra_dirs))) | parent.rlike(rx(policy.ARCHIVE_FOLDER_PATTERN))
    bad_file = (name.isin(names) | bak_suffix | dropped_ext
                | F.startswith(name, F.lit("~$")) | F.endswith(name, F.lit("~")))
    exempt = (parent == "") & name.isin(policy.STRUCTURE_ROOT_KEEP) & ~name.isin(names)
    return ~bad_dir & (exempt | ~bad_file)


def structural_filter(files: DataFrame, **extra) -> DataFrame:
    return files.where(structural_keep(F.col("path"), **extra))


def folder_summary(files: DataFrame) -> DataFrame:
    """Files and bytes below every ancestor directory, partially summed before the shuffle."""
    return (files.select("share_id", F.explode(ancestors(F.col("path"))).alias("dir"), "length")
                 .groupBy("share_id", "dir")
                 .agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes")))
