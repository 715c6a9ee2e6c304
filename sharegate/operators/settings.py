"""Effective settings as columns: run-wide literals plus optional per-share rows."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharegate.functions.paths import GLOB_PARTS, glob_parts
from sharegate.functions.sql import quote
from sharegate.operators.joins import lookup_join
from sharegate.policy import ShareSettings

OVERRIDES_SCHEMA = (
    "share_id string, allow array<string>, deny_globs array<string>, exclude_folders array<string>, "
    "exclude_paths array<string>, share_mode string, source_only boolean, max_chars int, "
    "respect_ignore boolean, ignore_files array<string>, pii boolean, pii_allow array<string>, "
    "pii_skip_author boolean, config_error boolean")
_FIELDS = [f.strip().split(" ") for f in OVERRIDES_SCHEMA.split(",")]


DENY_TABLE = f"array<struct<glob:string,parts:{GLOB_PARTS}>>"


def deny_rows(globs) -> list[dict] | None:
    return None if globs is None else [{"glob": g.lower(), "parts": glob_parts(g.lower())} for g in globs if g is not None]


def _compiled_globs(globs: str) -> Column:
    """Runs on the settings table only, once per share."""
    def compiled(column: pd.Series) -> pd.Series:
        return column.map(deny_rows)

    return F.pandas_udf(compiled, DENY_TABLE)(globs)


def complete_overrides(overrides: DataFrame) -> DataFrame:
    """All override columns, absent ones as NULL."""
    have = set(overrides.columns)
    return overrides.select(*[(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in _FIELDS])


def one_per_share(rows: DataFrame) -> DataFrame:
    """One settings row per share. A share mode other than the two, and a second row for a share, are
    configuration errors: such a share is withheld whole."""
    bad = F.coalesce(F.col("config_error"), F.lit(False)) | ~F.coalesce(F.col("share_mode").isin("public", "private"), F.col("share_mode").isNull())
    packed = rows.withColumn("config_error", bad).select("share_id", F.struct(*[c for c in rows.columns if c != "share_id"]).alias("o"))
    folded = packed.groupBy("share_id").agg(F.first("o").alias("o"), F.count(F.lit(1)).alias("n"))
    return folded.select("share_id", "o.*", "n").withColumn("config_error", F.col("config_error") | (F.col("n") > 1)).drop("n")


SHARES = 1_000  # personal data is looked for in so many named shares, or in all


@dataclass(frozen=True)
class Wanted:
    """What the scan must find out, so that any row's settings can be applied to its facts afterwards."""

    late: bool  # settings that differ between rows are applied after the scan
    public: bool  # some share goes to the public
    pii: str  # SQL: may the row's share ask for personal data?
    ignore: bool  # every share respects ignore files

    @staticmethod
    def of(settings: ShareSettings, overrides: DataFrame | None = None) -> Wanted:
        public, pii, ignore = settings.share_mode == "public", str(settings.pii).lower(), settings.respect_ignore
        if overrides is None:
            return Wanted(False, public, pii, ignore)
        rows = complete_overrides(overrides)
        found = rows.agg(F.max(F.col("share_mode") == "public").alias("public"), F.min("respect_ignore").alias("ignore"), F.max("pii").alias("pii")).first()
        if not settings.pii and found["pii"]:
            names = [r["share_id"] for r in rows.where("pii").select("share_id").distinct().limit(SHARES + 1).collect()]
            pii = "true" if len(names) > SHARES or None in names else f"coalesce(share_id IN ({', '.join(map(quote, names))}), false)"
        return Wanted(True, public or bool(found["public"]), pii, (found["ignore"] if found["ignore"] is not None else True) and ignore)

    @staticmethod
    def by_any(policies: list[ShareSettings]) -> Wanted:
        return Wanted(True, any(p.share_mode == "public" for p in policies), str(any(p.pii for p in policies)).lower(), all(p.respect_ignore for p in policies))


#: Settings of the run itself: they decide what is read, so policies that share one scan must agree on them.
RUN_FIELDS = ("exclude_exts", "exclude_names", "focus", "output_prefix", "max_scan_bytes", "nul_window_bytes")


def common_settings(policies: list[ShareSettings]) -> ShareSettings:
    """What all policies have in common, for the one scan under them."""
    first = policies[0]
    for field in RUN_FIELDS:
        if len({getattr(p, field) for p in policies}) > 1:
            raise ValueError(f"policies of one scan must have the same {field}")
    return ShareSettings(**{f: getattr(first, f) for f in RUN_FIELDS})


def policy_row(settings: ShareSettings) -> Column:
    """Settings as the struct that :meth:`Effective.attach` gives a share with settings of its own."""
    values = {f: getattr(settings, f) for f, _ in _FIELDS if f not in ("share_id", "config_error")} | {"config_error": False}
    kinds = dict(_FIELDS)

    def lit(value, kind):
        return F.lit(value).cast(kind) if not isinstance(value, tuple) else F.array(*map(F.lit, value)).cast(kind)

    def part(p):
        sets = None if p["sets"] is None else F.array(*[F.struct(F.lit(s["k"]).alias("k"), F.lit(s["negate"]).alias("negate"), F.array(*[
            F.struct(F.lit(r["lo"]).alias("lo"), F.lit(r["hi"]).alias("hi")) for r in s["ranges"]]).cast("array<struct<lo:string,hi:string>>").alias("ranges")) for s in p["sets"]])
        sets = (F.lit(None) if sets is None else sets).cast("array<struct<k:int,negate:boolean,ranges:array<struct<lo:string,hi:string>>>>")
        return F.struct(F.lit(p["text"]).alias("text"), F.lit(p["size"]).alias("size"), sets.alias("sets"))

    deny = F.array(*[F.struct(F.lit(d["glob"]).alias("glob"), F.array(*map(part, d["parts"])).alias("parts")) for d in deny_rows(settings.deny_globs)]).cast(DENY_TABLE)
    return F.struct(*[lit(v, kinds[f]).alias(f) for f, v in values.items()], deny.alias("deny_table"))


class Effective:
    """Column view of the settings of each row's share."""

    def __init__(self, settings: ShareSettings, per_share: bool = False):
        self.settings = settings
        self.per_share = per_share

    def attach(self, df: DataFrame, overrides: DataFrame | None) -> DataFrame:
        """Bring the share's override row to each row (of facts, without content) as one struct column ``_o``."""
        if overrides is None:
            return df
        rows = one_per_share(complete_overrides(overrides)).withColumn("deny_table", _compiled_globs("deny_globs"))
        packed = rows.select("share_id", F.struct(*[c for c in rows.columns if c != "share_id"]).alias("_o"))
        return lookup_join(df, packed, ["share_id"])

    def value(self, name: str) -> Column:
        base = F.lit(getattr(self.settings, name))
        return F.coalesce(F.col("_o")[name], base) if self.per_share else base

    def own(self, name: str, lower: bool = False) -> Column | None:
        """The share's own list; NULL where shares have none."""
        if not self.per_share:
            return None
        values = F.coalesce(F.col("_o")[name], F.array().cast("array<string>"))
        return F.transform(values, lambda v: F.lower(v)) if lower else values

    def array(self, name: str) -> Column | None:
        """Run-wide and per-share list as one array column; NULL when there is neither."""
        fixed, own = run_list(self.settings, name), self.own(name)
        return own if fixed is None else fixed if own is None else F.concat(fixed, own)

    def contains(self, name: str, value: Column) -> Column:
        values = self.array(name)
        return F.lit(False) if values is None else F.coalesce(F.array_contains(values, value), F.lit(False))

    @property
    def public(self) -> str:
        """SQL condition: does the row's share go to the public?"""
        mode = self.settings.share_mode
        return f"coalesce(_o.share_mode, '{mode}') = 'public'" if self.per_share else f"'{mode}' = 'public'"

    @property
    def broken(self) -> Column:
        return F.coalesce(F.col("_o")["config_error"], F.lit(False)) if self.per_share else F.lit(False)


def run_list(settings: ShareSettings, name: str, lower: bool = False) -> Column | None:
    values = [v.lower() if lower else v for v in getattr(settings, name)]
    return F.array(*[F.lit(v) for v in values]) if values else None
