"""Ignore files: gathering, parsing and deciding on paths alone, before any other content is read.

Up to ``LITERAL_RULES`` rules become literal patterns, one set per distinct list of rules, and a path's decision is a projection.
More rules meet the paths in joins on the owning directory. Both ways give the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharegate.functions.paths import ancestors, basename, clean_relative, parent_dir
from sharegate.functions.text import decode_replace, rendered_lines
from sharegate.functions.sql import quote
from sharegate.operators.joins import BROADCAST_BYTES, lookup_join
from sharegate.operators.settings import complete_overrides

_VCS_DIR = r"(?:^|/)\.(?:git|hg|svn)/"
# negation, an escaped first sign, the pattern, the mark of a directory
_LINE = r"(?s)^(!?)(?:\\(?=[#!]))?(.*?)(/?)$"
_PIECES = r"(?s)\*\*/|\*\*|\*|\?|[^*?]+"
_SIGNS = r"([\x00-\x7F&&[^A-Za-z0-9_/]])"  # escaped one by one; Java allows that for any ASCII sign


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _SIGNS, r"\\$1")


def ignore_rule(base: Column, line: Column) -> Column:
    """One ignore line as struct(regex, needle, negate, dir_only); the regex reads share-relative paths. ``needle`` is
    the longest literal piece, which every matching path must contain."""
    part = lambda k: F.regexp_extract(line, _LINE, k)
    pattern = F.ltrim(part(2), F.lit("/"))
    pieces = F.regexp_extract_all(pattern, F.lit(_PIECES), F.lit(0))
    anywhere = ~F.contains(F.rtrim(part(2), F.lit("/")), F.lit("/"))
    body = F.array_join(F.transform(pieces, lambda p: F.when(p == "**/", "(?:.*/)?").when(p == "**", ".*").when(p == "*", "[^/]*")
                                    .when(p == "?", "[^/]").otherwise(escaped(p))), "")
    prefix = F.when(base == "", F.lit("")).otherwise(escaped(F.concat(base, F.lit("/"))))
    regex = F.concat(F.lit("(?Ud)^"), prefix, F.when(anywhere, F.lit("(?:.*/)?")).otherwise(F.lit("")), body, F.lit("(?:/.*)?$"))
    literals = F.filter(pieces, lambda p: ~F.rlike(p, F.lit(r"^[*?]")))
    longest = F.array_max(F.transform(literals, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]
    return F.struct(regex.alias("regex"), F.coalesce(longest, F.lit("")).alias("needle"), (part(1) == "!").alias("negate"), (part(3) == "/").alias("dir_only"))


GITIGNORE = ".gitignore"
LITERAL_RULES = 1_000


def _named_by_share(overrides: DataFrame, extra_names: tuple[str, ...]) -> DataFrame:
    """(share_id, _base, name_ord): ignore files that a share's own settings name, behind those of the run. A share that turns
    ignore files off has no rules (name_ord -1)."""
    rows = complete_overrides(overrides)
    own = F.transform(F.coalesce("ignore_files", F.array().cast("array<string>")), lambda n, i: F.struct(n.alias("_base"), (i + 1 + len(extra_names)).alias("name_ord")))
    off = F.array(F.struct(F.lit(GITIGNORE).alias("_base"), F.lit(-1).alias("name_ord")))
    named = rows.select("share_id", F.explode(F.when(F.col("respect_ignore"), own).when(~F.col("respect_ignore"), off).otherwise(own)).alias("k")).select("share_id", "k.*")
    return named.where("_base IS NOT NULL").groupBy("share_id", "_base").agg(F.min("name_ord").cast("int").alias("name_ord"))


def ignore_files(files: DataFrame, extra_names: tuple[str, ...] = (), overrides: DataFrame | None = None) -> DataFrame:
    """The ignore files among ``files(share_id, path, ..)`` with their order ``name_ord``: .gitignore, those the run names, those
    the share names. Files are told by name first, so content of other files meets no join."""
    names = [GITIGNORE, *extra_names]
    rows = files.withColumn("_base", basename(F.col("path"))).where(~F.col("path").rlike(_VCS_DIR))
    order = (F.array_position(F.array(*[F.lit(n) for n in names]), F.col("_base")) - 1).cast("int")
    if overrides is None:
        return rows.where(F.col("_base").isin(names)).withColumn("name_ord", order).drop("_base")
    own = _named_by_share(overrides, extra_names)
    wanted = own.select("_base").distinct().unionByName(files.sparkSession.createDataFrame([(n,) for n in names], "_base string")).distinct()
    candidates = lookup_join(rows, wanted, ["_base"], "left_semi")  # distinct file names
    met = candidates.join(own, ["share_id", "_base"], "left")
    off = own.where("name_ord < 0").select("share_id")
    run_wide = F.when(F.col("_base").isin(names), order)
    return met.withColumn("name_ord", F.coalesce(run_wide, "name_ord")).where("name_ord >= 0").join(off, "share_id", "left_anti").drop("_base")


def gather_ignore_rules(files: DataFrame, extra_names: tuple[str, ...] = (), overrides: DataFrame | None = None) -> DataFrame:
    """Rules of all ignore files in ``files(share_id, path, content)``; ``extra_names`` are ignore files of the run
    (``settings.ignore_files``), ``overrides`` may name more per share.

    Rule order is (depth, base, file name order, line): deeper files override."""
    lines = (ignore_files(files, extra_names, overrides)
             .where(F.col("content").isNotNull()).withColumn("text", decode_replace(F.col("content")))
             .select("share_id", parent_dir(F.col("path")).alias("base"), "name_ord",
                     F.posexplode(F.expr(rendered_lines("text"))).alias("line_no", "raw"))
             .withColumn("line", F.regexp_replace("raw", r"(?Ud)[\s\x1C-\x1F]+$", ""))
             .where((F.col("line") != "") & ~F.col("line").rlike(r"(?Ud)^\s*#")))
    return parsed_rules(lines)


def parsed_rules(lines: DataFrame) -> DataFrame:
    """(share_id, base, name_ord, line_no, line) -> rules with regex and flags."""
    depth = F.when(F.col("base") == "", 0).otherwise(F.size(F.split("base", "/", -1)))
    return lines.select("share_id", "base", depth.alias("depth"), "name_ord", "line_no",
                        ignore_rule(F.col("base"), F.col("line")).alias("r")) \
                .select("share_id", "base", "depth", "name_ord", "line_no", "r.*")


def _by_base(rules: DataFrame) -> DataFrame:
    """One row per directory that owns ignore files, with its rules in order."""
    rule = F.struct("name_ord", "line_no", "regex", "needle", "negate", "dir_only")
    return rules.groupBy("share_id", "base", "depth").agg(F.array_sort(F.collect_list(rule)).alias("rules"))


def ignored_paths(paths: DataFrame, by_base: DataFrame, is_dir: bool) -> DataFrame:
    """(share_id, path) of the ignored paths; the last matching rule decides.

    A path meets the rules of its own ancestor directories only: it is joined on
    (share, directory), never paired with all rules of its share. The directory at the top of a large share meets all its
    paths, so the rules are copied over salts; nothing is measured, so nothing runs before the result is asked for."""
    rel = clean_relative(F.col("path"))
    bases = F.concat(F.array(F.lit("")), ancestors(F.col("rel")))
    exploded = paths.select("share_id", "path", rel.alias("rel")) \
                    .select("share_id", "path", "rel", F.explode(bases).alias("base"))
    met = lookup_join(exploded, by_base, ["share_id", "base"], "inner", size=BROADCAST_BYTES + 1)

    def applies(r: Column) -> Column:
        test = F.contains(F.col("rel"), r["needle"]) & F.rlike(F.col("rel"), r["regex"])
        return test if is_dir else ~r["dir_only"] & test

    hits = F.filter("rules", applies)
    verdicts = met.select("share_id", "path", "depth", F.get(hits, F.size(hits) - 1)["negate"].alias("negate")) \
                  .where(F.col("negate").isNotNull())
    return (verdicts.groupBy("share_id", "path").agg(F.max_by("negate", "depth").alias("negate"))
                    .where(~F.col("negate")).select("share_id", "path"))


def ignore_decisions(files: DataFrame, rules: DataFrame, *, walk: bool = True, min_depth: int = 0) -> DataFrame:
    """(share_id, path, ign_file, ign_depth) for files an ignore rule touches, by joins.

    ``ign_depth`` is the depth of the shallowest ignored ancestor directory: everything
    below it goes with it, whatever deeper rules say. Needs only (share_id, path)."""
    by_base = _by_base(rules)
    paths = lookup_join(files.select("share_id", "path"), rules.select("share_id").distinct(), ["share_id"], "left_semi", size=BROADCAST_BYTES + 1)
    single = ignored_paths(paths, by_base, is_dir=False).withColumn("ign_file", F.lit(True))
    if not walk:
        return single.withColumn("ign_depth", F.lit(None).cast("int"))
    ladder = paths.select("share_id", "path", F.posexplode(ancestors(F.col("path"))).alias("i", "dir")) \
                  .where(F.col("i") >= min_depth)
    # every directory is decided once, whatever the number of files below it
    dirs = ladder.select("share_id", F.col("dir").alias("path")).distinct()
    ignored = ignored_paths(dirs, by_base, is_dir=True).withColumnRenamed("path", "dir")
    under = (lookup_join(ladder, ignored, ["share_id", "dir"], "inner", size=BROADCAST_BYTES + 1)
             .groupBy("share_id", "path").agg((F.min("i") + 1).alias("ign_depth")))
    return single.join(under, ["share_id", "path"], "full_outer") \
                 .select("share_id", "path", F.coalesce("ign_file", F.lit(False)).alias("ign_file"), "ign_depth")


def literal_sets(rules: DataFrame, most: int = LITERAL_RULES) -> dict[tuple, list[str]] | None:
    """Distinct rule lists ((regex, negate, dir_only), ..) in order, each with the shares that have it; None above ``most`` rules."""
    fields = F.struct("share_id", "depth", "base", "name_ord", "line_no", "regex", "negate", "dir_only")
    rows = rules.limit(most + 1).agg(F.collect_list(fields).alias("rows")).first()["rows"]  # one job, whatever the number of tasks
    if len(rows) > most:
        return None
    shares: dict = {}
    for r in sorted(rows, key=lambda r: (r["share_id"] or "", *r[1:5])):
        if r["share_id"] is not None:
            shares.setdefault(r["share_id"], []).append(tuple(r[5:]))
    sets: dict = {}
    for share, found in shares.items():
        sets.setdefault(tuple(found), []).append(share)
    return sets


def _verdict(rel: str, found: tuple, is_dir: bool) -> str:
    """SQL: is the path ignored? The last rule that matches decides."""
    cases = [f"WHEN rlike({rel}, {quote(regex)}) THEN {str(not negate).lower()}" for regex, negate, dir_only in reversed(found) if is_dir or not dir_only]
    return f"CASE {' '.join(cases)} ELSE false END" if cases else "false"


def with_literal_decisions(files: DataFrame, sets: dict[tuple, list[str]], *, walk: bool = True, min_depth: int = 0) -> DataFrame:
    """The files with ``ign_file`` and ``ign_depth`` from their paths, by a projection of literal patterns."""
    def by_share(verdict) -> str:
        cases = [f"WHEN share_id IN ({', '.join(map(quote, shares))}) THEN {verdict(found)}" for found, shares in sets.items()]
        return f"CASE {' '.join(cases)} END" if cases else "NULL"

    files = files.withColumn("ign_file", F.expr(f"coalesce(CAST({by_share(lambda f: _verdict(LTRIM.format('path'), f, False))} AS boolean), false)"))
    if not walk or not sets:
        return files.withColumn("ign_depth", F.lit(None).cast("int"))
    at = by_share(lambda f: f"array_position(transform(_up, d -> {_verdict(LTRIM.format('d'), f, True)}), true)")
    up = F.slice(ancestors(F.col("path")), F.lit(min_depth + 1), F.greatest(F.size(F.split("path", "/", -1)), F.lit(1)))
    return files.withColumn("_up", up).withColumn("_at", F.expr(f"cast({at} AS int)")) \
                .withColumn("ign_depth", F.when(F.col("_at") > 0, F.col("_at") + min_depth)).drop("_up", "_at")


LTRIM = "ltrim('./', {})"  # clean_relative as SQL text


def mark_ignored(listing: DataFrame, rules: DataFrame, *, walk: bool = True, min_depth: int = 0, most: int = LITERAL_RULES) -> DataFrame:
    """A listing (no content) with ``ign_file`` and ``ign_depth``, so that ignored files need not be read."""
    sets = literal_sets(rules, most)
    if sets is not None:
        return with_literal_decisions(listing, sets, walk=walk, min_depth=min_depth)
    found = ignore_decisions(listing, rules, walk=walk, min_depth=min_depth)
    return listing.join(found, ["share_id", "path"], "left").withColumn("ign_file", F.coalesce("ign_file", F.lit(False)))


def ignore_first(files: DataFrame, rules: DataFrame, *, walk: bool = True, min_depth: int = 0) -> tuple[DataFrame, DataFrame | None]:
    """Files with their ignore decisions where a projection gives them, so that ignored files are not decoded; otherwise the
    files and a narrow table of decisions, as rows with content are not joined."""
    sets = literal_sets(rules)
    if sets is not None:
        return with_literal_decisions(files, sets, walk=walk, min_depth=min_depth), None
    return files, ignore_decisions(files, rules, walk=walk, min_depth=min_depth)
