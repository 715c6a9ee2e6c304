"""The classifier: one pass over the files gives facts, settings and ignore decisions meet those narrow rows."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharegate import policy
from sharegate.functions import content as C
from sharegate.functions import paths as P
from sharegate.functions import pii as I
from sharegate.functions import text as T
from sharegate.functions.sql import quote
from sharegate.operators.ignore import ignore_decisions, ignore_first
from sharegate.operators.settings import DENY_TABLE, Effective, Wanted, common_settings, policy_row, run_list
from sharegate.policy import ShareSettings
from sharegate.session import materialize, stored_table

WALK, EXPLICIT = "filesystem walk", "explicit files"

def files_from_texts(texts: DataFrame) -> DataFrame:
    """Let any table with a string column enter as files; a NULL text is an unreadable file."""
    return texts.select(
        "share_id", "path", F.col("text").cast("binary").alias("content"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("length"),
        F.lit(None).cast("timestamp").alias("modified"), F.lit(None).cast("string").alias("read_error"))


def _inner_path(settings: ShareSettings) -> Column:
    """Path below the focus folder: directory rules start there."""
    focus = settings.focus.strip("/") if settings.focus else ""
    return F.expr(f"substring(path, {len(focus) + 2})") if focus else F.col("path")


def _list_prunes(settings: ShareSettings, folders: Column | None, prefixes: Column | None) -> list[Column]:
    """Prunes by lists of folder names (lower case) and path prefixes as struct(depth, ord, reason), NULL where none applies."""
    found = []
    if folders is not None:
        parts = F.split(F.lower(_inner_path(settings)), "/", -1)
        at = F.array_position(F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda d: F.array_contains(folders, d)), True)
        found.append(F.when(at > 0, F.struct((at + _focus_depth(settings)).cast("int").alias("depth"), F.lit(1).alias("ord"), F.lit("excluded-folder").alias("reason"))))
    if prefixes is not None:
        depths = F.transform(F.filter(prefixes, lambda p: P.under_prefix(F.col("path"), p)), lambda p: F.size(F.split(F.rtrim(p, F.lit("/")), "/", -1)))
        found.append(F.when(F.size(depths) > 0, F.struct(F.array_min(depths).cast("int").alias("depth"), F.lit(2).alias("ord"), F.lit("excluded-path").alias("reason"))))
    return found


def _focus_depth(settings: ShareSettings) -> int:
    return settings.focus.strip("/").count("/") + 1 if settings.focus else 0


def _dir_prunes(settings: ShareSettings) -> Column:
    """Shallowest silent directory prune that holds for the whole run as struct(depth, ord, reason), or NULL."""
    inner = _inner_path(settings)
    found = [F.when(F.col("_named") != "", F.struct(
        (P.dir_depth(inner, F.col("_named")) + _focus_depth(settings)).cast("int").alias("depth"), F.lit(0).alias("ord"),
        P.dir_rule("_named").alias("reason")))]
    prefixes = run_list(settings, "exclude_paths")
    if settings.output_prefix:
        own = F.array(F.lit(settings.output_prefix))
        prefixes = own if prefixes is None else F.concat(own, prefixes)
    found += _list_prunes(settings, run_list(settings, "exclude_folders", lower=True), prefixes)
    if settings.focus:
        found.append(F.when(~P.under_prefix(F.col("path"), F.lit(settings.focus)), F.struct(
            F.lit(0).alias("depth"), F.lit(3).alias("ord"), F.lit("outside-focus").alias("reason"))))
    return F.array_min(F.array(*found, F.lit(None).cast("struct<depth:int,ord:int,reason:string>")))


def _file_prune(settings: ShareSettings, walk: bool) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    if walk and settings.exclude_names:
        out = out.when(F.lower("base").isin([n.lower() for n in settings.exclude_names]), F.lit("excluded-name"))
    if walk and settings.exclude_exts:
        out = out.when(P.extension(F.col("base")).isin([e.lower() for e in settings.exclude_exts]), F.lit("excluded-extension"))
    return out


def content_scan(texts: DataFrame, share_mode: str = "public") -> DataFrame:
    """(share_id, path, rule, offset, match_len, all_rules) of texts a content rule holds back.

    The content stage alone, for tables that have no file semantics."""
    clean = texts.select("share_id", "path", T.strip_invisible("text").alias("text"))
    hits = C.with_hits(clean, "text", "hits", f"'{share_mode}' = 'public'").select(
        "share_id", "path", F.explode(F.array(F.struct("hits", F.array_min("hits").alias("top")))).alias("k"))
    return hits.where("k.top IS NOT NULL").selectExpr(
        "share_id", "path", f"{C.hit_rule('k.top.ord')} AS rule", "k.top.offset AS offset",
        "k.top.match_len AS match_len", f"{C.rule_set('k.hits')} AS all_rules")


_ROW_FIELDS = {"rule": "string", "desc": "string", "detail": "string", "family": "string", "offset": "int",
               "match_len": "int", "all_rules": "array<string>", "abs_path_len": "int"}


def _row(**values: str) -> str:
    """Exclusion row as SQL text; fields not named are NULL."""
    return "named_struct(" + ", ".join(
        f"'{name}', cast({values.get(name, 'NULL')} AS {kind})" for name, kind in _ROW_FIELDS.items()) + ")"


def _ops(rule: str, detail: str = "concat(size, ' bytes')", desc: str | None = None, **more: str) -> str:
    return _row(rule=quote(rule), desc=desc or quote(policy.OPS_RULES[rule]), detail=detail, family="'ops'", **more)


def _gate(settings: ShareSettings) -> str:
    """What a file is read as. Everything not listed before "text" is settled without a content scan."""
    most, window = settings.max_scan_bytes, settings.nul_window_bytes
    over = "false" if most is None else f"size > {most}"
    head = "content" if window is None else f"substring(content, 1, {window})"
    return f"""
    CASE WHEN NOT _live OR _path IS NOT NULL OR _hidden THEN 'settled'
         WHEN startswith(coalesce(read_error, ''), 'stat:') THEN 'stat'
         WHEN {over} AND NOT coalesce(_safe, false) THEN 'oversize'
         WHEN content IS NULL OR read_error IS NOT NULL OR path IS NULL THEN 'unreadable'
         WHEN {over} THEN 'binary-safe'
         WHEN NOT contains({head}, X'00') THEN 'text'
         WHEN _safe THEN 'binary-safe'
         ELSE 'binary' END"""


_VERDICT = f"""
    CASE WHEN _live AND _broken THEN {_ops("OPS-CONFIG", "'share settings'")}
         WHEN _path IS NOT NULL THEN {_row(rule="_path.rule", desc="_path.desc", family="'secret'",
                                           detail="concat('matched glob ', chr(39), _path.glob, chr(39))")}
         WHEN _gate = 'stat' THEN {_ops("OPS-STAT", "concat(substring(read_error, 6), if(length(path) > 255, "
                                                    "concat('; path is ', length(path), ' chars'), ''))",
                                        abs_path_len="length(path)")}
         WHEN _gate = 'oversize' THEN {_ops("OPS-OVERSIZE")}
         WHEN _gate = 'unreadable' THEN {_ops("OPS-UNREADABLE", desc="concat('cannot read file (', "
                                                                     "coalesce(read_error, 'no content'), ')')")}
         WHEN _gate = 'binary' THEN {_ops("OPS-BINARY")}
         WHEN _top IS NOT NULL THEN {_row(
             rule=C.hit_rule("_top.ord"), desc=C.hit_desc("_top.ord"), family=C.hit_family("_top.ord"),
             detail="concat('first match at byte ', _top.offset, ', length ', _top.match_len)",
             offset="_top.offset", match_len="_top.match_len", all_rules=C.rule_set("concat(_hits, _bhits)"))}
    END"""


# An override only lets through what has been read: a file nobody could look into stays withheld.
_READ = "content IS NOT NULL AND read_error IS NULL AND path IS NOT NULL"
_CLEAN = "_path IS NULL AND _gate IN ('text', 'binary-safe') AND array_min(_hits) IS NULL AND array_min(_bhits) IS NULL"


def facts(files: DataFrame, settings: ShareSettings, wanted: Wanted, *, walk: bool = True, keep_content: bool = False) -> DataFrame:
    """What a file's path and content say, whatever settings its share adds: one projection chain, no shuffle, no Python, no join.

    Every later stage is guarded by the earlier ones, so content is decoded only for files
    no path rule, prune, ignore decision or reading gate has settled. Hits keep their family and order, personal data its
    value's hash, so that ``settle`` can apply any settings to these narrow rows. The generator at the end keeps later
    filters from being pushed below it, which would run every pattern twice.

    ``keep_content`` leaves the content of files that may ship beside their facts.
    """
    known = "ign_depth" in files.columns  # decided on the listing
    allowed = F.lit(False) if not settings.allow else F.coalesce(F.array_contains(run_list(settings, "allow"), F.col("path")), F.lit(False))
    dropped = F.expr("ign_depth IS NOT NULL") if known and wanted.ignore else F.lit(False)
    hidden = F.expr("coalesce(ign_file, false)") & ~allowed if known and wanted.ignore and not wanted.late else F.lit(False)
    foreign = ~P.is_source_name(F.col("base")) if settings.source_only or wanted.late else F.lit(False)
    staged = (files
              .withColumns({"size": F.expr("coalesce(length, 0L)"), "base": P.basename(F.col("path")),
                            "_named": P.pruned_dir(_inner_path(settings)), "_hidden": hidden})
              .withColumns({"_dir": _dir_prunes(settings), "_file": _file_prune(settings, walk), "_foreign": foreign,
                            "_safe": P.suffix(F.col("base")).isin(policy.BINARY_SAFE_EXTS)})
              .withColumn("_live", F.expr("_dir IS NULL AND _file IS NULL") & ~dropped & (F.lit(wanted.late or not settings.source_only) | ~F.col("_foreign")))
              .withColumn("_path", F.when(F.col("_live"), P.path_rule("base", settings.deny_globs)))
              .withColumn("_gate", F.expr(_gate(settings)))
              .withColumns({"_text": F.when(F.expr("_gate = 'text'"), T.decode_text(F.col("content"))),
                            "_bin": F.expr("decode(if(_gate = 'binary-safe', content, NULL), 'ISO-8859-1')")})
              .withColumns({"_text": T.strip_invisible("_text"), "_bin": T.strip_invisible("_bin")}))
    read = C.with_hits(staged, "_text", "_hits", str(wanted.public).lower())
    read = C.with_hits(read, "_bin", "_bhits", secrets_only=True, relaxed=True)
    may_ship = F.expr(f"_live AND {_READ}") & (F.lit(wanted.late) | allowed | F.expr(_CLEAN))
    judged = read.withColumns({"_read": F.expr(_READ), "_ship": may_ship})
    none = "cast(NULL AS array<struct<offset:int,ord:int,match_len:int,value:string,author:boolean>>)"
    if wanted.pii != "false":
        judged = judged.withColumn("_pii_text", F.expr(f"if(_ship AND {wanted.pii} AND is_valid_utf8(cast(content AS string)), cast(content AS string), NULL)")) \
                       .withColumn("_pii", I.pii_facts("_pii_text"))
    else:
        judged = judged.withColumn("_pii", F.expr(none))
    kept = [c for c in ("ign_file", "ign_depth") if known]
    keep = F.struct("_dir", "_file", "_foreign", "_path", "_gate", F.filter("_hits", lambda h: h.isNotNull()).alias("_hits"),
                    F.filter("_bhits", lambda h: h.isNotNull()).alias("_bhits"), "_read", "_ship", "_pii", "read_error", *kept)
    out = judged.select("share_id", "path", "base", "content", "size", F.explode(F.array(keep)).alias("k"))
    own = ["if(k._ship, content, NULL) AS content"] if keep_content else []
    return out.selectExpr("share_id", "path", "base", "size", "k.*", "if(k._ship, sha2(content, 256), NULL) AS sha256", *own)


def settle(found: DataFrame, eff: Effective) -> DataFrame:
    """Facts under the settings of each row's share (``eff.attach``): rule, override and personal-data verdicts of narrow rows."""
    settings = eff.settings
    own = _list_prunes(settings, eff.own("exclude_folders", lower=True), eff.own("exclude_paths")) if eff.per_share else []
    rows = found.withColumns({"_broken": eff.broken, "_dir": F.array_min(F.array("_dir", *own)) if own else F.col("_dir"),
                              "_file": F.coalesce("_file", F.when(eff.value("source_only") & F.col("_foreign"), F.lit("source-only")))})
    if eff.per_share:
        rows = rows.withColumn("_path", P.share_path_rule("base", "_path", F.coalesce(F.col("_o.deny_table"), F.array().cast(DENY_TABLE))))
        rows = rows.withColumn("_hits", F.expr(f"filter(_hits, h -> {eff.public} OR h.ord < {C.N_SECRET})"))
    rows = (rows.withColumn("_live", F.expr("_dir IS NULL AND _file IS NULL"))
                .withColumn("_path", F.expr("if(_live, _path, NULL)"))
                .withColumn("_top", F.expr("coalesce(array_min(_hits), array_min(_bhits))"))
                .withColumns({"_row": F.expr(_VERDICT), "_allowed": eff.contains("allow", F.col("path")) & ~F.col("_broken") & F.col("_read")})
                .withColumn("_keep", F.expr("_live AND (_row IS NULL OR _allowed)")))
    allow = eff.array("pii_allow")
    listed = F.transform(allow, lambda v: F.sha2(v, 256)) if allow is not None else F.array().cast("array<string>")
    rows = rows.withColumns({"_skip": eff.value("pii_skip_author"), "_listed": F.coalesce(listed, F.array().cast("array<string>"))}) \
               .withColumn("_found", F.when(F.col("_keep") & eff.value("pii"), F.expr("filter(_pii, h -> NOT array_contains(_listed, h.value) AND NOT (_skip AND h.author))")))
    pii = F.struct(F.expr("_found IS NOT NULL AS scanned"), F.expr("coalesce(size(_found), 0) AS n"), I.pii_rule("get(_found, 0).ord").alias("rule"))
    named = [c for c in ("ign_file", "ign_depth", "policy", "content") if c in found.columns]
    return rows.select("share_id", "path", "size", "_dir", "_file", "_row", "_allowed", "_keep", pii.alias("_pii"), eff.value("respect_ignore").alias("_ignore"),
                       F.expr("if(_keep, sha256, NULL)").alias("sha256"), *named)


def scan(files: DataFrame, eff: Effective, *, walk: bool = True) -> DataFrame:
    """Facts and verdicts under the settings of the run."""
    return settle(facts(files, eff.settings, Wanted.of(eff.settings), walk=walk), eff)


_REASON = """
    CASE WHEN _dir IS NOT NULL AND (depth IS NULL OR _dir.depth <= depth) THEN _dir.reason
         WHEN depth IS NOT NULL THEN 'ignored-dir'
         ELSE _file END"""


def decide(scanned: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    """One decision row per file from the scan and the ignore decisions.

    Precedence: directory prune, ignored directory, file filter, ignored file, rule,
    then the allow override, then personal data. Unknown never becomes included."""
    if ignored is not None:
        scanned = scanned.join(ignored, ["share_id", "path"], "left")
    elif "ign_depth" not in scanned.columns:
        scanned = scanned.selectExpr("*", "false AS ign_file", "cast(NULL AS int) AS ign_depth")
    ignored_row = _ops("OPS-GITIGNORE", "'matched ignore file'")
    pii_row = _row(rule="_pii.rule", desc=quote(policy.PII_DESC), family="'pii'",
                   detail="concat(_pii.n, ' PII match(es)')")
    out = (scanned
           .selectExpr("*", "if(_ignore, ign_depth, NULL) AS depth", "_ignore AND coalesce(ign_file, false) AS hidden")
           .selectExpr("*", f"{_REASON} AS prune_reason", f"if(hidden, {ignored_row}, _row) AS _first")
           .selectExpr("*", "if(prune_reason IS NULL AND _allowed, _first.rule, NULL) AS override_rule")
           .selectExpr("*", f"CASE WHEN _first IS NOT NULL AND override_rule IS NULL THEN _first "
                            f"WHEN _pii.n > 0 THEN {pii_row} END AS _final")
           .selectExpr("*", "CASE WHEN prune_reason IS NOT NULL THEN 'pruned' WHEN _final IS NOT NULL "
                            "THEN 'excluded' ELSE 'included' END AS status"))
    fields = [f"if(status = 'excluded', _final.{f}, NULL) AS {f}" for f in _ROW_FIELDS]
    named = ["policy"] if "policy" in out.columns else []
    return out.selectExpr(
        *named, "share_id", "path", "status", *fields, "override_rule", "_pii.n AS pii_matches", "_pii.scanned AS pii_scanned",
        "size", "if(status = 'included', sha256, NULL) AS sha256", "prune_reason",
        "if(prune_reason = 'ignored-dir', depth, NULL) AS ign_depth")


@dataclass(frozen=True)
class Classified:
    """Result tables of one classification; all of them are views on ``decisions``. ``kept`` (of ``classify(store=True)``) is the
    content that was scanned, ``(share_id, path, sha256, content)``."""

    decisions: DataFrame
    settings: ShareSettings
    selection: str = WALK
    overrides: DataFrame | None = None
    kept: DataFrame | None = None

    @property
    def objects(self) -> DataFrame:
        """(sha256, content): each content that is included, once. One file stands for all with its hash; it is chosen
        among narrow rows, so a content that very many files have is no task's burden."""
        one = self.included.groupBy("sha256").agg(F.min(F.struct("share_id", "path")).alias("k")).select("k.*")
        return self.kept.join(one, ["share_id", "path"], "left_semi").select("sha256", "content")

    @property
    def included(self) -> DataFrame:
        return self.decisions.where("status = 'included'").select("share_id", "path", "size", "sha256", "override_rule")

    @property
    def exclusions(self) -> DataFrame:
        """Excluded files, plus one row per ignored directory (its files are not listed)."""
        fields = ["share_id", "path", "rule", "desc", "detail", "family", "offset", "match_len", "all_rules", "abs_path_len"]
        files = self.decisions.where("status = 'excluded'").select(*fields)
        dirs = (self.decisions.where(F.col("ign_depth").isNotNull())
                .select("share_id", F.expr("substring_index(path, '/', ign_depth)").alias("path")).distinct()
                .withColumn("rule", F.lit("OPS-GITIGNORE")).withColumn("desc", F.lit(policy.OPS_RULES["OPS-GITIGNORE"]))
                .withColumn("detail", F.lit("matched ignore file")).withColumn("family", F.lit("ops")))
        return files.unionByName(dirs, allowMissingColumns=True)

    @property
    def pruned(self) -> DataFrame:
        return self.decisions.where("status = 'pruned'").select("share_id", "path", F.col("prune_reason").alias("reason"))

    @property
    def override_log(self) -> DataFrame:
        """Allow overrides that fired; a file withheld later for personal data stays logged."""
        return self.decisions.where(F.col("override_rule").isNotNull()) \
                   .select("share_id", "path", F.col("override_rule").alias("overrode_rule"))

    @property
    def decision_map(self) -> DataFrame:
        """path -> INCLUDE or the rule, for every file that was not pruned."""
        return self.decisions.where("status <> 'pruned'") \
                   .select("share_id", "path", F.coalesce("rule", F.lit("INCLUDE")).alias("decision"))

    def materialized(self) -> Classified:
        """Decisions written once (rules and hashes, no content), for several outputs."""
        return replace(self, decisions=materialize(self.decisions))


def classify(files: DataFrame, settings: ShareSettings = ShareSettings(), *, overrides: DataFrame | None = None,
             ignore_rules: DataFrame | None = None, selection: str = WALK, store: bool = False) -> Classified:
    """Decide each file of ``files(share_id, path, content, length, modified, read_error)``.

    Content is read by one scan; settings that shares add meet its narrow facts afterwards. Files may come with ``ign_file``
    and ``ign_depth`` (see ``ignore.mark_ignored``), decided on their listing.

    With ``store`` that scan writes the content that may ship beside its facts, and everything later reads this table:
    the source is read once, and what ships are the very bytes that were scanned, whatever happens to the files meanwhile."""
    walk = selection == WALK
    eff = Effective(settings, per_share=overrides is not None)
    ignored = None
    if ignore_rules is not None and settings.respect_ignore and "ign_depth" not in files.columns:
        files, ignored = ignore_first(files, ignore_rules, walk=walk, min_depth=_focus_depth(settings))
    found, kept = facts(files, settings, Wanted.of(settings, overrides), walk=walk, keep_content=store), None
    if store:
        found = stored_table(found)
        kept, found = found.where("content IS NOT NULL").select("share_id", "path", "sha256", "content"), found.drop("content")
        if ignored is not None:  # from the written paths, as the files are not to be read again
            ignored = ignore_decisions(found, ignore_rules, walk=walk, min_depth=_focus_depth(settings))
    return Classified(decide(settle(eff.attach(found, overrides), eff), ignored), settings, selection, overrides, kept)


def classify_many(files: DataFrame, policies: dict[str, ShareSettings], *, selection: str = WALK) -> DataFrame:
    """Decisions of every file under each of several policies, with their ``policy`` name, from one scan.

    A policy is to the facts what the settings of a share are: a row of values. Each row of facts is settled once per policy, so
    the rows grow with the number of policies and the reading does not. Policies agree on ``settings.RUN_FIELDS``."""
    common = common_settings(list(policies.values()))
    found = facts(files, common, Wanted.by_any(list(policies.values())), walk=selection == WALK)
    rows = F.array(*[F.struct(F.lit(name).alias("policy"), policy_row(p).alias("_o")) for name, p in policies.items()])
    each = found.withColumn("_each", F.explode(rows)).select("*", "_each.policy", F.col("_each._o").alias("_o")).drop("_each")
    return decide(settle(each, Effective(common, per_share=True)))


def policy_diff(files: DataFrame, a: ShareSettings, b: ShareSettings) -> DataFrame:
    """(share_id, path, decision_a, decision_b) where two policies differ; a policy that prunes the file shows NULL. Content is scanned once."""
    d = classify_many(files, {"a": a, "b": b})
    decision = F.when(F.col("status") != "pruned", F.coalesce("rule", F.lit("INCLUDE")))
    sides = d.groupBy("share_id", "path").agg(*[F.max(F.when(F.col("policy") == p, decision)).alias(f"decision_{p}") for p in "ab"])
    return sides.where(~F.col("decision_a").eqNullSafe(F.col("decision_b")))
