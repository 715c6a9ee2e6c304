"""What a share leaves behind: manifest, hashes, shards, checksums, report, ledger."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharegate import policy
from sharegate.functions.paths import basename, extension
from sharegate.functions.sql import quote
from sharegate.functions.text import decode_replace, render_block
from sharegate.operators import audit
from sharegate.operators.classify import Classified
from sharegate.operators.joins import lookup_join
from sharegate.operators.ordered import greedy_bins, ordered_sha256
from sharegate.operators.settings import complete_overrides, one_per_share
from sharegate.policy import ShareSettings, policy_fingerprint
from sharegate.session import materialize, stored_table

EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
SHARD_DIR = "_MERGED/"


def manifest_files(included: DataFrame) -> DataFrame:
    return included.select("share_id", "path", "size", "sha256")


def _hash_or_error() -> Column:
    return F.coalesce("sha256", F.raise_error(F.concat(F.lit("included file without a hash: "), "path")).cast("string"))


def content_hash(files: DataFrame) -> DataFrame:
    """(share_id, content_sha256) over the sorted (path, file hash) list of each share. A file without a hash is an error.

    One stream of one hash, which one task reads in the end: the option for consumers that know this value."""
    line = F.concat("path", F.lit("\u0000"), _hash_or_error(), F.lit("\n"))
    return ordered_sha256(files, "share_id", ["path"], line, "content_sha256")


def _leaf(path: str = "path") -> Column:
    """Name of the leaf that a path belongs to: four hexadecimal digits of its SHA-256."""
    return F.substring(F.sha2(path, 256), 1, 4)


def _level(df: DataFrame, keys: list[str], out: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), ""), 256).alias(out))


def hash_leaves(files: DataFrame) -> DataFrame:
    """(share_id, leaf, h): the hash tree of each share, as its 65,536 leaves. A leaf's hash is that of its sorted
    (path, file hash) lines. Leaves are fixed by the path, so no value depends on partitions. A file without a hash is an error."""
    line = F.concat("path", F.lit("\u0000"), _hash_or_error(), F.lit("\n"))
    return _level(files.select("share_id", _leaf().alias("leaf"), line.alias("line")), ["share_id", "leaf"], "h")


def hash_branches(leaves: DataFrame) -> DataFrame:
    """(share_id, branch, h): a branch (two digits) has the hash of its sorted leaf lines."""
    return _level(leaves.select("share_id", F.substring("leaf", 1, 2).alias("branch"), F.concat("leaf", F.lit(" "), "h", F.lit("\n")).alias("line")), ["share_id", "branch"], "h")


def hash_roots(branches: DataFrame) -> DataFrame:
    return _level(branches.select("share_id", F.concat("branch", F.lit(" "), "h", F.lit("\n")).alias("line")), ["share_id"], "content_sha256")


def content_hash_tree(files: DataFrame) -> DataFrame:
    """(share_id, content_sha256): the root of each share's hash tree. No task reads a share."""
    return hash_roots(hash_branches(hash_leaves(files)))


def _differing(a: DataFrame, b: DataFrame, keys: list[str], value: str = "h") -> DataFrame:
    """Keys whose hash differs or that one side lacks."""
    both = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys, "full_outer")
    return both.where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*keys)


def changed_leaves(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """(share_id, leaf) in which two trees (``hash_leaves``) differ: down from the roots, only what differs is opened."""
    a, b = hash_branches(recorded), hash_branches(found)
    shares = _differing(hash_roots(a), hash_roots(b), ["share_id"], "content_sha256")
    branches = _differing(*(x.join(shares, "share_id", "left_semi") for x in (a, b)), ["share_id", "branch"])
    opened = [x.withColumn("branch", F.substring("leaf", 1, 2)).join(branches, ["share_id", "branch"], "left_semi") for x in (recorded, found)]
    return _differing(*opened, ["share_id", "leaf"])


def changed_paths(listed: DataFrame, delivered: DataFrame, recorded: DataFrame | None = None) -> DataFrame:
    """(share_id, path, status): files that are MISSING, CORRUPT or UNLISTED among ``delivered(share_id, path, sha256)``, found by
    descending both hash trees; ``recorded`` is the stored tree of ``listed``. Entries of leaves that agree are compared with nothing."""
    found = materialize(hash_leaves(delivered))
    leaves = materialize(changed_leaves(materialize(hash_leaves(listed)) if recorded is None else recorded, found))
    near = [x.withColumn("leaf", _leaf()).join(leaves, ["share_id", "leaf"], "left_semi").select("share_id", "path", "sha256") for x in (listed, delivered)]
    return audit.verify_objects(*near).where("status <> 'OK'")


def manifest_header(result: Classified, *, generated_utc: str, source_root: str = "",
                    shards: DataFrame | None = None, hashing: str = "tree") -> DataFrame:
    """One row per share with counts, content hash and the policy that applied. ``hash_kind`` says how the content hash is
    made: the root of a tree, or (``hashing="stream"``) one hash over the whole list, which one task reads.

    Shares whose files were all withheld still get a row. A directory that is ignored counts once among the excluded."""
    decisions, settings = result.decisions, result.settings
    hashed = {"tree": content_hash_tree, "stream": content_hash}[hashing](result.included)
    # an ignored directory is counted at its first file: partial sums per (share, directory), then per share
    folder = F.when(F.col("ign_depth").isNotNull(), F.expr("substring_index(path, '/', ign_depth)"))
    once = decisions.groupBy("share_id", folder.alias("_dir")).agg(
        F.count_if(F.col("status") == "included").alias("i"), F.sum(F.when(F.col("status") == "included", F.col("size"))).alias("b"),
        F.count_if(F.col("status") == "excluded").alias("x"))
    counts = once.groupBy("share_id").agg(F.sum("i").alias("file_count"), F.coalesce(F.sum("b"), F.lit(0)).alias("total_bytes"),
                                          (F.sum("x") + F.count("_dir")).alias("excluded_count"))
    out = (counts.join(hashed, "share_id", "left")
           .select("share_id", "file_count", "total_bytes", "excluded_count", F.lit(hashing).alias("hash_kind"),
                   F.coalesce("content_sha256", F.lit(EMPTY_SHA256)).alias("content_sha256")))
    if shards is not None:
        n = shards.groupBy("share_id").agg(F.count(F.lit(1)).alias("shard_count"))
        out = out.join(n, "share_id", "left").withColumn("shard_count", F.coalesce("shard_count", F.lit(0)))
    mode, fingerprint, chars = F.lit(settings.share_mode), F.lit(policy_fingerprint(settings)), F.lit(settings.max_chars)
    if result.overrides is not None:
        # a share with settings of its own is recorded with its mode and a fingerprint over both
        rows = one_per_share(complete_overrides(result.overrides))
        own = rows.select("share_id", F.col("share_mode").alias("_mode"), F.col("max_chars").alias("_chars"), F.to_json(F.struct(*sorted(c for c in rows.columns if c != "share_id"))).alias("_own"))
        out = out.join(own, "share_id", "left")
        mode, chars = F.coalesce("_mode", mode), F.coalesce("_chars", chars)
        fingerprint = F.when(F.col("_own").isNull(), fingerprint).otherwise(F.sha2(F.concat(fingerprint, "_own"), 256))
    return (out.withColumn("schema", F.lit("sharegate.manifest/v1"))
               .withColumn("generated_utc", F.lit(generated_utc)).withColumn("share_mode", mode)
               .withColumn("policy_version", F.lit(policy.POLICY_VERSION))
               .withColumn("policy_sha256", fingerprint).withColumn("max_chars", chars.cast("long")).drop("_mode", "_own", "_chars")
               .withColumn("source_root", F.lit(source_root)).withColumn("focus", F.lit(settings.focus))
               .withColumn("selection", F.lit(result.selection)))


# -- merged shards ---------------------------------------------------------------

def _blocks(files: DataFrame) -> DataFrame:
    return (files.withColumns({"_ext": extension(basename(F.col("path"))), "_text": decode_replace(F.col("content"))})
                 .withColumn("block", F.expr(render_block("path", "_ext", "_text"))).drop("_ext", "_text"))


def shard_assignment(files: DataFrame, included: DataFrame, max_chars: int = policy.MAX_SHARD_CHARS, overrides: DataFrame | None = None) -> DataFrame:
    """(share_id, path, size, n, bin): the shard each included file goes to. A share's own ``max_chars`` in ``overrides`` goes before the run's.

    Only block lengths travel; the text is rendered again when shards are written. A block
    longer than ``max_chars`` gets a shard of its own."""
    lengths = _blocks(files.select("share_id", "path", "content")) \
        .select("share_id", "path", F.length("block").cast("long").alias("n"))
    sized = included.select("share_id", "path", "size").join(lengths, ["share_id", "path"])
    if overrides is None:
        return greedy_bins(sized, "share_id", max_chars)
    own = one_per_share(complete_overrides(overrides)).select("share_id", F.col("max_chars").alias("_own"))
    limited = lookup_join(sized, own, ["share_id"]).withColumn("_most", F.coalesce("_own", F.lit(max_chars)))
    return greedy_bins(limited, "share_id", "_most")


def merged_shards(files: DataFrame, assignment: DataFrame, prefix: str = "") -> DataFrame:
    """(share_id, shard_no, name, text, chars, sha256) from a checkpointed assignment.

    A shard holds at most ``max_chars`` characters (or one block), whatever the share."""
    width = assignment.groupBy("share_id").agg(F.max("bin").alias("shards"))
    parts = _blocks(files.select("share_id", "path", "content").join(assignment.select("share_id", "path", "size", "bin"), ["share_id", "path"]))
    ordered = F.array_sort(F.collect_list(F.struct("size", "path", "block")))
    text = F.array_join(F.transform(ordered, lambda b: b["block"]), "")
    number = F.expr("lpad(cast(shard_no AS string), greatest(2, length(cast(shards AS string)), "
                    "length(cast(shard_no AS string))), '0')")
    return (parts.groupBy("share_id", F.col("bin").alias("shard_no")).agg(text.alias("text"))
                 .join(width, "share_id")
                 .select("share_id", "shard_no",
                         F.concat(F.lit(f"{SHARD_DIR}{prefix}source_code_part"), number, F.lit(".txt")).alias("name"),
                         "text", F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("sha256")))


# -- text outputs, one row per line ----------------------------------------------

def checksum_lines(files: DataFrame, shards: DataFrame | None = None) -> DataFrame:
    """(share_id, part, path, line): files first, then shards, in path order."""
    line = F.concat_ws("  ", "sha256", "path").alias("line")
    out = files.select("share_id", F.lit(0).alias("part"), "path", line)
    if shards is not None:
        out = out.unionByName(shards.select("share_id", F.lit(1).alias("part"), F.col("name").alias("path"), "sha256")
                              .select("share_id", "part", "path", line))
    return out


def _line(part: int, order: str, text: str) -> str:
    return f"named_struct('part', {part}, 'ord', cast({order} AS string), 'line', {text})"


def share_report(header: DataFrame, exclusions: DataFrame, settings: ShareSettings) -> DataFrame:
    """(share_id, part, ord, line): the report in markdown, one row per line.

    Sorting by (part, ord) gives the document. Excluded files are rows and are never
    gathered, so a share may have any number of them."""
    most = "max_chars" if "max_chars" in header.columns else str(settings.max_chars)
    shards = f"concat('**Merged: ', shard_count, ' shard(s) @ ', format_number({most}, 0), ' chars**')"
    head = [
        "concat('# Share report - ', upper(share_mode))", "''", "concat('- Generated: ', generated_utc)",
        "concat('- Source root: `', source_root, '`')", "concat('- Focus: `', coalesce(focus, '(none)'), '`')",
        "concat('- Selection: ', selection)",
        "concat('- Policy: ', policy_version, ' (`', left(policy_sha256, 16), '...`)')",
        "concat('- Content SHA256: `', content_sha256, '`')", "''",
        "concat('**Included: ', file_count, ' files, ', format_string('%.1f', total_bytes / 1024), ' KiB**  ')",
        "concat('**Excluded: ', excluded_count, ' files**')",
        shards if "shard_count" in header.columns else "'**Merged: disabled**'", "''", "'## Exclusions by rule'", "''",
        "'| Rule | Count | Meaning |'", "'|---|---:|---|'",
    ]
    tail = ["''", "'## Verification'", "''",
            "'Recompute the SHA-256 of every delivered object and compare it with the checksum lines.'"]
    rows = [_line(0, f"lpad({i}, 4, '0')", t) for i, t in enumerate(head)]
    rows += [_line(1, "''", "if(excluded_count = 0, '| - | 0 | nothing excluded |', NULL)"),
             _line(2, "'0'", "''"), _line(2, "'1'", "'## Excluded files'"), _line(2, "'2'", "''"),
             _line(3, "''", "if(excluded_count = 0, '_none_', NULL)")]
    rows += [_line(4, f"lpad({i}, 4, '0')", t) for i, t in enumerate(tail)]
    fixed = header.select("share_id", F.expr(f"inline(array({', '.join(rows)}))")).where("line IS NOT NULL")
    names = ", ".join(f"{quote(r)}, {quote(d)}" for r, d in policy.rule_descriptions().items())
    counts = audit.rule_counts(exclusions).selectExpr(
        "share_id", "1 AS part", "rule AS ord",
        f"concat('| `', rule, '` | ', n, ' | ', coalesce(element_at(map({names}), rule), ''), ' |') AS line")
    files = exclusions.selectExpr(
        "share_id", "3 AS part", "path AS ord",
        "concat('- `', path, '` - **', rule, '** (', desc, '); ', detail) AS line")
    return fixed.unionByName(counts).unionByName(files)


# -- names and times ---------------------------------------------------------------

def generated_utc(epoch: int | str | None = None) -> str:
    """The time that a run records: now, or a pinned number of seconds, so that a repeated run gives the same artifacts."""
    at = dt.datetime.now(dt.timezone.utc) if epoch is None else dt.datetime.fromtimestamp(int(epoch), dt.timezone.utc)
    return at.isoformat()


def share_name(template: str = "{prefix}{stamp}_share_{mode}", prefix: str = "", suffix: str = ".zip") -> Column:
    """Name of each share's archive from its header row. ``{stamp}`` is the time in UTC as yyyymmddThhmmssZ, ``{mode}`` the share
    mode, ``{focus}`` the focus folder with underscores."""
    stamp = F.date_format(F.to_timestamp("generated_utc"), "yyyyMMdd'T'HHmmss'Z'")
    focus = F.btrim(F.replace(F.coalesce("focus", F.lit("")), F.lit("/"), F.lit("_")), F.lit("_"))
    name = F.lit(template)
    for mark, value in (("{prefix}", F.lit(prefix)), ("{stamp}", stamp), ("{mode}", F.col("share_mode")), ("{focus}", focus)):
        name = F.replace(name, F.lit(mark), value)
    return F.concat(name, F.lit(suffix))


def policy_documents(header: DataFrame) -> DataFrame:
    """(share_id, body): the policy each share went out under, as JSON: its mode, version, fingerprint and the rules that applied. Rules on local
    infrastructure do not apply to a private share."""
    fields = ("rule_id", "family", "kind", "pattern", "desc")
    rules = [dict(zip(("rule_id", "family", "ord", "kind", "pattern", "desc", "token"), row, strict=True)) for row in policy.rule_rows()]
    rows = ", ".join("named_struct(" + ", ".join(f"'{f}', {quote(r[f])}" for f in fields) + ")" for r in rules)
    applied = F.expr(f"filter(array({rows}), r -> share_mode <> 'private' OR r.family <> 'local')").alias("rules")
    names = [c for c in ("generated_utc", "share_mode", "policy_version", "policy_sha256", "max_chars", "focus", "selection") if c in header.columns]
    return header.select("share_id", F.to_json(F.struct(*names, applied)).alias("body"))


# -- ledger --------------------------------------------------------------------------

def share_events(header: DataFrame, exclusions: DataFrame, *, archive: str = "", archive_bytes: int | None = None,
                 max_chars: int | None = None) -> DataFrame:
    """One ``share`` event per share. The excluded paths and the overrides are the exclusion and override tables of the same
    share and time, not arrays inside the event."""
    for name in ("shard_count", "raw_files_included", "max_chars"):
        if name not in header.columns:
            header = header.withColumn(name, F.lit(None).cast("boolean" if name == "raw_files_included" else "long"))
    return (header.join(audit.rule_tally(exclusions), "share_id", "left")
            .select(F.lit("share").alias("event"), F.col("generated_utc").alias("timestamp_utc"), "share_id",
                    F.lit(archive).alias("archive"), F.lit(archive_bytes).cast("long").alias("archive_bytes"),
                    "content_sha256", *(["hash_kind"] if "hash_kind" in header.columns else []), "share_mode", "policy_version", "policy_sha256", "source_root", "focus",
                    "selection", F.col("file_count").alias("included_count"), F.col("total_bytes").alias("included_bytes"),
                    "excluded_count", F.col("shard_count").alias("merged_shards"), (F.lit(None) if max_chars is None else F.coalesce("max_chars", F.lit(max_chars))).cast("long").alias("merged_max_chars"),
                    "raw_files_included", F.coalesce("excluded_by_rule", F.expr("cast(map() AS map<string,bigint>)")).alias("excluded_by_rule")))


def ledger_rollup(ledger: DataFrame, bucket: str = "day") -> DataFrame:
    """What went out or was held, when, by rule: counts summed per time bucket and rule."""
    return (ledger.select("share_id", F.date_trunc(bucket, F.to_timestamp("timestamp_utc")).alias("bucket"),
                          F.explode("excluded_by_rule").alias("rule", "n"))
                  .groupBy("bucket", "rule").agg(F.sum("n").alias("n_excluded"), F.count(F.lit(1)).alias("n_events")))


# -- everything -------------------------------------------------------------------------

def pack(files: DataFrame | None, result: Classified, *, generated_utc: str, source_root: str = "", merge: bool = True,
         include_raw: bool = True, prefix: str = "", tracked: DataFrame | None = None) -> dict[str, DataFrame]:
    """All result tables of a share run. Decisions (no content) are written once and reused.

    A result with stored content (``classify(store=True)``) needs no ``files``, which are then not read again: ``objects`` holds each
    distinct content once, ``files`` refers to it by hash, and shards are made of the stored bytes. Otherwise ``files`` is read
    again and must not have changed since it was classified."""
    result = result.materialized()
    files = files if result.kept is None else result.kept
    settings, out = result.settings, {}
    shards = None
    if merge:
        assignment = materialize(shard_assignment(files, result.included, settings.max_chars, result.overrides))
        out["shards"] = stored_table(merged_shards(files, assignment, prefix))  # made once; what only needs names and hashes reads no text
        shards = out["shards"].drop("text")
    header = manifest_header(result, generated_utc=generated_utc, source_root=source_root, shards=shards)
    header = materialize(header.withColumn("raw_files_included", F.lit(include_raw)))
    if include_raw and result.kept is not None:
        out["objects"], out["files"] = result.objects, manifest_files(result.included)
    elif include_raw:
        out["files"] = files.select("share_id", "path", "content") \
            .join(result.included.select("share_id", "path"), ["share_id", "path"], "left_semi")
    if tracked is not None:
        out["tracked_not_shipped"] = audit.tracked_not_shipped(tracked, result.included)
        out["shipped_not_tracked"] = audit.shipped_not_tracked(tracked, result.included)
    return out | {
        "manifest_files": manifest_files(result.included), "manifest_header": header,
        "exclusions": result.exclusions, "pruned": result.pruned, "overrides": result.override_log,
        "checksums": checksum_lines(manifest_files(result.included), shards),
        "report": share_report(header, result.exclusions, settings), "policy": policy_documents(header),
        "events": share_events(header, result.exclusions, max_chars=settings.max_chars if merge else None),
    }
