"""Registered queries: one per operator family, each over whole driver tables."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sharegate.functions.pii import redact_pii
from sharegate.operators import artifacts, audit, retention
from sharegate.operators.classify import Classified, classify, content_scan, files_from_texts, policy_diff
from sharegate.operators.ignore import gather_ignore_rules
from sharegate.operators.personal_data import pii_counts, pii_hits
from sharegate.operators.quick_scan import quick_scan, quick_verdict, texts_of
from sharegate.operators.structure import folder_summary, structural_filter
from sharegate.plans import corpus as K
from sharegate.policy import ShareSettings, policy_fingerprint
from sharegate.sources.sinks import append_ledger
from sharegate.sources.tables import overrides_from_json, select_files
from sharegate.session import ensure_checkpoint_dir, is_folder, materialize, ship_package
from sharegate.streaming.gate import gate_stream, late_rows, route, rule_rollup

NOW_UTC = "2024-02-01T00:00:00Z"
RETENTION_NOW, RETENTION_DAYS, RETENTION_MB = "1998-08-03 00:00:00", 2000, 256
SHARD_CHARS = 20_000
HOURS = 1 << 26  # up to the year 9625
TEXTS = ShareSettings(max_scan_bytes=None)  # a long document is scanned, not withheld


def _files(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    return files_from_texts(K.load(spark, sf, sql))


def _flat(spark, sf, settings: ShareSettings = TEXTS) -> Classified:
    return classify(_files(spark, sf, K.FLAT), settings)


# -- content rules -----------------------------------------------------------

def content_exclusions_by_rule(spark, sf):
    return audit.rule_counts(content_scan(K.load(spark, sf, K.FLAT)))


def content_first_hit(spark, sf):
    hits = content_scan(K.load(spark, sf, K.FLAT))
    return hits.withColumn("all_rules", F.array_join("all_rules", ","))


def content_scan_pages(spark, sf):
    pages = K.load(spark, sf, f"SELECT share_id, cast(page_id AS string) AS path, html AS text FROM ({K.PAGES})", "pages")
    return pages.join(content_scan(pages).select("share_id", "path", "rule"), ["share_id", "path"], "left") \
                .groupBy(F.coalesce("rule", F.lit("INCLUDE")).alias("decision")).agg(F.count(F.lit(1)).alias("n"))


def share_mode_diff(spark, sf):
    return policy_diff(_files(spark, sf, K.FLAT), TEXTS, ShareSettings(share_mode="private", max_scan_bytes=None))


# -- paths, precedence, overrides --------------------------------------------

def path_rule_decisions(spark, sf):
    d = classify(_files(spark, sf, K.TREE), TEXTS).decisions
    return d.select("share_id", "path", "status", "rule", "prune_reason", "family", "detail")


def decision_map(spark, sf):
    return _flat(spark, sf).decision_map


def source_only_and_filters(spark, sf):
    settings = ShareSettings(max_scan_bytes=None, source_only=True, exclude_folders=("SRC",), exclude_exts=(".sql",),
                             exclude_paths=("docs/Build/",), deny_globs=("doc_*7.md",), focus=None)
    d = classify(_files(spark, sf, K.TREE), settings).decisions
    return d.select("share_id", "path", "status", "rule", "prune_reason")


def gate_verdict(spark, sf):
    return audit.gate_verdict(_flat(spark, sf).decision_map)


def _overrides(spark, sf) -> DataFrame:
    """One settings row per source: each allows its own oldest key file and denies by name."""
    return K.load(spark, sf, f"""
        SELECT share_id, array(min(path)) AS allow, array('DOC_*9.md') AS deny_globs,
               if(min(doc_id) % 2 = 0, 'public', 'private') AS share_mode
        FROM ({K.FLAT}) WHERE path LIKE '%/id_rsa' GROUP BY share_id""")


def allow_override_log(spark, sf):
    rows = _overrides(spark, sf)
    return classify(_files(spark, sf, K.FLAT), TEXTS, overrides=rows).override_log


def per_share_overrides(spark, sf):
    return classify(_files(spark, sf, K.FLAT), TEXTS, overrides=_overrides(spark, sf)).decision_map


def ignore_decisions(spark, sf):
    files = _files(spark, sf, K.TREE_WITH_IGNORES)
    return _with_ignored_dirs(classify(files, TEXTS, ignore_rules=gather_ignore_rules(files)))


def _with_ignored_dirs(result: Classified) -> DataFrame:
    """Every decision, and one row per ignored directory; from one scan."""
    own = F.struct("path", F.coalesce("rule", "prune_reason", F.lit("INCLUDE")).alias("decision"))
    folder = F.when(F.col("ign_depth").isNotNull(), F.struct(F.expr("substring_index(path, '/', ign_depth)").alias("path"), F.lit("OPS-GITIGNORE").alias("decision")))
    rows = result.decisions.select("share_id", F.explode(F.array_compact(F.array(own, folder))).alias("k"))
    return rows.select("share_id", "k.*").distinct()


def ignore_extra_names(spark, sf):
    """Every share has two ignore files; the settings of even shares name the second one too."""
    docs = K.load(spark, sf, K.TWO_IGNORES)
    settings = docs.where("share_no % 2 = 0").select("share_id").distinct().select("share_id", F.lit('{"ignore_files": [".shareignore"]}').alias("json"))
    rows, files = overrides_from_json(settings), files_from_texts(docs)
    return _with_ignored_dirs(classify(files, TEXTS, overrides=rows, ignore_rules=gather_ignore_rules(files, TEXTS.ignore_files, rows)))


# -- personal data -------------------------------------------------------------

def pii_hits_by_doc(spark, sf):
    return pii_hits(K.table(spark, sf, "documents").select("doc_id", "text"), "text")


def pii_by_lang(spark, sf):
    return pii_counts(K.table(spark, sf, "documents"), "text", ["lang"])


def pii_by_label(spark, sf):
    docs = K.table(spark, sf, "documents").select("doc_id", "text")
    counts = pii_counts(docs, "text", ["doc_id"])  # labels meet a few counts, not the texts
    return (K.table(spark, sf, "labels").join(counts, "doc_id")
            .groupBy("quality", "toxic", "rule").agg(F.sum("n_matches").alias("n_matches"), F.count(F.lit(1)).alias("n_docs")))


def pii_pages(spark, sf):
    return pii_counts(K.table(spark, sf, "pages"), "html", ["page_id"])


def pii_authors(spark, sf):
    return pii_hits(K.load(spark, sf, K.AUTHORS).select("doc_id", "text"), "text", allow=("press@example.com",))


def pii_gate(spark, sf):
    settings = ShareSettings(pii=True, pii_allow=("press@example.com",), max_scan_bytes=None)
    d = classify(_files(spark, sf, K.AUTHORS), settings).decisions
    return d.select("share_id", "path", "status", "rule", "detail", F.col("pii_matches").cast("long").alias("pii_matches"))


def redacted_documents(spark, sf):
    docs = K.table(spark, sf, "documents").select("doc_id", redact_pii("text").alias("text"))
    return docs.select("doc_id", F.sha2("text", 256).alias("sha256"), F.length("text").cast("long").alias("chars"))


def redacted_authors(spark, sf):
    docs = K.load(spark, sf, K.AUTHORS).select("doc_id", redact_pii("text", ("press@example.com",)).alias("text"))
    return docs.select("doc_id", F.sha2("text", 256).alias("sha256"))


# -- manifests and audit ---------------------------------------------------------

def manifest_files(spark, sf):
    return artifacts.manifest_files(_flat(spark, sf).included)


def manifest_header(spark, sf):
    header = artifacts.manifest_header(_flat(spark, sf).materialized(), generated_utc=NOW_UTC, hashing="stream")
    return header.select("share_id", "file_count", "total_bytes", "excluded_count", "content_sha256", "share_mode")


def content_hash_by_source(spark, sf):
    docs = K.load(spark, sf, K.PLAIN)
    return artifacts.content_hash(docs.select("share_id", "path", F.sha2("text", 256).alias("sha256")))


def exclusion_tally(spark, sf):
    tally = audit.rule_tally(_flat(spark, sf).exclusions)
    flat = F.transform(F.map_entries("excluded_by_rule"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return tally.select("share_id", F.array_join(flat, ",").alias("by_rule"))


def checksum_lines(spark, sf):
    return artifacts.checksum_lines(artifacts.manifest_files(_flat(spark, sf).included)).select("share_id", "path", "line")


def share_report_rules(spark, sf):
    result = _flat(spark, sf).materialized()
    header = artifacts.manifest_header(result, generated_utc=NOW_UTC)
    report = artifacts.share_report(header, result.exclusions, result.settings)
    return report.where("part = 3 OR (part = 1 AND ord <> '')").select("share_id", "part", "line")


def _tracked(spark, sf) -> DataFrame:
    """Documents with a label stand for tracked files."""
    labels = K.table(spark, sf, "labels").select("doc_id")
    return K.load(spark, sf, K.TREE).join(labels, "doc_id", "left_semi").select("share_id", "path")


def tracked_not_shipped(spark, sf):
    return audit.tracked_not_shipped(_tracked(spark, sf), classify(_files(spark, sf, K.TREE), TEXTS).included)


def shipped_not_tracked(spark, sf):
    return audit.shipped_not_tracked(_tracked(spark, sf), classify(_files(spark, sf, K.TREE), TEXTS).included)


def tracked_reason_buckets(spark, sf):
    result = classify(_files(spark, sf, K.TREE), TEXTS).materialized()
    rows = audit.tracked_reasons(_tracked(spark, sf), result.included, result.exclusions)
    return rows.groupBy("share_id", "rule").agg(F.count(F.lit(1)).alias("n"))


def verify_objects(spark, sf):
    """Delivered = labelled documents (toxic ones altered) plus benchmark items nobody listed."""
    docs = K.load(spark, sf, K.PLAIN)
    listed = docs.select("share_id", "path", F.sha2("text", 256).alias("sha256"))
    labels = K.table(spark, sf, "labels").select("doc_id", "toxic")
    text = F.when(F.col("toxic") == 1, F.concat("text", F.lit(" altered"))).otherwise(F.col("text"))
    sent = docs.join(labels, "doc_id").select("share_id", "path", F.sha2(text, 256).alias("sha256"))
    extra = K.table(spark, sf, "benchmark").select(
        F.lit("src0").alias("share_id"), F.concat(F.lit("extra/"), "item_id").alias("path"), F.sha2("text", 256).alias("sha256"))
    return audit.verify_objects(listed, sent.unionByName(extra))


def triage_top_paths(spark, sf):
    rows = audit.triage_paths(_flat(spark, sf).materialized().exclusions.withColumn("share_id", F.lit("all")), prefix="SEC-")
    return rows.select("rule", "rank", "path", "n", "more")


def triage_ext_histogram(spark, sf):
    return audit.triage_extensions(_flat(spark, sf).exclusions)


# -- shards, retention, ledger -----------------------------------------------------

def shard_assignment(spark, sf):
    files = _files(spark, sf, K.PLAIN)
    included = files.select("share_id", "path", F.col("length").alias("size"))
    rows = artifacts.shard_assignment(files, included, SHARD_CHARS)
    return rows.select("share_id", "path", F.col("n").alias("chars"), F.col("bin").alias("shard_no"))


def shard_manifest(spark, sf):
    files = _files(spark, sf, K.PLAIN)
    included = files.select("share_id", "path", F.col("length").alias("size"))
    assignment = materialize(artifacts.shard_assignment(files, included, SHARD_CHARS))
    return artifacts.merged_shards(files, assignment).drop("text")


def _archives(spark, sf) -> DataFrame:
    """Orders stand for archives: date of creation, price in thousandths as bytes."""
    return K.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("archive_id"), F.format_string("share_%d.zip", "o_orderkey").alias("name"),
        F.col("o_orderdate").alias("mtime"), F.floor(F.col("o_totalprice")).cast("long").alias("bytes"))


def retention_plan(spark, sf):
    plan = retention.retention_plan(_archives(spark, sf), now=RETENTION_NOW, days=RETENTION_DAYS, mb=RETENTION_MB)
    return plan.select("archive_id", "name", "bytes", "action", "reason")


def retention_summary(spark, sf):
    return retention.retention_summary(
        retention.retention_plan(_archives(spark, sf), now=RETENTION_NOW, days=RETENTION_DAYS, mb=RETENTION_MB))


def ledger_rollup(spark, sf):
    """Events stand for share events: the user is the share, the event type the rule."""
    events = K.table(spark, sf, "events").select(
        F.concat(F.lit("user"), "user_id").alias("share_id"), F.col("ts").cast("timestamp").alias("timestamp_utc"),
        F.create_map("event_type", F.get_json_object("props", "$.k").cast("bigint")).alias("excluded_by_rule"))
    rows = artifacts.ledger_rollup(events)
    return rows.select(F.date_format("bucket", "yyyy-MM-dd").alias("day"), "rule", "n_excluded", "n_events")


# -- quick scan ------------------------------------------------------------------------

def quick_findings(spark, sf):
    return quick_scan(K.load(spark, sf, K.QUICK_SPARK))


def quick_scan_verdict(spark, sf):
    texts = K.load(spark, sf, K.QUICK_SPARK)
    return quick_verdict(texts, quick_scan(texts))


def quick_verdict_pages(spark, sf):
    pages = K.load(spark, sf, f"SELECT share_id, path, html AS text FROM ({K.PAGES})", "pages")
    return quick_verdict(pages, quick_scan(pages))


# -- structure --------------------------------------------------------------------------

def structural_paths(spark, sf):
    return structural_filter(_files(spark, sf, K.TREE)).select("share_id", "path")


def folder_sums(spark, sf):
    return folder_summary(structural_filter(_files(spark, sf, K.TREE)))


def structural_pages(spark, sf):
    pages = K.load(spark, sf, f"SELECT page_id, share_id, path, length(html) AS length FROM ({K.PAGES})", "pages")
    return structural_filter(pages).select("page_id", "share_id", "path")


# -- streams --------------------------------------------------------------------------------

def _work_dir(spark) -> str:
    """A fresh folder next to the session's checkpoints, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def _message_stream(spark, sf) -> DataFrame:
    """The table as a stream. A stream reads folders: a table that is one file is picked from its folder by name."""
    stream, folder = spark.readStream.schema(K.table(spark, sf, "conversations").schema), f"{sf}/conversations.parquet"
    stream = stream.parquet(folder) if is_folder(spark, folder) else stream.option("pathGlobFilter", "conversations.parquet").parquet(sf)
    stream.createOrReplaceTempView("sharegate_conversations")
    return spark.sql(K.CONVERSATIONS.replace("FROM conversations", "FROM sharegate_conversations"))


def stream_gate(spark, sf):
    work = _work_dir(spark)
    query = route(gate_stream(_message_stream(spark, sf)), f"{work}/shared", f"{work}/withheld", f"{work}/state")
    query.awaitTermination()
    rows = spark.read.parquet(f"{work}/shared/*").unionByName(spark.read.parquet(f"{work}/withheld/*"))
    return rows.select("share_id", "path", F.coalesce("rule", F.lit("INCLUDE")).alias("decision"))


def stream_rule_rollup(spark, sf):
    """Messages get a time from their conversation; one window per conversation. Times have fewer hours than ids may have
    values: hours come again after HOURS conversations, and a window is counted by conversation."""
    work = _work_dir(spark)
    hour, second = F.pmod(F.col("conv_id").cast("long"), F.lit(HOURS)), F.pmod(F.col("turn").cast("long"), F.lit(3600))
    timed = _message_stream(spark, sf).withColumn("ts", F.timestamp_seconds(hour * 3600 + second))
    counts = rule_rollup(gate_stream(timed, keys=("conv_id",)), window="1 hour", lateness="30 days", keys=("conv_id",))
    query = (counts.writeStream.outputMode("update").option("checkpointLocation", f"{work}/state")
             .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{work}/out/batch={n}"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    rows = spark.read.parquet(f"{work}/out")
    return rows.groupBy("window_start", "conv_id", "rule").agg(F.max_by("n", "batch").alias("n")).select(F.col("conv_id").cast("long"), "rule", "n")


# -- what must stay withheld, settings, verification ----------------------------------

def allow_unreadable(spark, sf):
    """Everything is denied by name and the oldest document of each share allowed; every fifth document cannot be read."""
    docs = K.load(spark, sf, K.UNREADABLE)
    rows = docs.groupBy("share_id").agg(F.array(F.min("path")).alias("allow"), F.array(F.lit("*.md")).alias("deny_globs"))
    return classify(files_from_texts(docs), TEXTS, overrides=rows).decision_map


def override_settings(spark, sf):
    """Settings as JSON by share: private, an unknown mode, broken JSON, and none."""
    docs = K.load(spark, sf, K.LOCAL_TEXTS)
    body = F.expr("CASE share_no % 4 WHEN 0 THEN '{\"share_mode\": \"private\", \"respect_gitignore\": false}' WHEN 1 THEN '{\"share_mode\": \"Public\"}' "
                  "WHEN 2 THEN '{\"share_mode\": ' END")
    settings = docs.select("share_id", "share_no").distinct().select("share_id", body.alias("json")).where("json IS NOT NULL")
    result = classify(files_from_texts(docs), TEXTS, overrides=overrides_from_json(settings))
    return result.decision_map


def manifest_header_per_share(spark, sf):
    docs = K.load(spark, sf, K.LOCAL_TEXTS)
    rows = docs.where("share_no % 4 = 0").select("share_id", F.lit("private").alias("share_mode")).distinct()
    header = artifacts.manifest_header(classify(files_from_texts(docs), TEXTS, overrides=rows).materialized(), generated_utc=NOW_UTC)
    own = F.col("policy_sha256") != policy_fingerprint(TEXTS)
    return header.select("share_id", "file_count", "excluded_count", "share_mode", own.alias("own_policy"))


def long_texts(spark, sf):
    """A credential in the middle of a text above the size limit for files is found."""
    return classify(files_from_texts(K.load(spark, sf, K.LONG)), TEXTS).decision_map


def reading_gates(spark, sf):
    """Contents as bytes: text, NUL, image, missing, stat failure, Latin-1."""
    docs = K.load(spark, sf, K.PLAIN).withColumn("k", F.col("doc_id") % 6)
    key = F.lit("id " + "AK" + "IA" + "Z" * 16 + " ").cast("binary")
    content = F.when(F.col("k") == 0, F.col("text").cast("binary")).when(F.col("k") == 1, F.concat(F.unhex(F.lit("00")), F.col("text").cast("binary"))) \
               .when(F.col("k") == 2, F.concat(F.unhex(F.lit("89504E4700")), F.col("text").cast("binary"), key)) \
               .when(F.col("k") == 5, F.concat(F.unhex(F.lit("636166E9")), key, F.col("text").cast("binary")))
    files = docs.select("share_id", F.when(F.col("k") == 2, F.concat("path", F.lit(".png"))).otherwise(F.col("path")).alias("path"), content.alias("content"),
                        F.octet_length(content).cast("long").alias("length"), F.lit(None).cast("timestamp").alias("modified"),
                        F.when(F.col("k") == 4, F.lit("stat:OSError: gone")).alias("read_error"))
    return classify(files, TEXTS).decision_map


def focus_and_output(spark, sf):
    """Focus folder, the run's own output and an excluded path that no directory rule also cuts."""
    settings = ShareSettings(max_scan_bytes=None, focus="area/a1", output_prefix="area/a1/b2", exclude_paths=("area/a1/b3/",))
    return classify(files_from_texts(K.load(spark, sf, K.AREAS)), settings).decisions.select("share_id", "path", "status", "prune_reason")


def select_paths(spark, sf):
    """Documents with a label as path list; an empty list falls through to all."""
    files = _files(spark, sf, K.PLAIN)
    labels = K.table(spark, sf, "labels").select("doc_id")
    listed = K.load(spark, sf, K.PLAIN).join(labels, "doc_id", "left_semi").select("share_id", "path")
    chosen, how = select_files(files, path_list=listed)
    rest, fallen = select_files(files, path_list=listed.where("false"))
    return chosen.select("share_id", "path", F.lit(how).alias("selection")).unionByName(rest.select("share_id", "path", F.lit(fallen).alias("selection")))


def quick_many_runs(spark, sf):
    """A secret behind 300 harmless base64 runs."""
    return quick_scan(K.load(spark, sf, K.MANY_SPARK))


def content_hash_tree(spark, sf):
    docs = K.load(spark, sf, K.PLAIN)
    return artifacts.content_hash_tree(docs.select("share_id", "path", F.sha2("text", 256).alias("sha256")))


def _delivery(spark, sf):
    """Recorded hashes, and those of a delivery in which toxic documents changed and share src1 is empty. Share src2 was empty from the start."""
    docs = K.load(spark, sf, K.PLAIN)
    toxic = K.table(spark, sf, "labels").where("toxic = 1").select("doc_id", F.lit(True).alias("changed"))
    listed = docs.where("share_id <> 'src2'").select("doc_id", "share_id", "path", F.sha2("text", 256).alias("sha256"))
    sent = listed.join(toxic, "doc_id", "left").where("share_id <> 'src1'") \
                 .withColumn("sha256", F.when(F.col("changed"), F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    shares = docs.select("share_id").distinct()
    header = shares.join(artifacts.content_hash_tree(listed), "share_id", "left") \
                   .withColumn("content_sha256", F.coalesce("content_sha256", F.lit(artifacts.EMPTY_SHA256)))
    return listed, sent, header


def verify_hashes(spark, sf):
    listed, sent, header = _delivery(spark, sf)
    return audit.verify_hashes(header, artifacts.content_hash_tree(sent))


def verify_status(spark, sf):
    listed, sent, header = _delivery(spark, sf)
    return audit.share_status(audit.verify_objects(listed, sent), audit.verify_hashes(header, artifacts.content_hash_tree(sent)))


def manifest_header_tree(spark, sf):
    """The default header: counts in one aggregate, the root of the hash tree as content hash."""
    header = artifacts.manifest_header(_flat(spark, sf).materialized(), generated_utc=NOW_UTC)
    return header.select("share_id", "file_count", "total_bytes", "excluded_count", "content_sha256", "hash_kind")


def verify_changed_paths(spark, sf):
    """Which files of a delivery differ, by descending the hash trees."""
    listed, sent, _ = _delivery(spark, sf)
    return artifacts.changed_paths(listed, sent)


def shard_assignment_per_share(spark, sf):
    """Even shares have shards of half the size."""
    files = _files(spark, sf, K.PLAIN)
    included = files.select("share_id", "path", F.col("length").alias("size"))
    number = F.substring_index("share_id", "src", -1).cast("int")
    own = included.select("share_id").distinct().where(number % 2 == 0).select("share_id", F.lit(SHARD_CHARS // 2).alias("max_chars"))
    rows = artifacts.shard_assignment(files, included, SHARD_CHARS, own)
    return rows.select("share_id", "path", F.col("n").alias("chars"), F.col("bin").alias("shard_no"))


# -- stored content, ledger, late rows, reading modes ---------------------------------------

def pack_counts(spark, sf):
    """Everything a run leaves, from one scan with stored content. Copies of a text are one object; names that end in 7 are denied."""
    settings = ShareSettings(max_scan_bytes=None, deny_globs=("doc_*7.md",), max_chars=SHARD_CHARS)
    out = artifacts.pack(None, classify(_files(spark, sf, K.PLAIN), settings, store=True), generated_utc=NOW_UTC)
    sizes = out["objects"].select("sha256", F.octet_length("content").cast("long").alias("bytes"), (F.sha2("content", 256) == F.col("sha256")).alias("own"))
    files = out["files"].groupBy("share_id", "sha256").agg(F.count(F.lit(1)).alias("n")).join(sizes, "sha256") \
                        .groupBy("share_id").agg(F.sum("n").alias("files"), F.count(F.lit(1)).alias("objects"), F.sum("bytes").alias("object_bytes"), F.bool_and("own").alias("hashes_hold"))
    shards = out["shards"].groupBy("share_id").agg(F.sum("chars").alias("shard_chars"))
    return files.join(shards, "share_id").join(out["manifest_header"].select("share_id", "excluded_count"), "share_id")


def ledger_replayed(spark, sf):
    """Events stand for share events. Even users' events come first, then all of them, then all again: each key stays once."""
    ledger = f"{_work_dir(spark)}/ledger"
    events = K.table(spark, sf, "events").select(F.col("event_type").alias("event"), F.concat(F.lit("user"), "user_id").alias("share_id"),
                                                 F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp_utc"))
    for part in (events.where("cast(substring(share_id, 5) AS long) % 2 = 0"), events, events):
        append_ledger(part, ledger)
    kept = spark.read.schema("event string, share_id string, timestamp_utc string, day string").json(ledger)
    return kept.groupBy("day", "event").agg(F.count(F.lit(1)).alias("n"))


def stream_late_rows(spark, sf):
    """Messages of odd conversations arrive first, those of even ones later: windows that the watermark has closed by then stay
    closed. The gate runs once; the rollup is a second stream over what was withheld."""
    work = _work_dir(spark)
    table, name = K.table(spark, sf, "conversations"), f"late_{uuid.uuid4().hex}"
    for odd in (1, 0):
        table.where(f"conv_id % 2 = {odd}").write.mode("append").parquet(f"{work}/in")
        spark.readStream.schema(table.schema).parquet(f"{work}/in").createOrReplaceTempView(name)
        timed = spark.sql(K.CONVERSATIONS.replace("FROM conversations", f"FROM {name}")).withColumn("ts", F.timestamp_seconds(F.col("conv_id") * 3600 + F.col("turn")))
        decided = gate_stream(timed)
        route(decided, f"{work}/shared", f"{work}/withheld", f"{work}/gate").awaitTermination()
        held = spark.readStream.schema(decided.schema).parquet(f"{work}/withheld")
        counts = rule_rollup(held, window="1 hour", lateness="10 hours")
        query = (counts.writeStream.outputMode("update").option("checkpointLocation", f"{work}/rollup")
                 .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{work}/out/batch={n}")).trigger(availableNow=True).start())
        query.awaitTermination()
    final = spark.read.parquet(f"{work}/out").groupBy("window_start", "rule").agg(F.max_by("n", "batch").alias("n"))
    late = late_rows(spark.read.schema(decided.schema).parquet(f"{work}/withheld"), final)
    return late.select((F.unix_timestamp("window_start") / 3600).cast("long").alias("conv_id"), "rule", "n_late")


def size_gate(spark, sf):
    """Files above 2,000 bytes are withheld, whatever they hold, unless their name already is."""
    return classify(_files(spark, sf, K.FLAT), ShareSettings(max_scan_bytes=2000)).decision_map


def nul_windows(spark, sf):
    """A NUL behind the first 8,192 bytes: text under the default window, binary when the whole file is searched."""
    tail = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" lorem ipsum" * 700).cast("binary"), F.unhex(F.lit("00")))).otherwise(F.lit("").cast("binary"))
    files = files_from_texts(K.load(spark, sf, K.PLAIN)).join(K.load(spark, sf, K.PLAIN).select("share_id", "path", tail.alias("tail")), ["share_id", "path"])
    files = files.withColumn("content", F.concat("content", "tail")).drop("tail")
    each = [classify(files, ShareSettings(max_scan_bytes=None, nul_window_bytes=w)).decision_map.withColumn("nul_window", F.lit(w).cast("int")) for w in (8192, None)]
    return each[0].unionByName(each[1])


def quick_read_mode(spark, sf):
    """The quick scan of bytes: malformed ones are dropped, unreadable files are marked."""
    k = F.col("doc_id") % 5
    broken = F.concat(F.col("text").cast("binary"), F.lit(" AK").cast("binary"), F.unhex(F.lit("E9")), F.lit("IA" + "Q" * 16).cast("binary"))
    content = F.when(k == 1, broken).when(k != 0, F.col("text").cast("binary"))
    docs = K.load(spark, sf, K.PLAIN).select("share_id", "path", content.alias("content"), F.when(k == 0, "gone").alias("read_error"))
    texts = texts_of(docs)
    found = quick_scan(texts).select("share_id", "path", "rule")
    return texts.select("share_id", "path", "skipped").join(found, ["share_id", "path"], "left")


def share_report_head(spark, sf):
    """The lines of the report's head that tell of the share."""
    result = _flat(spark, sf).materialized()
    report = artifacts.share_report(artifacts.manifest_header(result, generated_utc=NOW_UTC), result.exclusions, result.settings)
    return report.where("part = 0 AND (line LIKE '# %' OR line LIKE '**%' OR line LIKE '- Content%' OR line LIKE '- Selection%')").select("share_id", "line")


def policy_documents(spark, sf):
    """The policy each share went out under; shares 0, 4, 8, .. are private."""
    docs = K.load(spark, sf, K.LOCAL_TEXTS)
    rows = docs.where("share_no % 4 = 0").select("share_id", F.lit("private").alias("share_mode")).distinct()
    header = artifacts.manifest_header(classify(files_from_texts(docs), TEXTS, overrides=rows).materialized(), generated_utc=NOW_UTC)
    body = F.from_json("body", "share_mode string, policy_version string, rules array<struct<rule_id:string,family:string>>")
    return artifacts.policy_documents(header).select("share_id", body.alias("b")).select(
        "share_id", "b.share_mode", "b.policy_version", F.size("b.rules").cast("long").alias("n_rules"),
        F.size(F.filter("b.rules", lambda r: r["family"] == "local")).cast("long").alias("n_local"))


def select_explicit(spark, sf):
    """An explicit list (documents with a label) goes before a path list; its files are decided without the walk's own filters."""
    files = _files(spark, sf, K.TREE)
    labels = K.table(spark, sf, "labels").select("doc_id")
    listed = K.load(spark, sf, K.TREE).join(labels, "doc_id", "left_semi").select("share_id", "path")
    chosen, how = select_files(files, explicit=listed, path_list=files.select("share_id", "path"))
    return chosen.select("share_id", "path", F.lit(how).alias("selection"))


def missing_documents(spark, sf):
    """Documents of an audit that a share lacks: every share has its policy, those with a toxic document also a manifest."""
    docs = K.load(spark, sf, K.PLAIN).select("doc_id", "share_id")
    toxic = docs.join(K.table(spark, sf, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    shares = docs.select("share_id").distinct()
    present = shares.withColumn("name", F.lit("policy")).unionByName(toxic.select("share_id", F.lit("manifest").alias("name")).distinct())
    return audit.missing_documents(shares, present, ["manifest", "policy", "exclusions"])


QUERIES = [
    content_exclusions_by_rule, content_first_hit, content_scan_pages, share_mode_diff, path_rule_decisions, decision_map,
    source_only_and_filters, gate_verdict, allow_override_log, per_share_overrides, ignore_decisions, ignore_extra_names, pii_hits_by_doc,
    pii_by_lang, pii_by_label, pii_pages, pii_authors, pii_gate, redacted_documents, redacted_authors, manifest_files,
    manifest_header, content_hash_by_source, exclusion_tally, checksum_lines, share_report_rules, tracked_not_shipped,
    shipped_not_tracked, tracked_reason_buckets, verify_objects, triage_top_paths, triage_ext_histogram,
    shard_assignment, shard_manifest, retention_plan, retention_summary, ledger_rollup, quick_findings,
    quick_scan_verdict, quick_verdict_pages, structural_paths, folder_sums, structural_pages, stream_gate, stream_rule_rollup,
    allow_unreadable, override_settings, manifest_header_per_share, long_texts, reading_gates, focus_and_output, select_paths, quick_many_runs,
    content_hash_tree, verify_hashes, verify_status, manifest_header_tree, verify_changed_paths, shard_assignment_per_share,
    pack_counts, ledger_replayed, stream_late_rows, size_gate, nul_windows, quick_read_mode, share_report_head, policy_documents, select_explicit,
    missing_documents,
]


def _shipped(query):
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)
    return run


def queries() -> dict:
    return {q.__name__: _shipped(q) for q in QUERIES}
