import base64
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from sharegate.functions.pii import pii_hits as hits_column
from sharegate.functions.pii import pii_rule, redact_pii
from sharegate.functions.text import render_block
from sharegate.operators import artifacts, audit, ordered
from sharegate.operators.classify import classify
from sharegate.operators.ignore import gather_ignore_rules
from sharegate.operators.personal_data import pii_hits
from sharegate.operators.quick_scan import quick_scan, quick_verdict, texts_of
from sharegate.operators.retention import purge_event, retention_plan, retention_summary
from sharegate.operators.structure import folder_summary, structural_filter
from sharegate.policy import ShareSettings
from sharegate.session import materialize
from sharegate.sources import sinks, tables, tree
from sharegate.streaming.gate import gate_stream, route
from tests import brute

DOC = "Lost and found\n\nMail desk@harbour.example, ring 604 555 0182\nor show 3782-8224-6310-005 with number 219-09-9999 at the desk.\n"
CODE = "/* maintained by k.ito@harbour.example */\n/* (c) harbour, ops@harbour.example */\nreturn 0;\n"
TEXTS = [DOC, CODE, DOC + CODE, "", "no data", "\U0001F600 a@b.co\r\nx 123-45-6789 maintainer: q@z.org 415 555 0199\x0by@z.org",
         "a@b.co,a@b.co;c@d.org\r\r\n(415)555-0199 +1 415.555.0199", "\n".join(f"u{i}@ex.org 123-45-{i:04}" for i in range(300)),
         " ".join(f"u{i}@ex.org" for i in range(500)), "4111-1111-1111-1111 411111111111111 4111111111111111 41111111111111111"]


@pytest.mark.parametrize("allow, skip", [((), True), ((), False), (("a@b.co", "123-45-6789", "desk@harbour.example"), True)])
def test_pii_equals_python(spark, allow, skip):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    flag = str(skip).lower()
    rows = df.select("i", hits_column("t", allow, flag).alias("h"), redact_pii("t", allow, flag).alias("r")).collect()
    for row in rows:
        text = TEXTS[row.i]
        assert [tuple(h) for h in row.h] == brute.personal(text, allow, skip), text
        assert row.r == brute.redacted(text, allow, skip), text


def test_pii_rules_and_no_values(spark):
    df = spark.createDataFrame([(DOC,)], "t string")
    rows = pii_hits(df, "t").collect()
    assert [r.rule for r in rows] == ["PII-EMAIL", "PII-PHONE", "PII-CC", "PII-SSN"] and "harbour" not in str(rows)
    assert df.select(pii_rule("cast(NULL AS int)").alias("r")).first().r is None


def test_blocks(spark):
    want = {
        "x = 1  \n\ny\r\nz": "   1 | x = 1\n   2 | \n   3 | y\n   4 | z", "": "", "\n": "   1 | ", "a\tb \x1f\n c  \n": "   1 | a\tb\n   2 |  c",
        "one\x0ctwo\x85three": "   1 | one\n   2 | two\n   3 | three"}
    df = spark.createDataFrame([(t,) for t in [*want, "abc \n" * 10050]], "t string")
    got = {r.t: r.b for r in df.select("t", F.expr(render_block("'a/b.py'", "'.py'", "t")).alias("b")).collect()}
    for text, body in want.items():
        assert got[text] == "### a/b.py\n```python\n" + body + "\n```\n\n"
    lines = got["abc \n" * 10050].split("\n")
    assert lines[10050] == "10049 | abc" and lines[2] == "   1 | abc" and len(lines) == 10055


@pytest.fixture
def many_pieces(spark, monkeypatch):
    """Cut small inputs into several pieces too."""
    monkeypatch.setattr(ordered, "MIN_ROWS", 10)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("limit, sizes", [(100, (1, 60)), (50, (50, 50)), (10, (1, 40)), (1000, (3, 9)), (1, (2, 5))])
def test_greedy_bins(spark, many_pieces, limit, sizes):
    rng = random.Random(limit)
    rows = [(share, rng.randint(0, 30), f"p{i:05}", rng.randint(*sizes)) for share, n in (("hot", 3000), ("a", 1), ("b", 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "share_id string, size long, path string, n long").repartition(7)
    got = {(r.share_id, r.path): r.bin for r in ordered.greedy_bins(df, "share_id", limit).collect()}
    want = {}
    for share in ("hot", "a", "b"):
        want |= {(share, p): b for p, b in brute.bins([r[1:] for r in rows if r[0] == share], limit).items()}
    assert got == want
    assert ordered.segments(df, ["share_id", "size", "path"]).where("share_id = 'hot'").select("seg").distinct().count() > 1


@pytest.mark.parametrize("fan", [2, 3, 32])
def test_greedy_bins_put_together_in_blocks(spark, many_pieces, monkeypatch, fan):
    """Own limits per share, pieces in several levels of blocks, items longer than a bin; equal to filling one by one."""
    monkeypatch.setattr("sharegate.operators.ordered.FAN", fan)
    rng = random.Random(fan)
    rows = [(share, rng.randrange(40), f"p{i:04}", rng.choice([0, 1, 3, 10, 11, 40, 90])) for share, n in (("a", 900), ("b", 40), ("c", 1)) for i in range(n)]
    limits = {"a": 100, "b": 25, "c": 5}
    df = spark.createDataFrame([(*r, limits[r[0]]) for r in rows], "share_id string, size long, path string, n long, most int")
    from sharegate.operators.ordered import greedy_bins
    got = {(r.share_id, r.path): r.bin for r in greedy_bins(df, "share_id", "most").collect()}
    for share, limit in limits.items():
        number, fill = 0, None
        for _, _, path, n in sorted(r for r in rows if r[0] == share):
            if fill is None or fill + n > limit:
                number, fill = number + 1, 0
            fill += n
            assert got[share, path] == number, (share, path)


def test_step_functions_compose():
    from sharegate.operators.ordered import Step, _piece_summary
    import pandas as pd
    rng = random.Random(8)
    for _ in range(60):
        limit = rng.choice([10, 37])
        pieces = [[rng.randrange(1, 15) for _ in range(rng.randrange(1, 9))] for _ in range(4)]
        steps = [Step.of(_piece_summary("g")(pd.DataFrame({"g": "x", "seg": k, "size": range(len(p)), "path": "p", "n": p, "_limit": limit}))) for k, p in enumerate(pieces)]
        whole = steps[0].then(steps[1]).then(steps[2].then(steps[3]))
        for start in [(0, 0), *((3, f) for f in range(1, 50))]:
            state = start
            for step in steps:
                state = step.after(*state)
            assert whole.after(*start) == state


def test_hash_trees_show_what_changed(spark):
    rows = [(f"s{k % 3}", f"dir/{k}", hashlib.sha256(str(k).encode()).hexdigest()) for k in range(500)]
    listed = spark.createDataFrame(rows, "share_id string, path string, sha256 string")
    sent = [r for r in rows if r[1] not in ("dir/7", "dir/8")]
    sent = [(s, p, "0" * 64 if p == "dir/33" else h) for s, p, h in sent] + [("s0", "new", "1" * 64), ("s9", "lone", "2" * 64)]
    delivered = spark.createDataFrame(sent, "share_id string, path string, sha256 string")
    want = {("s1", "dir/7", "MISSING"), ("s2", "dir/8", "MISSING"), ("s0", "dir/33", "CORRUPT"), ("s0", "new", "UNLISTED"), ("s9", "lone", "UNLISTED")}
    stored = materialize(artifacts.hash_leaves(listed))
    for recorded in (None, stored):
        assert {tuple(r) for r in artifacts.changed_paths(listed, delivered, recorded).collect()} == want
    assert artifacts.changed_paths(listed, listed).count() == 0
    assert artifacts.changed_leaves(stored, artifacts.hash_leaves(delivered)).count() <= 5
    roots = artifacts.hash_roots(artifacts.hash_branches(stored))
    assert {tuple(r) for r in roots.collect()} == {tuple(r) for r in artifacts.content_hash_tree(listed).collect()}
    with pytest.raises(Exception, match="without a hash"):
        artifacts.content_hash_tree(listed.withColumn("sha256", F.lit(None).cast("string"))).collect()


def test_content_hash(spark, many_pieces):
    rows = [("s", f"{c}/é{i}", f"{i:064x}") for i in range(2000) for c in ("z", "\U0001F600", "�")] + [("t", "a", "b" * 64)]
    df = spark.createDataFrame(rows, "share_id string, path string, sha256 string")
    got = {r.share_id: r.content_sha256 for r in artifacts.content_hash(df.repartition(6)).collect()}
    for share in ("s", "t"):
        want = hashlib.sha256("".join(f"{p}\0{h}\n" for s, p, h in sorted(rows) if s == share).encode()).hexdigest()
        assert got[share] == want


def test_running_sum(spark, many_pieces):
    rows = [(g, i, i % 7) for g in ("a", "b") for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i int, v int").repartition(5)
    for row in ordered.running_sum(df, ["g"], ["i"], "v").collect():
        assert row.before == sum(x % 7 for x in range(row.i))


@pytest.mark.parametrize("days, mb, keep", [(30, 1, None), (0, 1, None), (30, 0, "z005.zip"), (30, 1, "z000.zip"), (0, 0, None), (100, 2, "z001.zip")])
def test_retention(spark, many_pieces, days, mb, keep):
    rng = random.Random(days + mb)
    rows = [(f"z{i:03}.zip", rng.choice([1, 5, 29, 31, 60, 61]) + 0.25, rng.randint(1, 90_000)) for i in range(60)]
    df = spark.createDataFrame([(i, n, age, b) for i, (n, age, b) in enumerate(rows)], "archive_id long, name string, age double, bytes long")
    df = df.withColumn("mtime", F.expr("timestamp'2026-01-01 00:00:00' - make_dt_interval(0, 0, 0, age * 86400)")).drop("age")
    plan = materialize(retention_plan(df, now="2026-01-01 00:00:00", days=days, mb=mb, keep_name=keep))
    want = brute.plan(rows, 0, days, mb * 1024 * 1024, keep)
    assert {r.name for r in plan.where("action = 'delete'").collect()} == want
    summary = retention_summary(plan).first()
    assert summary.deleted_count == len(want) and summary.freed_bytes == sum(b for n, _, b in rows if n in want)
    assert summary.remaining_count + summary.deleted_count == 60
    assert purge_event(plan, now="2026-01-01", days=days, mb=mb).first().event == "purge"


def test_pack_and_verify(spark, make_files, tmp_path):
    files = make_files({"b.py": "print(1)\n", "a.md": "hi\n", "k.pem": "x", "big.txt": "line\n" * 40, "ip.txt": "10.1.2.3"}, "s1")
    files = files.unionByName(make_files({"only.env": "x"}, "s2"))
    tracked = spark.createDataFrame([("s1", "a.md"), ("s1", "k.pem"), ("s1", "lost.c")], "share_id string, path string")
    out = artifacts.pack(files, classify(files, ShareSettings(max_chars=150)), generated_utc="2026-01-01T00:00:00Z", tracked=tracked)
    head = {r.share_id: r for r in out["manifest_header"].collect()}
    assert (head["s1"].file_count, head["s1"].excluded_count, head["s1"].shard_count) == (3, 2, 2)
    assert (head["s2"].file_count, head["s2"].content_sha256) == (0, artifacts.EMPTY_SHA256)
    shards = {r.name: r for r in out["shards"].collect()}
    assert sorted(shards) == ["_MERGED/source_code_part01.txt", "_MERGED/source_code_part02.txt"]
    first = shards["_MERGED/source_code_part01.txt"]
    assert first.text == "### a.md\n```markdown\n   1 | hi\n```\n\n### b.py\n```python\n   1 | print(1)\n```\n\n"
    assert first.sha256 == hashlib.sha256(first.text.encode()).hexdigest() and first.chars == len(first.text)
    assert "10.1.2.3" not in "".join(s.text for s in shards.values())
    assert {r.path for r in out["tracked_not_shipped"].collect()} == {"k.pem", "lost.c"}
    assert {r.path for r in out["shipped_not_tracked"].collect()} == {"b.py", "big.txt"}
    exclusions = out["exclusions"]
    reasons = audit.tracked_reasons(tracked, out["manifest_files"], exclusions)
    assert {r.path: r.rule for r in reasons.collect()} == {"k.pem": "SEC-PATH-PEM", "lost.c": audit.UNSCANNED}
    lines = [r.line for r in out["report"].where("share_id = 's1'").orderBy("part", "ord").collect()]
    assert "| `LOC-RFC1918` | 1 | private (RFC1918) IP address |" in lines and lines.index("## Excluded files") < len(lines) - 4
    assert "_none_" not in lines and lines[0] == "# Share report - PUBLIC"
    event = out["events"].where("share_id = 's1'").first()
    assert event.excluded_by_rule == {"LOC-RFC1918": 1, "SEC-PATH-PEM": 1}
    sums = [r.line for r in out["checksums"].where("share_id = 's1'").orderBy("part", "path").collect()]
    assert sums[0].endswith("  a.md") and sums[-1].endswith("part02.txt") and len(sums) == 5

    assert head["s1"].content_sha256 == {r.share_id: r for r in artifacts.content_hash_tree(out["manifest_files"]).collect()}["s1"].content_sha256 and head["s1"].hash_kind == "tree"
    listed, good = out["manifest_files"], artifacts.content_hash(out["manifest_files"])
    ok = audit.share_status(audit.verify_objects(listed, listed), audit.verify_hashes(good, good))
    assert {(r.problems, r.status) for r in ok.collect()} == {(0, 0)}
    sent = listed.where("path <> 'b.py'").withColumn("sha256", F.when(F.col("path") == "a.md", "0").otherwise(F.col("sha256")))
    sent = sent.select("share_id", "path", "sha256").unionByName(spark.createDataFrame([("s1", "new", "1")], "share_id string, path string, sha256 string"))
    problems = audit.verify_objects(listed, sent)
    assert {r.path: r.status for r in problems.collect()} == {"a.md": "CORRUPT", "b.py": "MISSING", "big.txt": "OK", "new": "UNLISTED"}
    assert audit.share_status(problems, audit.verify_hashes(good, artifacts.content_hash(sent))).first()[1:] == (4, 2)
    present = spark.createDataFrame([("s1", "manifest")], "share_id string, name string")
    missing = audit.missing_documents(good.select("share_id"), present, ["manifest", "policy"])
    assert [r.name for r in missing.collect()] == ["policy"]
    assert audit.share_status(problems, audit.verify_hashes(good, good), missing).first().problems == 1

    sinks.write_tables({k: out[k] for k in ("manifest_files", "exclusions")}, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t/exclusions").count() == 3
    sinks.write_lines(out["checksums"], f"{tmp_path}/sums", ["part", "path"])
    assert spark.read.text(f"{tmp_path}/sums").count() == 5
    for _ in range(2):
        sinks.append_ledger(out["events"].withColumn("excluded_by_rule", F.to_json("excluded_by_rule")), f"{tmp_path}/ledger")
    assert spark.read.json(f"{tmp_path}/ledger").count() == 2  # the second append repeats the first
    later = out["events"].withColumn("excluded_by_rule", F.to_json("excluded_by_rule")).withColumn("timestamp_utc", F.lit("2026-01-02T00:00:00Z"))
    sinks.append_ledger(later.unionByName(later), f"{tmp_path}/ledger")
    assert spark.read.json(f"{tmp_path}/ledger").count() == 4
    roll = {r.rule: r.n_excluded for r in artifacts.ledger_rollup(out["events"]).collect()}
    assert roll == {"LOC-RFC1918": 1, "SEC-PATH-PEM": 1, "SEC-PATH-ENV": 1}


def test_triage(spark):
    rows = [("s", f"d/f{i:03}.{'py' if i % 3 else 'x'}", "SEC-A") for i in range(45)] + [("s", "Makefile", "LOC-B")]
    df = spark.createDataFrame(rows, "share_id string, path string, rule string")
    top = audit.triage_paths(df, "SEC-")
    assert top.count() == 40 and {r.more for r in top.collect()} == {5} and audit.triage_paths(df, limit=None).count() == 46
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    assert [(r.rule, r.ext, r.n) for r in audit.triage_extensions(df).collect()] == [("LOC-B", "(none)", 1), ("SEC-A", ".py", 30), ("SEC-A", ".x", 15)]


def test_quick_scan(spark, make_files):
    key = "AK" + "IA" + "Q" * 16
    b64 = base64.b64encode(f"id {key} end".encode()).decode()
    noise = " ".join(base64.b64encode(f"plain text number {i}".encode()).decode() for i in range(200))
    files = make_files({"a/id_rsa": "BEGIN RSA PRIVATE" + " KEY", "p.txt": key, "b.txt": b64, "u.txt": b64.rstrip("="), "h.txt": "0x" + key.encode().hex(),
                        "in.txt": f"{noise} {b64}", "out.txt": f"{noise} {noise[:28]} {b64}", "bad.txt": b"\xff" + key[:9].encode() + b"\xfe" + key[9:].encode(),
                        "x/.env": None, "n.txt": "mail a1.corp.internal", "odd.txt": "A" * 17 + " " + "abc" * 11})
    texts = texts_of(files.unionByName(make_files({"ok.txt": "fine"}, "clean")))
    found = quick_scan(texts)
    got = {(r.path, r.rule): r.detail for r in found.collect()}
    hidden = "encoded SEC-CONT-AWS secret"
    assert got == {("a/id_rsa", "SEC-PATH-KEY"): "dangerous filename", ("a/id_rsa", "SEC-CONT-PRIVKEY"): "secret in content",
                   ("p.txt", "SEC-CONT-AWS"): "secret in content", ("b.txt", "SEC-CONT-ENCODED"): hidden, ("u.txt", "SEC-CONT-ENCODED"): hidden,
                   ("h.txt", "SEC-CONT-ENCODED"): hidden, ("in.txt", "SEC-CONT-ENCODED"): hidden, ("out.txt", "SEC-CONT-ENCODED"): hidden, ("bad.txt", "SEC-CONT-AWS"): "secret in content",
                   ("x/.env", "SEC-PATH-ENV"): "dangerous filename", ("n.txt", "LOC-HOST"): "secret in content"}
    rows = {r.share_id: r for r in quick_verdict(texts, found).collect()}
    ids = ",".join(sorted(rule for _, rule in got))
    assert rows["s"].findings_hash == "sha256:" + hashlib.sha256(ids.encode()).hexdigest()[:12] and rows["s"].verdict == "BLOCKED"
    assert (rows["clean"].verdict, rows["clean"].findings_hash) == ("CLEAN", "sha256:" + hashlib.sha256(b"").hexdigest()[:12])


def test_structure(spark):
    keep = ["src/a.py", "readme.md", "manifest.json", "src/.bak", "holder/x.c", "Dockerfile"]
    drop = ["tests/a.py", "Data/x.py", "src/old/a.py", "src/my-backup/a.py", "x.tar.gz", "a/b.CSV", "yarn.lock", "a/x.bak.py", "a/x~", "WorkSpace/a.c", "u/data.zip.001"]
    df = spark.createDataFrame([("s", p, 2) for p in keep + drop], "share_id string, path string, length long")
    assert {r.path for r in structural_filter(df).collect()} == set(keep)
    sums = {r.dir: (r.n_files, r.n_bytes) for r in folder_summary(structural_filter(df)).collect()}
    assert sums == {"src": (2, 4), "holder": (1, 2)}


def test_tree_source(spark, tmp_path):
    for rel, body in {".env": "K=1", "src/_netrc": "x", ".ssh/id_rsa": "k", "src/deep/er/a.py": "print()", "src/deep/b.png": "\0" * 9_000_000}.items():
        path = tmp_path / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    os.symlink(tmp_path / "nowhere", tmp_path / "src" / "dangling")
    for parts in (1, 3, 64):
        listing = tree.list_tree(spark, str(tmp_path), "s", parts)
        rows = {r.path: r for r in listing.collect()}
        assert set(rows) == {".env", "src/_netrc", ".ssh/id_rsa", "src/deep/er/a.py", "src/deep/b.png", "src/dangling"}
    files = tree.read_files(listing, str(tmp_path))
    body = {r.path: r.content for r in files.collect()}
    assert bytes(body[".env"]) == b"K=1" and len(body["src/deep/b.png"]) == 9_000_000 and body["src/dangling"] is None
    got = {r.path: r.decision for r in classify(files).decision_map.collect()}
    assert got == {".env": "SEC-PATH-ENV", "src/_netrc": "SEC-PATH-NETRC", "src/deep/er/a.py": "INCLUDE", "src/deep/b.png": "INCLUDE", "src/dangling": "OPS-STAT"}


def test_tree_is_listed_in_stages(spark, tmp_path):
    want = set()
    for i in range(300):
        folder = tmp_path / f"d{i % 7}" / f"e{i}" / "f"
        folder.mkdir(parents=True)
        (folder / f"x{i}.txt").write_text("x")
        want.add(f"d{i % 7}/e{i}/f/x{i}.txt")
    os.symlink(tmp_path / "d0", tmp_path / "again")
    (tmp_path / "wide").mkdir()
    for i in range(50):
        (tmp_path / "wide" / f".w{i}").write_text("")
        want.add(f"wide/.w{i}")
    for most in (30, 100_000):
        listing = tree.list_tree(spark, str(tmp_path), "s", 4, most)
        rows = [r.path for r in listing.collect()]
        assert sorted(rows) == sorted(want) and listing.rdd.getNumPartitions() <= 4
    with pytest.raises(NotADirectoryError):
        tree.list_tree(spark, str(tmp_path / "none"))


def test_stored_content_is_read_once(spark, make_files, tmp_path):
    reads = spark.sparkContext.accumulator(0)
    (tmp_path / "tree" / "d").mkdir(parents=True)
    names = ["a.py", "d/copy.py", "d/other.md", "d/key.txt"]
    for name, body in zip(names, ["print(1)\n", "print(1)\n", "hi\n", "id AS" + "IA" + "7KQM" * 4 + " "]):
        (tmp_path / "tree" / name).write_text(body)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    files = tree.read_files(tree.list_tree(spark, str(tmp_path / "tree"), "s"), str(tmp_path / "tree"))
    files = files.mapInArrow(counted, files.schema)
    result = classify(files, ShareSettings(max_chars=40), store=True)
    for name in names:
        (tmp_path / "tree" / name).write_text("changed, with AS" + "IA" + "9KQM" * 4)
    out = artifacts.pack(None, result, generated_utc="2026-01-01T00:00:00Z")
    objects = {r.sha256: bytes(r.content) for r in out["objects"].collect()}
    assert sorted(objects.values()) == [b"hi\n", b"print(1)\n"] and all(hashlib.sha256(c).hexdigest() == h for h, c in objects.items())
    assert {r.path: objects[r.sha256] for r in out["files"].collect()} == {"a.py": b"print(1)\n", "d/copy.py": b"print(1)\n", "d/other.md": b"hi\n"}
    text = "".join(r.text for r in out["shards"].collect())
    assert "changed" not in text and text.count("print(1)") == 2 and {r.path for r in out["exclusions"].collect()} == {"d/key.txt"}
    assert '"rule_id":"LOC-' in out["policy"].first().body
    assert reads.value == 4
    for _ in range(2):
        sinks.add_objects(result.objects, f"{tmp_path}/store")
        assert spark.read.parquet(f"{tmp_path}/store").count() == 2
    ignored = classify(make_files({"a.py": "x", ".gitignore": "a.*"}), ignore_rules=gather_ignore_rules(make_files({".gitignore": "a.*"})), store=True)
    assert {r.path for r in ignored.included.collect()} == {".gitignore"} and ignored.objects.count() == 1


def test_finished_batch_is_left_alone(spark, tmp_path):
    spark.createDataFrame([("s", "m", "hello")], "share_id string, path string, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("share_id string, path string, text string").parquet(f"{tmp_path}/in")
    names = []
    for state in ("a", "b"):  # a lost checkpoint replays batch 0
        route(gate_stream(stream), f"{tmp_path}/ok", f"{tmp_path}/held", f"{tmp_path}/{state}").awaitTermination()
        names.append(sorted(p.name for p in (tmp_path / "ok" / "batch=0").iterdir()))
    assert names[0] == names[1] and spark.read.parquet(f"{tmp_path}/ok").count() == 1


def test_selection_and_config(spark, make_files, tmp_path):
    files = make_files({"a.py": "1", "b.py": "2"})
    (tmp_path / "list").write_text("./\n\nsrc/\n./a.py\n")
    listed = tables.read_path_list(spark, str(tmp_path / "list"), "s")
    chosen, label = tables.select_files(files, path_list=listed)
    assert [r.path for r in chosen.collect()] == ["a.py"] and label == tables.PATH_LIST
    assert tables.select_files(files, path_list=listed.where("path = 'none'"))[1] == tables.WALK
    assert tables.select_files(files, explicit=listed, path_list=listed)[1] == tables.EXPLICIT
    cfg = spark.createDataFrame([('{"exclude_dirs": ["Fixtures"], "exclude_exts": [".GGUF"]}',)], "json string")
    assert tables.structural_config(cfg) == {"exclude_dirs": ["fixtures"], "exclude_exts": [".gguf"], "exclude_filenames": []}


def test_stream_equals_batch_and_replay(spark, make_files, tmp_path):
    rows = [("s", f"m{i}", t) for i, t in enumerate(["hello", "peer 10.1.2.3", "AK" + "IA" + "A" * 16, None, "bye"])]
    spark.createDataFrame(rows, "share_id string, path string, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("share_id string, path string, text string").parquet(f"{tmp_path}/in")
    route(gate_stream(stream), f"{tmp_path}/ok", f"{tmp_path}/held", f"{tmp_path}/state").awaitTermination()
    batch = gate_stream(spark.read.parquet(f"{tmp_path}/in"))
    got = {r.path for r in spark.read.parquet(f"{tmp_path}/ok").collect()}
    assert got == {r.path for r in batch.where("status = 'included'").collect()} == {"m0", "m4"}
    held = {r.path: r.rule for r in spark.read.parquet(f"{tmp_path}/held").collect()}
    assert held == {"m1": "LOC-RFC1918", "m2": "SEC-CONT-AWSKEY", "m3": "OPS-UNREADABLE"}


def test_long_messages_are_scanned(spark):
    from sharegate.streaming.gate import gate_stream
    key = "AS" + "IA" + "7KQM" * 4
    rows = [("s", "long", "lorem ipsum " * 800_000 + f" {key} " + "dolor " * 10), ("s", "clean", "lorem ipsum " * 800_000)]
    got = {r.path: r.rule for r in gate_stream(spark.createDataFrame(rows, "share_id string, path string, text string")).collect()}
    assert got == {"long": "SEC-CONT-AWSKEY", "clean": None}


def test_names_times_and_events(spark):
    assert artifacts.generated_utc("86400") == "1970-01-02T00:00:00+00:00"
    row = ("s", artifacts.generated_utc(86400), "private", "a/b/")
    df = spark.createDataFrame([row], "share_id string, generated_utc string, share_mode string, focus string")
    got = df.select(artifacts.share_name(prefix="x-").alias("a"), artifacts.share_name("{mode}_{focus}", suffix="").alias("b")).first()
    assert (got.a, got.b) == ("x-19700102T000000Z_share_private.zip", "private_a_b")


def test_content_hash_refuses_missing_hashes(spark):
    df = spark.createDataFrame([("s", "a", None)], "share_id string, path string, sha256 string")
    with pytest.raises(Exception, match="without a hash: a"):
        artifacts.content_hash(df).collect()


def test_empty_share_verifies(spark):
    header = spark.createDataFrame([("s", artifacts.EMPTY_SHA256), ("t", "other")], "share_id string, content_sha256 string")
    got = audit.verify_hashes(header, header.where("false")).collect()
    assert {(r.share_id, r.result) for r in got} == {("s", "MATCH"), ("t", "MISMATCH")}


def test_shared_structural_config(spark):
    config = tables.structural_config(spark.createDataFrame([('{"exclude_dirs": ["Old"], "exclude_exts": [".TMP"]}',)], "json string"))
    settings = tables.with_structural_config(ShareSettings(exclude_exts=(".x",)), config)
    assert (settings.exclude_folders, settings.exclude_exts, settings.exclude_names) == (("old",), (".x", ".tmp"), ())


def test_path_list_with_absolute_lines(spark, tmp_path):
    (tmp_path / "list.txt").write_text("/data/top/a/b.md\n./c.md\n\nd/\n")
    got = {r.path for r in tables.read_path_list(spark, str(tmp_path / "list.txt"), root="/data/top").collect()}
    assert got == {"a/b.md", "c.md"}


def test_tree_reports_odd_names(spark, tmp_path):
    (tmp_path / "ok.txt").write_text("x")
    with open(os.fsencode(str(tmp_path)) + b"/bad\xff.txt", "wb") as fh:
        fh.write(b"x")
    got = {r.path: r.read_error for r in tree.list_tree(spark, str(tmp_path)).collect()}
    assert got == {"ok.txt": None, "bad\\xff.txt": "stat:name is not UTF-8"}
