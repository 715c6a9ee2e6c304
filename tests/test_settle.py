"""Scan once, settle late: settings and ignore decisions meet narrow rows."""

import fnmatch
import random
import re

import pytest
from pyspark.sql import functions as F

from sharegate.functions.paths import glob_match, glob_parts
from sharegate.operators import ignore
from sharegate.operators.classify import classify, classify_many, policy_diff
from sharegate.operators.ignore import gather_ignore_rules, ignore_decisions, mark_ignored, with_literal_decisions, literal_sets
from sharegate.operators.settings import DENY_TABLE, deny_rows
from sharegate.plans import queries as Q
from sharegate.policy import ShareSettings
from sharegate.sources.tables import overrides_from_json
from sharegate.sources.tree import list_tree, read_share

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _content_below_exchange(df) -> bool:
    """Does any exchange or join in the physical plan have a content column among its rows?"""
    lines = _physical(df).split("\n")
    return any(re.search(r"(Exchange|Join)", line) and re.search(r"\b(content|text|_text|html)#", line) for line in lines)


def _jobs(spark, run):
    tracker, group = spark.sparkContext.statusTracker(), f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(group, "count")
    try:
        out = run()
        return out, len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setJobGroup("tests", "")


def test_globs_as_data_equal_fnmatch(spark):
    rng = random.Random(1)
    names = ["", "a", "ab.txt", "a.b.c", "client_secret.json", "id-7", "a]b", "a^b", "äöü.md", "aaaa", "-x", "[a]", "x" * 200]
    names += ["".join(rng.choices("ab.-1", k=rng.randrange(8))) for _ in range(60)]
    globs = ["", "*", "**", "*.txt", "a*", "*b*", "a*b*c", "?", "??*", "*[0-9]", "[!a]*", "*[a-b]?*.c", "a[b", "[]]*", "a]b", "[!]]*", "*ä*", "[ä-ü]*", "*aa*aa", "[-x]*", "*-", "id-[5-9]", "[[]a]", "a^b"]
    globs += ["".join(rng.choices(["a", "b", "*", "?", ".", "[ab]", "[!1]", "1"], k=rng.randrange(1, 7))) for _ in range(80)]
    table = spark.createDataFrame([(d["glob"], d["parts"]) for d in deny_rows(globs)], f"glob string, parts {DENY_TABLE[DENY_TABLE.index('parts:') + 6:-2]}")
    got = spark.createDataFrame([(n,) for n in names], "n string").crossJoin(table).select("n", "glob", glob_match(F.col("n"), F.col("parts")).alias("m")).collect()
    for r in got:
        assert r.m == fnmatch.fnmatchcase(r.n, r.glob), (r.n, r.glob, glob_parts(r.glob))


@pytest.mark.parametrize("most", [0, 64 << 20])
def test_content_meets_no_join_and_no_shuffle(spark, monkeypatch, most):
    monkeypatch.setattr("sharegate.operators.joins.lookup_join.__kwdefaults__", {"spread_by": "path", "size": None, "max_bytes": most, "salts": 4})
    for query in (Q.per_share_overrides, Q.override_settings, Q.allow_unreadable):
        df = query(spark, SF)
        assert "Join" in _plan(df) and not _content_below_exchange(df)
    plan = _physical(Q.per_share_overrides(spark, SF))
    patterns = [m for m in re.findall(r"rlike\(([^)]*)\)|RLIKE ([^ )]*)", plan, re.I) if "_o#" in "".join(m) or ".regex" in "".join(m)]
    assert not patterns and ".regex" not in plan


def test_two_policies_take_one_scan(spark):
    assert _physical(Q.share_mode_diff(spark, SF)).count("FileScan parquet") == 1


def test_many_policies_equal_single_runs(make_files, spark):
    files = make_files({"a.md": "peer 10.1.2.3", "b.txt": "x@example.com, sam@example.com", "c.md": "plain", "src/d.py": "print(1)", "e.pem": "k", "logs/f.txt": "x", "g.bin": b"\0\1",
                        "h.md": "Copyright Sam sam@example.com"}, "one")
    policies = {"open": ShareSettings(), "closed": ShareSettings(share_mode="private", deny_globs=("C.*", "?.TXT"), exclude_folders=("SRC",)),
                "people": ShareSettings(pii=True, pii_allow=("x@example.com",), allow=("e.pem",), source_only=True),
                "authors": ShareSettings(pii=True, pii_skip_author=False, exclude_paths=("logs/",))}
    many = classify_many(files, policies)
    columns = [c for c in many.columns if c != "policy"]
    for name, settings in policies.items():
        want = sorted(map(repr, map(tuple, classify(files, settings).decisions.select(*columns).collect())))
        assert sorted(map(repr, map(tuple, many.where(F.col("policy") == name).select(*columns).collect()))) == want, name
    diff = {r.path: (r.decision_a, r.decision_b) for r in policy_diff(files, policies["open"], policies["closed"]).collect()}
    assert diff == {"a.md": ("LOC-RFC1918", "INCLUDE"), "b.txt": ("INCLUDE", "SEC-PATH-USER"), "c.md": ("INCLUDE", "SEC-PATH-USER"), "src/d.py": ("INCLUDE", None),
                    "logs/f.txt": ("INCLUDE", "SEC-PATH-USER")}
    with pytest.raises(ValueError):
        classify_many(files, {"a": ShareSettings(), "b": ShareSettings(focus="src")})


# -- ignore decisions ------------------------------------------------------------

TREE = {".gitignore": "*.log\nout/\n!keep.log\n/top.txt\n", "a.log": "1", "keep.log": "1", "top.txt": "1", "sub/top.txt": "1", "sub/.gitignore": "keep.log\n!out/\n*.tmp\n",
        "sub/keep.log": "1", "sub/x/b.tmp": "1", "out/deep/er/f.txt": "1", "sub/out/g.txt": "1", "sub/h.txt": "1", ".git/.gitignore": "*\n", "sub/x/.gitignore": "!b.tmp\nz\n", "sub/x/z/q.txt": "1"}


@pytest.mark.parametrize("walk, depth", [(True, 0), (True, 1), (False, 0)])
def test_literal_rules_equal_joins(make_files, spark, walk, depth):
    files = make_files(TREE, "one").unionByName(make_files({k: v for k, v in TREE.items() if not k.startswith("sub/x")}, "two")).unionByName(make_files({"a.log": "1"}, "none"))
    rules = gather_ignore_rules(files)
    joined = {(r.share_id, r.path): (r.ign_file, r.ign_depth) for r in ignore_decisions(files, rules, walk=walk, min_depth=depth).collect()}
    literal = {(r.share_id, r.path): (r.ign_file, r.ign_depth) for r in with_literal_decisions(files, literal_sets(rules), walk=walk, min_depth=depth).collect()}
    assert {k: v for k, v in literal.items() if v != (False, None)} == joined and ("one", "a.log") in joined
    both = [{(r.share_id, r.path): (r.ign_file, r.ign_depth) for r in mark_ignored(files.drop("content"), rules, walk=walk, min_depth=depth, most=m).collect()} for m in (0, 1000)]
    assert both[0] == both[1] == literal


def test_both_ways_decide_alike(make_files, monkeypatch):
    files = make_files(TREE, "one")
    got = []
    for most in (1000, 0):
        monkeypatch.setattr("sharegate.operators.ignore.literal_sets.__defaults__", (most,))
        got.append(sorted(map(repr, classify(files, ignore_rules=gather_ignore_rules(files)).decisions.collect())))
    assert got[0] == got[1]


def test_few_jobs_before_the_result(spark):
    files = Q._files(spark, SF, Q.K.TREE_WITH_IGNORES)
    _, n = _jobs(spark, lambda: classify(files, Q.TEXTS, ignore_rules=gather_ignore_rules(files)))
    assert 0 < n < 6
    _, n = _jobs(spark, lambda: Q.ignore_decisions(spark, SF))
    assert n < 6


def test_ignored_files_are_not_read(spark, tmp_path):
    for path, body in {".gitignore": "*.log\nbig/\n", "a.log": "x", "b.txt": "y", "big/c.txt": "z", "d.log": "w", ".extra": "b.txt\n"}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(body)
    (tmp_path / "a.log").chmod(0)
    settings = ShareSettings(allow=("d.log",))
    files = read_share(list_tree(spark, str(tmp_path), "s"), str(tmp_path), settings)
    got = {r.path: r.content for r in files.collect()}
    assert got["a.log"] is None and got["big/c.txt"] is None and got["d.log"] == b"w" and got["b.txt"] == b"y"
    rows = {r.path: (r.status, r.rule, r.prune_reason) for r in classify(files, settings).decisions.collect()}
    assert rows["a.log"] == ("excluded", "OPS-GITIGNORE", None) and rows["big/c.txt"] == ("pruned", None, "ignored-dir") and rows["d.log"][0] == "included"
    own = overrides_from_json(spark.createDataFrame([("s", '{"ignore_files": [".extra"], "allow": ["a.log"]}')], "share_id string, json string"))
    files = read_share(list_tree(spark, str(tmp_path), "s"), str(tmp_path), ShareSettings(), overrides=own)
    assert {r.path for r in files.where("content IS NULL").collect()} == {"big/c.txt", "b.txt", "d.log"}


def test_order_of_ignore_files(make_files, spark):
    """.gitignore, then those of the run, then those of the share; a share without ignore files has no rules."""
    tree = {".gitignore": "a.txt\nb.txt\nc.txt\n", ".run": "!b.txt\n!c.txt\nd.txt\n", ".own": "c.txt\n!d.txt\n", "a.txt": "1", "b.txt": "1", "c.txt": "1", "d.txt": "1"}
    files = make_files(tree, "one").unionByName(make_files(tree, "two")).unionByName(make_files(tree, "off"))
    own = overrides_from_json(spark.createDataFrame([("one", '{"ignore_files": [".own"]}'), ("off", '{"respect_gitignore": false, "ignore_files": [".own"]}')], "share_id string, json string"))
    settings = ShareSettings(ignore_files=(".run",))
    rules = gather_ignore_rules(files, settings.ignore_files, own)
    got = {(r.share_id, r.path) for r in classify(files, settings, overrides=own, ignore_rules=rules).decisions.where("rule = 'OPS-GITIGNORE'").collect()}
    assert got == {("one", "a.txt"), ("one", "c.txt"), ("two", "a.txt"), ("two", "d.txt")}
    assert ignore.ignore_files(files, settings.ignore_files, own).where("share_id = 'off'").count() == 0
