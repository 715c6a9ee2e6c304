"""Streams over a table that is a folder of part files, as Spark writes it, or one file."""

from collections import Counter

import pytest

from sharegate.plans import queries

MESSAGES = [(c, t, ("system", "user", "assistant")[t % 3], None if c == 7 and t == 1 else f"message {t}") for c in range(12) for t in range(5)]


@pytest.fixture(params=["folder", "file"])
def tables(request, spark, tmp_path):
    rows = spark.createDataFrame(MESSAGES, "conv_id long, turn int, role string, text string")
    rows.repartition(4).write.parquet(f"{tmp_path}/conversations.parquet" if request.param == "folder" else f"{tmp_path}/parts")
    if request.param == "file":
        import pyarrow.parquet as pq
        pq.write_table(pq.read_table(f"{tmp_path}/parts"), f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def _decisions(spark, sf):
    """The batch gate over the same rows."""
    from sharegate.plans import corpus
    from sharegate.streaming.gate import gate_stream
    return gate_stream(corpus.load(spark, sf, corpus.CONVERSATIONS, "conversations")).collect()


def test_gate_reads_the_whole_table(spark, tables):
    got = Counter((r.share_id, r.path, r.decision) for r in queries.stream_gate(spark, tables).collect())
    assert got == Counter((r.share_id, r.path, r.rule or "INCLUDE") for r in _decisions(spark, tables)) and sum(got.values()) == len(MESSAGES)


def test_rollup_reads_the_whole_table(spark, tables):
    got = {(r.conv_id, r.rule): r.n for r in queries.stream_rule_rollup(spark, tables).collect()}
    want = Counter((int(r.path.split("/")[1]), r.rule) for r in _decisions(spark, tables) if r.rule)
    assert got == dict(want) and want[7, "OPS-UNREADABLE"] == 1


def test_rollup_of_any_conversation_id(spark, tmp_path):
    """Ids beyond the hours that a timestamp can count, below 0, and in the same hour; turns beyond an hour's seconds."""
    ids = [3, 3 + queries.HOURS, 3_000_000_000, 1 << 40, 1 << 62, -(1 << 62), -7]
    rows = [(c, t, "user", None if t != 1 else "fine") for c in ids for t in (0, 1, 5000)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((r.conv_id, r.rule, r.n) for r in queries.stream_rule_rollup(spark, str(tmp_path)).where("rule = 'OPS-UNREADABLE'").collect())
    assert got == [(c, "OPS-UNREADABLE", 2) for c in sorted(ids)]
