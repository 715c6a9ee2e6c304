import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from sharegate.llm import line_keep

SPACE = " \t\n\x0b\x0c\r"


def _key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def _brute(rows, least_chars=40, least_docs=5):
    """[(id, n_lines, n_dropped, kept text)] of [(id, text)]."""
    rank = lambda i: (i is not None, i or 0)
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(_key(line)) >= least_chars:
                holders[_key(line)].add(rank(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders[_key(x)]) < least_docs or max(holders[_key(x)]) == rank(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def _got(df, **limits):
    return Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_keep.without_repeated_lines(df, **limits).collect())


@pytest.mark.parametrize("piece_rows", [7, 250_000])
def test_lines_equal_brute_force(spark, piece_rows):
    """Few lines in many documents, so that keys run over several pieces."""
    rng = random.Random(3)
    pool = [f"line {k} " + "Ä" * 33 + " end" for k in range(12)] + ["x" * 39, "x" * 40, "É" * 40, "é" * 40, ""]
    rows = []
    for i in range(60):
        lines = [rng.choice(pool[:2] if rng.random() < 0.4 else pool) for _ in range(rng.randrange(9))]
        rows.append((i // 2 if i < 8 else i, "\n".join(rng.choice(["", "\t ", "\r"]) + (x.upper() if x.isascii() and rng.random() < 0.5 else x) + rng.choice(["", " \x0b\x0c"]) for x in lines)))
    rows += [rows[3], rows[20]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert _got(df, piece_rows=piece_rows) == Counter(_brute(rows)) and any(r[2] for r in _brute(rows))


def test_line_edges(spark, make_docs):
    line = "a line that many documents have in common, word for word"
    rows = [(k, f"{line}\n own {k}", "a") for k in range(4)] + [(9, f"{line}\n{line} \nz", "a"), (9, f"{line}\n{line} \nz", "a"), (9, "z", None), (None, f" {line.upper()}", None),
            (None, None, None), (5, "", "b"), (6, None, "b"), (7, "\n" * 5000 + line, "b"), (8, ("w " * 20 + "\n") * 20_000, "c"), (10, "x" * 3_000_000, "c")]
    docs = make_docs(rows)
    out = line_keep.without_repeated_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped", "kept_text"]
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in out.collect()) == Counter(_brute([(i, t) for i, t, _ in rows]))
    assert line_keep.without_repeated_lines(docs.limit(0)).collect() == []
    clash = docs.withColumnsRenamed({"lang": "n_lines", "node": "keep", "source": "pos"})
    assert _got(clash) == Counter(_brute([(i, t) for i, t, _ in rows]))


def test_bitmaps_are_whole_and_small(spark):
    line = "a line that many documents have in common, word for word"
    df = spark.createDataFrame([(k, f"{line}\n" * 4000 + "end") for k in range(6)], "doc_id long, text string")
    maps = {r.doc: r for r in line_keep.keep_bitmaps(df).collect()}
    assert set(maps) == {0, 1, 2, 3, 4}  # the largest id keeps its lines and has no bitmap
    assert all(r.n_lines == 4001 and r.n_dropped == 4000 and len(r.keep) < 40 for r in maps.values())
    assert np.flatnonzero(line_keep.unpack_bits(maps[0].keep, 4001)).tolist() == [4000]


def test_a_key_over_many_pieces_counts_documents_once(spark):
    """Four documents with thousands of copies of a line keep them, however the pieces cut them."""
    line = "a line that many documents have in common, word for word"
    four = [(k, f"{line}\n" * 50) for k in range(4)]
    assert _got(spark.createDataFrame(four, "doc_id long, text string"), piece_rows=9) == Counter(_brute(four))
    five = [*four, (4, line)]
    assert _got(spark.createDataFrame(five, "doc_id long, text string"), piece_rows=9) == Counter(_brute(five))
