import os
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from sharegate.llm import queries, spelling

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ALPHABET = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


def _counts(rows):
    """Every run letter by letter, as the contract words it."""
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1:]
            found[word] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def _edits(w):
    out = {w[:i] + w[i + 1:] for i in range(len(w))}
    out |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in ALPHABET}
    out |= {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in ALPHABET}
    return out - {w}


def _brute(counts):
    near, form = {}, {}
    for w, n in counts.items():
        near[w] = [v for v in _edits(w) if v in counts]
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, n, form[w], counts[form[w]] if form[w] else None, len(near[w]), root))
    return out


def _got(df, **limits):
    rows = df.collect() if "root" in df.columns else spelling.variants(df, **limits).collect()
    return {(r.word, r.n, r.form, r.form_n, r.n_near, r.root) for r in rows}


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = _brute(_counts(rows))
    assert _got(queries.op11_spelling_variants(spark, SF)) == want
    assert any(r[2] for r in want) and any(r[4] > 1 for r in want)


@pytest.mark.parametrize("crowd", [1, 3, 64])
def test_crowded_places_lose_no_pair(spark, crowd):
    """Words around one centre and words with a common half, edits everywhere, runs of equal letters, several lengths."""
    rng = random.Random(4)
    words = set()
    for base in ("banana" * 2, "aaaaaaaaa", "überströmt", "international"):
        for _ in range(70):
            w = base
            for _ in range(rng.choice([0, 1, 1, 2])):
                at = rng.randrange(len(w) + 1)
                w = w[:at] + rng.choice(["", "a", "b", "é"]) + w[at + rng.randrange(2):]
            words.add(w)
        words |= {base[: len(base) // 2] + "".join(rng.choices("abn", k=5)) for _ in range(60)}
    words = sorted(words)
    number = {w: i for i, w in enumerate(words)}
    near = {(i, number[v]) for i, w in enumerate(words) for v in _edits(w) & set(words)}
    df = spark.createDataFrame(list(enumerate(words)), "id long, word string")
    got = [(r.a, r.b) for r in spelling.near_words(df, crowd=crowd).collect()]
    assert len(got) == len(set(got)) and set(got) == near and len(near) > 400


def test_forms_ties_and_chains(spark):
    texts = ["letters " * 200, "lettors " * 20, "lettirs " * 2, "lettars " * 2, "candles bandles " * 30, "sandles " * 3, "shorter " * 2, "a " * 5]
    rows = [(1, t) for t in texts]  # one id: a word slips everywhere or nowhere
    got = _got(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == _brute(_counts(rows))
    by = {r[0]: r for r in got}
    assert by["sandles"][2] == "bandles" and by["lettars"][5] == "letters"


def test_spelling_edges(spark, edge_docs, make_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    assert _got(edge_docs) == _brute(_counts(rows))
    assert spelling.variants(edge_docs.limit(0)).collect() == []
    long = "x" * 70_000
    rows = [(k, t) for k in (3, None) for t in ("STRASSEN Straßen ÉCOLES écoles ××××××× a1b", f"{long} {long}y", None, "")] * 2
    docs = make_docs([(i, t, "a") for i, t in rows]).withColumnsRenamed({"lang": "word", "node": "n", "part": "id"})
    got = _got(docs)
    want = _counts(rows)
    assert {(r[0], r[1]) for r in got} == set(want.items()) and {r[4] for r in got if len(r[0]) > 69_000} == {1}
