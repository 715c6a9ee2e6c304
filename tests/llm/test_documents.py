import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sharegate.llm import dartminhash, edit_sketch, packing, queries, token_files, tokenize
from sharegate.llm.common import shared_folder

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
words = re.compile(r"[^\x20\x09-\x0D]+").findall


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


def ids_of(text):
    from tokenizers import Tokenizer
    if not hasattr(ids_of, "t"):
        ids_of.t = Tokenizer.from_file(tokenize.default_path())
    return np.array(ids_of.t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")


# -- tokens -------------------------------------------------------------------

@pytest.mark.parametrize("text", ["", None, "a", " a", "a ", "a  b", "a\nb", "a\n\nb", "a\tb c", "it's  'll we'll. x", "...!! a.b,c. 12.5% é. x y z", "\n", " ", "\x1cx y", "漢字。 x²! 5th. don't."])
def test_word_cache_is_exact(text):
    encoder = tokenize.Encoder(tokenize.default_path())
    for _ in range(2):
        assert encoder.ids(text) == ids_of(text).tobytes()


def test_added_tokens_in_a_text_keep_their_ids():
    encoder = tokenize.Encoder(tokenize.default_path())
    assert encoder.added
    for token in encoder.added:
        for text in (token, f"a {token} b", f"a{token}b c\n{token}", f"{token[:-1]} {token}{token} x"):
            assert encoder.ids(text) == ids_of(text).tobytes()


@pytest.mark.parametrize("slice_bytes, stems", [(1 << 20, 1 << 20), (200, 20), (1, 0)])
def test_texts_encoded_together_keep_their_ids(monkeypatch, slice_bytes, stems):
    """Slices of many texts and of one, with stems remembered and forgotten."""
    import random

    import pyarrow as pa
    monkeypatch.setattr(tokenize, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(tokenize, "MOST_STEMS", stems)
    monkeypatch.setattr(tokenize, "GROUP", 3)
    encoder, rng = tokenize.Encoder(tokenize.default_path()), random.Random(7)
    parts = ["word", "Éclair", "naïve", "漢字", "Ġx", "it's", "'ll", "'", "x'.", "end.", "a,b", "...", "$5", "e\u0301", "x\u0301,", "12.5%", "²", "_a_", "a_", "🙂!", "\u0120", "ªº.", "ǅ", "ʰ;", "Ⅷ",
             "\x1c", "\xa0", "\t", "", "\u2028", encoder.added[0], encoder.added[0] + "."]
    texts = [None, "", *((" " if rng.random() < 0.7 else "\n").join(rng.choices(parts, weights=[9] * 25 + [0.1] * (len(parts) - 25), k=rng.randint(1, 30))) for _ in range(500))]
    for kind in (pa.string(), pa.large_string()):
        got = list(encoder.each(pa.array(["cut off", *texts], kind)[1:]))
        assert [x for x, t in zip(got, texts, strict=True) if x != ids_of(t).tobytes()] == []
    assert list(encoder.each(pa.array([], pa.string()))) == []


def test_a_stem_is_merged_once(monkeypatch):
    """Whatever marks follow it, in one text or in later ones."""
    import pyarrow as pa
    encoder, seen, joined = tokenize.Encoder(tokenize.default_path()), [], tokenize.Encoder._joined
    monkeypatch.setattr(tokenize.Encoder, "_joined", lambda self, words, *a: seen.extend(words.to_pylist()) or joined(self, words, *a))
    for texts in (["a stem, stem! a stem", "the stem$$$ a"], ["the stem (x) stem"]):
        assert list(encoder.each(pa.array(texts))) == [ids_of(t).tobytes() for t in texts]
    assert sorted(seen) == ["(x)", "a", "stem"]


@pytest.mark.parametrize("top", [1, 200, 50_000, 1 << 30, (1 << 60) - 1, (1 << 64) - 1])
def test_simple8b_round_trip(top):
    rng = np.random.default_rng(top % 97)
    for n in (0, 1, 59, 60, 61, 4095, 4096, 4097, 9000):
        ids = rng.integers(0, top, n, dtype=np.uint64, endpoint=True)
        ids[rng.random(n) < 0.5] &= np.uint64(3)
        coded, offsets = token_files.encode(ids)
        assert (token_files.decode(coded) == ids).all() and len(offsets) == -(-n // 4096)
        for a, b in ((0, n), (n // 3, n // 2), (n - 1, n)):
            if 0 <= a < b:
                assert (token_files.read_ids(coded.tobytes(), offsets, n, a, b) == ids[a:b]).all()


def test_token_files_query(spark, documents):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op2_token_files(spark, SF).collect()}
    start = 0
    for i, text in documents:
        ids = ids_of(text)
        assert got[i] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(documents)


def test_token_files_edges(spark, edge_docs):
    for docs in (edge_docs, edge_docs.limit(0)):
        path = shared_folder(spark)
        token_files.write_token_file(docs, path)
        got = token_files.read_token_file(spark, path).orderBy("start").collect()
        want = sorted(((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "") for r in docs.collect()))
        start = 0
        for r, (_, _, _, text) in zip(got, want, strict=True):
            assert r.start == start and bytes(r.ids) == ids_of(text).tobytes()
            start += r.n_tokens


# -- packing --------------------------------------------------------------------

def _check_packing(rows, capacity):
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for placed in seqs.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seqs)


def test_packing_query(spark, documents):
    rows = queries.op1_best_fit_packing(spark, SF).collect()
    n = _check_packing(rows, 1024)
    want = {}
    for i, text in documents:
        ids = ids_of(text)
        start, piece, size = 0, 0, len(ids) % 1024 or min(1024, len(ids))
        while start < len(ids):
            want[i, piece] = (start, size, zlib.crc32(ids[start:start + size].tobytes()))
            start, piece, size = start + size, piece + 1, 1024
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    assert n <= 1.02 * -(-sum(r.length for r in rows) // 1024) + 1


def test_packing_edges(spark, edge_docs):
    pieces = packing.token_pieces(edge_docs)
    rows = packing.pack(pieces).collect()
    assert len(rows) == pieces.count()
    _check_packing(rows, 1024)
    assert packing.pack(pieces.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a", 1, 1), (0, "b", 2, 2), (7, "c", 3, 3)] * 3, "length int, item string, shard int, offset int")
    assert packing.pack(odd, capacity=10).count() == 9
    with pytest.raises(ValueError):
        packing.pack(odd, capacity=5)


def test_evolution_finds_what_decreasing_best_fit_misses():
    sizes = [44, 24, 24, 22, 21, 17, 8, 8, 6, 6] * 3 + [36, 36, 28] * 2  # best fit decreasing leaves gaps
    down = len(packing.best_fit([], [], sorted(range(len(sizes)), key=lambda i: -sizes[i]), sizes, 60)[0])
    best = packing.evolve(sizes, [], 60, "seed", generations=60)
    found = packing._bins(best[0])
    assert sorted(i for b in found for i in b) == list(range(len(sizes))) and max(sum(sizes[i] for i in b) for b in found) <= 60
    assert len(found) <= down


def test_production_parameters_beat_decreasing_best_fit():
    rng = random.Random(1)
    sizes = [rng.randrange(200, 600) for _ in range(2000)]
    down = len(packing.best_fit([], [], sorted(range(2000), key=lambda i: -sizes[i]), sizes, 1024)[0])
    people = [[] for _ in range(packing.ISLANDS)]
    for epoch in range(packing.EPOCHS):
        if epoch:
            people = [list(dict.fromkeys(p + people[k - 1][:1])) for k, p in enumerate(people)]
        people = [packing.evolve(sizes, p, 1024, f"s/{k}/{epoch}") for k, p in enumerate(people)]
    assert down == 801 and min(len(packing._bins(p[0])) for p in people) <= 799  # 800 with 2 islands, 3 generations, population 3


def test_crossover_keeps_every_item_once():
    rng = random.Random(1)
    sizes = [rng.randrange(1, 100) for _ in range(300)]
    a, b = (packing.best_fit([], [], rng.sample(range(300), 300), sizes, 128) for _ in range(2))
    child = packing.crossover(a, b, sizes, 128, rng)
    assert sorted(i for x in child[0] for i in x) == list(range(300)) and max(child[1]) <= 128
    assert child[1] == [sum(sizes[i] for i in x) for x in child[0]]


# -- near duplicates ---------------------------------------------------------------

def _classes(docs):
    """Smallest id of each connected class of pairs at 4/5, by an inverted list."""
    sets, inverted, parent = {}, defaultdict(list), {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, text in docs:
        w = words(text or "")
        s = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        common = defaultdict(int)
        for g in s:
            for j in inverted[g]:
                common[j] += 1
            inverted[g].append(i)
        sets[i] = s
        for j, n in common.items():
            if 9 * n >= 4 * (len(s) + len(sets[j])):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in docs}


def test_near_duplicates_equal_all_pairs(spark, documents):
    got = {r.doc_id: r.class_id for r in queries.op6_near_duplicates(spark, SF).collect()}
    assert got == _classes(documents)


def test_near_duplicates_in_crowds(make_docs):
    """A large group of near copies, many texts that share a passage, and near copies among those."""
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(5000)]
    base = rng.choices(vocabulary, k=200)
    passage = rng.choices(vocabulary, k=60)
    rows = []
    for i in range(120):
        w = list(base)
        w[rng.randrange(200)] = f"new{i}"
        rows.append((i, " ".join(w), "a"))
    for i in range(120, 300):
        w = passage + rng.choices(vocabulary, k=90)
        rows.append((i, " ".join(w), "a"))
        if i % 6 == 0:
            w[-1] = "other"
            rows.append((1000 + i, " ".join(w), "a"))
    docs = make_docs(rows)
    got = {r.doc_id: r.class_id for r in dartminhash.near_duplicates(docs).collect()}
    assert got == _classes([(i, t) for i, t, _ in rows])
    kept = dartminhash.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))


def test_near_duplicates_in_a_template_crowd(make_docs):
    """Texts of one template at 0.67 to each other, and planted pairs at 0.8 to 0.85 among them."""
    rng = random.Random(4)
    template, fresh = [f"t{i}" for i in range(200)], iter(range(10**9))
    own = lambda n: [f"o{next(fresh)}" for _ in range(n)]
    rows = [(i, " ".join(template + own(50)), "a") for i in range(3000)]
    for k in range(12):
        shared = own(20 + 2 * k)
        rows += [(5000 + 2 * k + j, " ".join(template + shared + own(26)), "a") for j in range(2)]
    rng.shuffle(rows)
    got = {r.doc_id: r.class_id for r in dartminhash.near_duplicates(make_docs(rows)).collect()}
    assert got == {i: 5000 + (i - 5000) // 2 * 2 if i >= 5000 else i for i, _, _ in rows}


def test_counted_near_duplicates_equal_all_pairs_of_bags(make_docs):
    rng = random.Random(11)
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for _ in range(12):
        own, line = some(60), some(30)
        for times in (1, 2, 3, 8, 9, 10, 12, 40):  # the same set of shingles but for the seams, other counts
            rows.append((len(rows), " ".join(own + line * times)))
        rows.append((len(rows), " ".join(some(3) + own + line * 9)))
    rows += [(len(rows), "a " * 5000), (len(rows) + 1, "a " * 4500), (len(rows) + 2, "a " * 3000), (len(rows) + 3, None)]
    bags = {}
    for i, text in rows:
        w = words(text or "")
        bags[i] = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    group = {i: i for i, _ in rows}
    for i, a in bags.items():
        for j, b in bags.items():
            if j < i and a and 5 * (a & b).total() >= 4 * (a | b).total() and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    docs = make_docs([(i, t, "s") for i, t in rows])
    got = {r.doc_id: r.class_id for r in dartminhash.near_duplicates(docs, counted=True).collect()}
    assert got == group and len(set(group.values())) > 40
    plain = {r.doc_id: r.class_id for r in dartminhash.near_duplicates(docs).collect()}
    assert plain == _classes(rows) and len(set(plain.values())) < len(set(group.values()))


def test_weighted_elements():
    values, lengths = np.array([7, 3, 7, 7, 3, 5], np.uint64), np.array([4, 0, 2])
    elements, sizes, weights = dartminhash.weighted_elements(values, lengths)
    assert elements.tolist() == [3, 7, 3, 5] and sizes.tolist() == [2, 0, 2] and weights.tolist() == [1, 3, 1, 1]
    bag = dartminhash.bag_as_set(values, lengths)
    assert bag[[0, 1, 4, 5]].tolist() == [3, 7, 3, 5] and len(set(bag[:4].tolist())) == 4
    assert set(dartminhash.bag_as_set(np.array([7, 7], np.uint64), np.array([2])).tolist()) < set(bag[:4].tolist())


def test_prefix_pairs_hold_every_similar_pair(spark):
    rng = random.Random(6)
    sets = []
    for _ in range(150):
        base = sets[rng.randrange(len(sets))] if sets and rng.random() < 0.8 else set(range(rng.randrange(40)))
        sets.append({x for x in base if rng.random() < 0.93} | {rng.randrange(400) for _ in range(rng.randrange(1, 5))})
    want = {(a, b) for a in range(150) for b in range(a + 1, 150) if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))}
    df = spark.createDataFrame([(i, i, sorted(s)) for i, s in enumerate(sets)], "nid long, label long, s array<bigint>")
    got = {(r.a, r.b) for r in dartminhash.prefix_pairs(df).collect()}
    assert want and want <= got


def test_near_duplicates_edges(edge_docs):
    rows = dartminhash.near_duplicates(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add(r.class_id)
    assert by[1] == {1} and by[2] == {1} and by[3] == {3} and by[4] == {4} and by[5] == {5} and by[None] == {1, None}
    kept = [(r.doc_id, r.text) for r in dartminhash.keep_first(edge_docs).collect()]
    assert sorted(i for i, _ in kept if i is not None) == [1, 3, 4, 5, 6, 6, 7, 8, 9] and (None, None) in kept and len(kept) == 10
    assert dartminhash.near_duplicates(edge_docs.limit(0)).count() == 0 and dartminhash.keep_first(edge_docs.limit(0)).count() == 0


def test_signatures_follow_weighted_similarity():
    rng = np.random.default_rng(3)
    e = rng.integers(1, 1 << 63, 400).astype(np.uint64)
    a, b = rng.integers(1, 5, 400) * 0.5, rng.integers(1, 5, 400) * 0.5
    sig = dartminhash.signatures(np.concatenate([e, e]), np.array([400, 400]), 2000, np.concatenate([a, b]))
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04 and np.isfinite(sig).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (100, 300), (300, 400)]
    got = {r.node: r.label for r in dartminhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100, 400: 100}


# -- fingerprints ---------------------------------------------------------------------

def _walked(text):
    """The walk, one step at a time."""
    if not text:
        return np.zeros(edit_sketch.SAMPLES, np.uint8)
    moves = np.random.default_rng(1).integers(0, 2, (edit_sketch.CLASSES, edit_sketch.PERIOD), dtype=np.int8)
    h = edit_sketch._class_of(np.array([ord(c) for c in text], np.uint32))
    kind, value = ((h >> np.uint64(40)) % np.uint64(edit_sketch.CLASSES)).astype(int), (1 + (h >> np.uint64(20)) % np.uint64(255)).astype(int)
    shown, i = [], 0
    while i < len(text):
        shown.append(value[i])
        i += int(moves[kind[i], len(shown) - 1 & edit_sketch.PERIOD - 1])
    return np.array([shown[max(x for x in r if x < len(shown))] for r in edit_sketch.walk().records], np.uint8)


def test_fingerprints_are_the_walk():
    texts = ["", "a", "abc", "hello world " * 300, "é漢\n" * 500, "b" * 5000]
    prints = edit_sketch.walk().fingerprints(texts)
    for text, fingerprint in zip(texts, prints, strict=True):
        assert (fingerprint == _walked(text)).all()


def test_likeness_falls_with_edits():
    rng = random.Random(5)
    base = "".join(rng.choices("abcdefghijkl mnop", k=4000))
    near = base[:700] + "zz" + base[705:2500] + "q" + base[2500:]
    far = "".join(rng.choices("abcdefghijkl mnop", k=4000))
    a, b, c = edit_sketch.walk().fingerprints([base, near, far])
    assert (a == b).mean() > 0.75 and (a == c).mean() < 0.25


def _plain_walk(text):
    """The walk step by step: which character it is on at each step, then the sampled ones."""
    w = edit_sketch.walk()
    if not text:
        return bytes(128)
    mixed = [int(x) for x in edit_sketch._class_of(np.array([ord(c) for c in text], np.uint32))]
    stay = w.stay.reshape(edit_sketch.CLASSES, edit_sketch.PERIOD)
    at, starts = 0, []
    for x in mixed:
        starts.append(at)
        at += int(stay[(x >> 40) % edit_sketch.CLASSES, at % edit_sketch.PERIOD])
    out = []
    for r in w.records:
        step = max(int(s) for s in r if s < at)
        k = max(i for i, s in enumerate(starts) if s <= step)
        out.append(1 + (mixed[k] >> 20) % 255)
    return bytes(out)


def test_band_pairs_miss_no_pair():
    pairs = edit_sketch.band_pairs(0.8)
    assert len(pairs) == 70
    rng = random.Random(3)
    for _ in range(3000):
        bad = {x // 4 for x in rng.sample(range(128), 25)} if rng.random() < 0.5 else set(rng.sample(range(32), 25))
        assert any(a not in bad and b not in bad for a, b in pairs)


def test_null_ids_have_classes(spark, make_docs):
    text = "the same words in every row, " * 30
    rows = edit_sketch.with_classes(edit_sketch.with_next_edit(make_docs([(None, text, "a"), (5, text + "x", "a"), (None, "another text altogether " * 20, "a")]))).collect()
    assert {(r.doc_id, r.n_chars, r.class_id) for r in rows} == {(None, len(text), 5), (5, len(text) + 1, 5), (None, 480, None)}


def test_fingerprint_query(spark, documents):
    import hashlib
    got = {r.doc_id: r for r in queries.op5_edit_fingerprints(spark, SF).collect()}
    assert len(got) == len(documents)
    for k, (i, text) in enumerate(documents):
        edited = edit_sketch.edited(text or "", documents[(k + 1) % len(documents)][1] or "")
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(text or "")
        own, near, after = (_plain_walk(t) for t in (text or "", edited, documents[(k + 1) % len(documents)][1] or "")) if k % 20 == 0 else (None,) * 3
        if own is not None:
            assert (got[i].fingerprint, got[i].edited_fingerprint) == (own.hex(), near.hex())
            assert got[i].near_edited == sum(a == b for a, b in zip(own, near)) / 128 and got[i].near_next == sum(a == b for a, b in zip(own, after)) / 128
        assert 0 <= got[i].near_next <= 1 and 0 <= got[i].near_edited <= 1


def test_fingerprint_edges(edge_docs):
    rows = edit_sketch.with_next_edit(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    assert edit_sketch.with_next_edit(edge_docs.limit(0)).count() == 0
    one = edit_sketch.with_next_edit(edge_docs.where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    classes = defaultdict(set)
    for r in edit_sketch.near_classes(edge_docs.where("doc_id IS NOT NULL")).collect():
        classes[r.class_id].add(r.doc_id)
    assert {1, 2} <= classes[1] and 7 not in classes[1]


def _print_classes(rows):
    """Smallest id of each connected class of all pairs of fingerprints."""
    prints = np.stack([p for _, p in rows])
    near, label = [(prints == p).mean(axis=1) >= 0.8 for p in prints], list(range(len(rows)))
    while True:
        now = [min(label[j] for j in np.flatnonzero(near[i])) for i in range(len(rows))]
        if now == label:
            return {i: min(rows[j][0] for j in range(len(rows)) if label[j] == label[k]) for k, (i, _) in enumerate(rows)}
        label = now


def test_classes_of_fingerprints_equal_all_pairs(spark):
    """A crowd around one fingerprint, and pairs among it that differ in 25 samples."""
    rng = np.random.default_rng(8)
    base, prints = rng.integers(0, 256, 128).astype(np.uint8), []

    def changed(p, n):
        p, at = p.copy(), rng.choice(128, n, replace=False)
        p[at] ^= rng.integers(1, 256, n).astype(np.uint8)
        return p

    for k in range(300):
        prints.append(changed(base, 35))
        if k % 6 == 0:
            prints.append(changed(prints[-1], 25))
    rows = list(enumerate(prints))
    df = spark.createDataFrame([(i, bytearray(p.tobytes())) for i, p in rows], "doc_id long, fingerprint binary")
    by = {bytes(r.fingerprint): r.class_id for r in edit_sketch.print_classes(df).collect()}
    assert {i: by[p.tobytes()] for i, p in rows} == _print_classes(rows)


def test_fingerprint_query_has_classes(spark):
    rows = queries.op5_edit_fingerprints(spark, SF).collect()
    assert {r.doc_id: r.class_id for r in rows} == _print_classes([(r.doc_id, np.frombuffer(bytes.fromhex(r.fingerprint), np.uint8)) for r in rows])
