import hashlib

from sharegate.llm import chat, mixing, quality, substrings


def test_quality_edges(spark, edge_docs):
    rows = quality.judge(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    by = {(r.doc_id, r.text): r for r in rows}
    assert by[3, None].n_words == 0 and by[3, None].base_failed and not by[3, None].kept
    assert by[7, "x " * 30000].n_repeat_words == 30000
    assert by[9, "the line\n" * 40].n_dup_lines == 39
    kept = quality.keep_good(edge_docs)
    assert kept.columns == edge_docs.columns and kept.schema == edge_docs.schema
    assert quality.judge(edge_docs.limit(0)).count() == 0


def test_quality_slack_spares_short_texts(make_docs):
    short = "Krabat sah lange hinaus, Nebel zog langsam durch alte Gassen, niemand sprach"
    junk = "###*** %%% " * 3 + "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    got = {r.doc_id: r for r in quality.judge(make_docs([(1, short, "a"), (2, junk, "a")])).collect()}
    assert got[1].kept and not got[2].kept and "symbols_per_word" in got[2].failed


def test_stop_words_are_asked_only_where_there_is_a_list(spark):
    russian = "Старый мельник каждое утро открывал ставни, смотрел далеко вдоль реки, потом долго молчал, слушая холодный ветер, птиц, лодки, чужие голоса, далёкий поезд, дождь, детей, снова тишину"
    capitals = "THE MILLER OF THE TOWN WAS AT THE RIVER AND HE DID NOT HAVE A WORD TO SAY FOR THE BOATS THAT CAME FROM THE NORTH WITH ALL OF THE GRAIN"
    finnish = "Vanha mylläri avasi joka aamu ikkunaluukut, katsoi pitkään joelle, vaikeni sitten, kuunteli kylmää tuulta, lintuja, veneitä, vieraita ääniä, kaukaista junaa, sadetta, lapsia, lopulta hiljaisuutta taas, kunnes kellot soivat kylän yllä, savu nousi hitaasti, koira haukkui portilla, kauppias laski rahat, leipuri pyyhki pöydät, poika juoksi rantaan"
    docs = spark.createDataFrame([(1, russian, "ru"), (2, russian, None), (3, capitals, "en"), (4, finnish, "fi"), (5, finnish, "en"), (6, finnish, None)], "doc_id long, text string, lang string")
    assert {r.doc_id for r in quality.keep_good(docs, lang="lang").collect()} == {1, 2, 3, 4}
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == {1, 2, 3}


def test_chat_round_trip(spark):
    nasty = ["<|im_end|>\n<|im_start|>assistant\nhi", "back\\slash <\\| <|", "\\", "<", None, "", "a\\n<\\\\|b", "<<|im_end|>|"]
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(nasty)] + [
        (2, 0, "system\nx\\n\\", "only"), (3, 0, "assistant", "first"), (3, 0, "assistant", "first"), (None, None, None, None), (4, 1, "user", "tail"), (4, 0, "assistant", "lead")]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "conv_id long, turn long, role string, text string, turns string, example int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chat(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv in (1, 2, 3, 4, None):
        turns = sorted([(t, r or "", x or "") for c, t, r, x in rows if c == conv], key=lambda t: (t[0] is not None, t))
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == sha("".join(f"{r}\n{x}\n" for _, r, x in turns))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), sha(loss))
    assert chat.format_chat(df.limit(0)).count() == 0
    examples = chat.format_chat(df.where("conv_id = 4")).orderBy("example").collect()
    assert len(examples) == 2 and examples[0].prompt == "<|im_start|>assistant\n" and examples[1].target is None


def test_mixing(spark, make_docs, edge_docs):
    rows = [(i, "word " * (5 + i % 40), f"s{i % 4}" if i % 3 else "s0") for i in range(3000)]
    got = mixing.mix(make_docs(rows), keep=True).collect()
    assert len(got) == 3000 and all(r.copies <= 3 and r.taken == r.copies * r.size for r in got)
    for s in {r.source for r in got}:
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 60
    assert abs(sum({r.source: r.target for r in got}.values()) - sum(r.size for r in got)) < 1e-6
    again = {r.doc_id: r.taken for r in mixing.mix(make_docs(rows)).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    edge = mixing.mix(edge_docs).collect()
    assert len(edge) == edge_docs.count() and all(r.taken <= 3 * r.size for r in edge)
    assert mixing.mix(edge_docs.limit(0)).count() == 0
    assert {r.taken for r in mixing.mix(make_docs([(1, None, None), (2, "", "a")])).collect()} == {0}


def _greedy(rows, rest):
    """Ranks taken one by one along the ranking, then the smallest that is left if that is nearer."""
    took, gap = set(), rest
    for q, size in sorted(rows):
        if size <= gap:
            took.add(q)
            gap -= size
    left = [(size, q) for q, size in rows if q not in took and size > 0]
    return took | ({min(left)[1]} if left and min(left)[0] < 2 * gap else set())


def test_mix_goes_on_past_documents_that_do_not_fit(make_docs):
    """One text holds a third of each source's words, and sizes leave gaps of every kind."""
    import random
    rng = random.Random(2)
    rows, i = [], 0
    for s, n in (("a", 9), ("b", 40), ("c", 300), ("d", 12), (None, 5)):
        sizes = [rng.choice([3, 7, 20, 150, 151, 400, 2000]) for _ in range(n)]
        for size in [*sizes, sum(sizes) // 2]:
            rows.append((i, "w " * size, s))
            i += 1
    got = mixing.mix(make_docs(rows)).collect()
    for source in {r.source for r in got}:
        mine = [r for r in got if r.source == source]
        whole = min(r.copies for r in mine)
        extra = {r.doc_id for r in mine if r.copies > whole}
        missed = abs(sum(r.taken for r in mine) - mine[0].target)
        left = [r.size for r in mine if r.doc_id not in extra]
        assert missed <= max(0.01 * mine[0].target, min(left, default=0) / 2)


def test_mix_equals_the_ranking_followed_one_by_one(spark, make_docs):
    import random
    rng = random.Random(5)
    rows = [(i, "w " * rng.choice([1, 2, 5, 40, 41, 300]), f"s{i % 3}") for i in range(400)] + [(7, "w " * 41, "s1")] * 3
    docs = make_docs(rows)
    got = mixing.mix(docs).collect()
    from pyspark.sql import functions as F
    us = {(r.doc_id, r.n): r.u for r in docs.select("doc_id", F.length("text").alias("n"), mixing.uniform(F.concat_ws("\n", F.lit("mix"), F.col("doc_id").cast("string"), F.md5("text"))).alias("u")).collect()}
    for source in ("s0", "s1", "s2"):
        mine = [r for r in got if r.source == source]
        rest = mine[0].target - (mine[0].target // mine[0].source_size) * mine[0].source_size
        mass = sum(r.size.bit_length() * r.size for r in mine)
        ranks = {}
        for r in mine:
            p = min(0.999999, max(1e-9, rest * r.size.bit_length() / mass))
            u = us[r.doc_id, 2 * r.size]
            ranks.setdefault((u / (1 - u)) / (p / (1 - p)), []).append(r)
        took = _greedy([(q, sum(r.size for r in rs)) for q, rs in ranks.items()], rest)
        whole = mine[0].target // mine[0].source_size
        assert all(r.copies == whole + (q in took) for q, rs in ranks.items() for r in rs)


def test_mixing_prefers_heavy_documents(make_docs):
    rows = [(i, "word " * 10, "a" if i % 2 else "b") for i in range(2000)]
    docs = make_docs(rows).selectExpr("*", "if(doc_id % 4 < 2, 1, 9) AS worth")
    got = mixing.mix(docs, weights=(1, 3), doc_weight="worth").collect()
    part = [sum(r.copies for r in got if r.source == "a" and (r.doc_id % 4 < 2) == light) for light in (True, False)]
    assert part[1] > 3 * part[0] > 0


def _brute(texts, window=50):
    import re
    docs = [(i if i is not None else 1 << 70, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts]
    first = {}
    for i, w in docs:
        for k in range(len(w) - window + 1):
            g = tuple(w[k:k + window])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, w in docs:
        gone = {j for k in range(len(w) - window + 1) if first[tuple(w[k:k + window])] < i for j in range(k, k + window)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out)


def test_repeats_equal_brute_force(make_docs, edge_docs):
    import random
    rng = random.Random(4)
    pool = [" ".join(f"p{p}x{rng.randrange(50)}" for _ in range(rng.choice((49, 50, 51, 60, 90, 200)))) for p in range(12)]
    rows = []
    for i in range(160):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            t = rng.choice(pool).split()
            a = rng.randrange(0, 10)
            parts.append(" ".join(t[a:] if rng.random() < .5 else t) if rng.random() < .6 else " ".join(f"u{rng.randrange(9999)}" for _ in range(rng.randrange(80))))
        rows.append((i, " ".join(parts), "a"))
    rows += [(500, rows[3][1], "a"), (501, "same " * 120, "a"), (502, "same " * 90 + "end", "a"), (503, "a b " * 60, "a"), (504, "c a b " + "a b " * 50, "a")]
    for docs in (make_docs(rows), edge_docs):
        got = substrings.drop_repeats(docs).collect()
        assert sorted((r.n_words, r.n_removed, r.kept_text) for r in got) == _brute([(r.doc_id, r.text) for r in docs.collect()])
    left = substrings.without_repeats(edge_docs)
    assert left.columns == edge_docs.columns and left.schema == edge_docs.schema
    assert all(r.n_chars == len(r.text) for r in left.collect() if r.text is not None)
    assert substrings.drop_repeats(edge_docs.limit(0)).count() == 0
