import os
import re
from collections import Counter

import corpus_pipeline
from sharegate.llm import quality
from tests.llm.test_documents import SF, _check_packing, _classes, ids_of
from tests.llm.test_text_rules import _brute

words = re.compile(r"[^\x20\x09-\x0D]+").findall


def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, SF).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        old, new = before.collect(), after.collect()
        if name != "best-fit packing":
            assert after.columns == columns
        if name == "quality rules":
            assert {r.doc_id for r in new} == {r.doc_id for r in quality.judge(before).where("kept").collect()} and 0 < len(new) < len(old)
        elif name == "near duplicates":
            assert {r.doc_id for r in new} == set(_classes([(r.doc_id, r.text) for r in old]).values()) and len(new) < len(old)
        elif name == "repeated passages":
            want = [(n - gone, kept) for n, gone, kept in _brute([(r.doc_id, r.text) for r in old]) if gone < n or n == 0]
            assert Counter((len(words(r.text)), " ".join(words(r.text))) for r in new) == Counter(want)
            assert all(r.n_chars == len(r.text) for r in new)
        elif name == "source mix":
            copies = Counter(r.doc_id for r in new)
            assert set(copies) <= {r.doc_id for r in old} and max(copies.values()) <= 3
            texts = {r.doc_id: r.text for r in old}
            assert all(r.text == texts[r.doc_id] for r in new)
            assert abs(sum(len(words(r.text)) for r in new) - sum(len(words(r.text)) for r in old)) < 0.1 * sum(len(words(r.text)) for r in old)
        else:
            _check_packing(new, 1024)
            n = Counter()
            for r in new:
                n[r.doc_id] += r.length
            want = Counter()
            for r in old:
                want[r.doc_id] += len(ids_of(r.text))
            assert n == want
        before = after


def test_run_is_the_chain_of_stages(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {"doc_id", "piece", "sequence_id", "offset"} <= set(rows[0].asDict())


def test_pipeline_edges(spark, edge_docs):
    edge = edge_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for docs in (edge, edge.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, SF).collect() is not None


def test_import_errors_are_not_swallowed():
    source = open(corpus_pipeline.__file__).read()
    assert "except" not in source and os.path.basename(corpus_pipeline.__file__) == "corpus_pipeline.py"
