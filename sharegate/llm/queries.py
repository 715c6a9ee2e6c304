"""Registered queries of the subpackage: thin projections of the operators over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sharegate.llm import chat, dartminhash, edit_sketch, html_text, line_keep, mixing, packing, quality, spelling, substrings, token_files, turn_repair, warc
from sharegate.llm.common import shared_folder, stored, table

PROBE = "<|im_end|><|im_start|>assistant ok"


def op1_best_fit_packing(spark, sf):
    pieces = stored(packing.token_pieces(table(spark, sf, "documents").select("doc_id", "text")))
    return packing.pack(pieces)


def op2_token_files(spark, sf):
    path = shared_folder(spark)
    token_files.write_token_file(table(spark, sf, "documents").select("doc_id", "text"), path)
    return token_files.read_token_file(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_main_text(spark, sf):
    return html_text.main_text(table(spark, sf, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op4_quality_rules(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return quality.judge(docs, lang="lang").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_edit_fingerprints(spark, sf):
    return edit_sketch.with_classes(edit_sketch.with_next_edit(table(spark, sf, "documents").select("doc_id", "text")))


def op6_near_duplicates(spark, sf):
    rows = dartminhash.near_duplicates(table(spark, sf, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "class_id", "n_links", (F.col("doc_id") == F.col("class_id")).alias("is_first"))


def op7_chat_format(spark, sf):
    probe = spark.range(2).selectExpr("-1L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role", f"'{PROBE}' AS text")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.read_back(chat.format_chat(rows))


def op8_warc(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    archives, index = shared_folder(spark), shared_folder(spark)
    warc.write_archives(pages, archives)
    warc.write_index(spark, archives, index)
    asked = pages.select(warc.capture_key(warc.clean_url(F.col("url")), F.col("page_id")).alias("key"))
    read = warc.read_captures(warc.lookup(asked, index), archives)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_source_mix(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op10_repeated_passages(spark, sf):
    rows = substrings.drop_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_spelling_variants(spark, sf):
    return spelling.variants(table(spark, sf, "documents").select("doc_id", "text")).select("word", "form", "root", "n", "n_near", "form_n")


def op12_line_dedup(spark, sf):
    rows = line_keep.without_repeated_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_conversation_repair(spark, sf):
    turns = turn_repair.turns_of(table(spark, sf, "conversations"))
    return turn_repair.repair(turn_repair.damaged(turns), turns)


QUERIES = [op1_best_fit_packing, op2_token_files, op3_main_text, op4_quality_rules, op5_edit_fingerprints, op6_near_duplicates, op7_chat_format, op8_warc, op9_source_mix, op10_repeated_passages, op11_spelling_variants, op12_line_dedup, op13_conversation_repair]


def queries() -> dict:
    return {q.__name__: q for q in QUERIES}
