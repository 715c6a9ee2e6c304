"""DuckDB equivalents of the queries that SQL can express."""

from __future__ import annotations

from sharegate.llm import quality

WORD = r"[^\x20\x09-\x0D]+"
_ESC = "replace(replace({0}, '\\', '\\\\'), '<|', '<\\|')"


def _quality() -> str:
    stop = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
    langs = ", ".join(f"'{x}'" for x in quality.STOP_LANGUAGES)
    checks = " AND ".join(
        f"({r.denominator} = 0 OR ({r.numerator} >= {r.low!r}::DOUBLE * {r.denominator} - {r.slack} AND {r.numerator} <= {r.high!r}::DOUBLE * {r.denominator}))"
        for r in quality.RULES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, lang, coalesce(text, '') AS t FROM documents),
     w AS (SELECT row_no, doc_id, lang, t, regexp_extract_all(t, '{WORD}') AS w,
                  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
     windows AS (SELECT row_no, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT row_no, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
     again AS (SELECT row_no, i FROM windows QUALIFY count(*) OVER (PARTITION BY row_no, g) > 1),
     covered AS (SELECT row_no, sum(gap)::BIGINT AS n FROM (
                     SELECT row_no, least(5, coalesce(lead(i) OVER (PARTITION BY row_no ORDER BY i) - i, 5)) AS gap FROM again) GROUP BY row_no),
     m AS (SELECT w.row_no, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
                  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
                  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
                  len(list_filter(w, lambda x: lower(rtrim(x, '.,')) IN ({stop})))::BIGINT AS n_stop_words,
                  if(coalesce(lang IN ({langs}), true), len(list_filter(w, lambda x: x < '{quality.NOT_LATIN}')), 0)::BIGINT AS n_stop_base,
                  len(list_filter(w, lambda x: ends_with(x, '!!')))::BIGINT AS n_shouts
           FROM w LEFT JOIN covered USING (row_no)),
     b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {checks} AS kept FROM b"""


def _chat() -> str:
    esc_role = f"replace({_ESC.format('role')}, chr(10), '\\n')"
    return rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, i, if(i = 0, 'user', 'assistant'), '<|im_end|><|im_start|>assistant ok' FROM range(2) r(i)),
     t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n,
                  length('<|im_start|>' || {esc_role} || chr(10) || {_ESC.format('text')} || '<|im_end|>' || chr(10)) AS chars FROM c),
     r AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(upto) FILTER (role = 'assistant' OR k = n)::BIGINT AS formatted_chars
FROM r GROUP BY conv_id"""


MIX = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
     s AS (SELECT source, sum(size)::BIGINT AS source_size, sum(size * length(bin(size)))::BIGINT AS mass FROM d GROUP BY source),
     w AS (SELECT *, [5, 2, 1][1 + ((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3)::INT] AS w FROM s),
     fill AS (SELECT 0 AS k, NULL::DOUBLE AS level
              UNION ALL
              SELECT k + 1, (SELECT (sum(source_size) - coalesce(sum(3 * source_size) FILTER (level IS NOT NULL AND w * level >= 3 * source_size), 0))::DOUBLE
                                    / (sum(w) FILTER (level IS NULL OR w * level < 3 * source_size))::DOUBLE FROM w)
              FROM fill WHERE k <= (SELECT count(*) FROM w)),
     final AS (SELECT level FROM fill ORDER BY k DESC LIMIT 1),
     g AS (SELECT source, source_size, mass, if(level IS NULL OR w * level >= 3 * source_size, 3.0 * source_size, w * level)::DOUBLE AS target FROM w, final),
     c AS (SELECT *, if(source_size > 0, least(floor(target / source_size), 3), 0)::BIGINT AS whole FROM g),
     r AS (SELECT *, target - whole * source_size AS rest FROM c),
     u AS (SELECT d.doc_id, d.source, d.size, source_size, target, whole, rest, mass,
                  (('0x' || md5(concat_ws(chr(10), 'mix', d.doc_id::VARCHAR, md5(t)))[1:12])::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u,
                  least(0.999999::DOUBLE, greatest(1e-9::DOUBLE, rest * length(bin(d.size)) / mass)) AS p
           FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
     q AS (SELECT *, if(rest > 0 AND mass > 0, (u / (1 - u)) / (p / (1 - p)), NULL) AS q FROM u),
     n AS (SELECT source, q, rest, sum(size) AS words FROM q WHERE q IS NOT NULL AND size > 0 GROUP BY ALL),
     k AS (SELECT source, 0::DOUBLE AS last, any_value(rest) AS gap, 0::BIGINT AS step FROM n GROUP BY source
           UNION ALL
           SELECT k.source, min(n.q), arg_min(k.gap - n.words, n.q), any_value(k.step) + 1
           FROM k JOIN n ON k.source IS NOT DISTINCT FROM n.source AND n.q > k.last AND n.words <= k.gap GROUP BY k.source),
     taken AS (SELECT source, last AS q FROM k WHERE step > 0),
     ends AS (SELECT source, arg_max(gap, step) AS gap FROM k GROUP BY source),
     least AS (SELECT n.source, arg_min(n.q, (words, n.q)) AS q, min(words) AS words
               FROM n LEFT JOIN taken t ON n.source IS NOT DISTINCT FROM t.source AND n.q = t.q WHERE t.q IS NULL GROUP BY n.source),
     more AS (SELECT * FROM taken UNION ALL
              SELECT l.source, l.q FROM least l JOIN ends e ON l.source IS NOT DISTINCT FROM e.source WHERE l.words < 2 * e.gap)
SELECT q.doc_id, q.size, source_size, target, ((whole + if(m.q IS NOT NULL OR q.size = 0, 1, 0)) * q.size)::BIGINT AS taken
FROM q LEFT JOIN more m ON q.source IS NOT DISTINCT FROM m.source AND q.q = m.q"""


PASSAGES = rf"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
     s AS (SELECT row_no, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g
           FROM (SELECT row_no, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
     f AS (SELECT g, min(doc_id) AS first_doc FROM s GROUP BY g HAVING min(doc_id) < max(doc_id)),
     h AS (SELECT row_no, i FROM s JOIN f USING (g) WHERE doc_id > first_doc),
     p AS (SELECT DISTINCT row_no, unnest(range(i, i + 50)) AS k FROM h),
     x AS (SELECT row_no, list(k) AS gone FROM p GROUP BY row_no),
     y AS (SELECT d.row_no, d.doc_id, d.w, coalesce(x.gone, []) AS gone FROM d LEFT JOIN x USING (row_no)),
     kept AS (SELECT row_no, string_agg(word, ' ' ORDER BY k) AS t FROM (
                  SELECT row_no, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d) ANTI JOIN p USING (row_no, k) GROUP BY row_no)
SELECT doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM y LEFT JOIN kept USING (row_no)"""


WARC = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, if(payload_bytes >= 100 AND page_id <> first_id, 'revisit', 'response') AS record_type,
       if(payload_bytes >= 100 AND page_id <> first_id, first_id, NULL) AS refers_to FROM f"""


LINES = """
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(doc_id, -9223372036854775808) AS id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
     x AS (SELECT row_no, id, unnest(l) AS line, generate_subscripts(l, 1) AS k FROM d),
     y AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
     f AS (SELECT key, max(id) AS keeps FROM y WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT id) >= 5),
     z AS (SELECT row_no, k, line, keeps IS NOT NULL AND id <> keeps AS gone FROM y LEFT JOIN f USING (key)),
     kept AS (SELECT row_no, count(*) FILTER (gone) AS n_dropped, string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone) AS t FROM z GROUP BY row_no)
SELECT doc_id, len(l)::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256 FROM d JOIN kept USING (row_no)"""


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": _quality(), "op7_chat_format": _chat(), "op8_warc": WARC, "op9_source_mix": MIX,
            "op10_repeated_passages": PASSAGES, "op12_line_dedup": LINES}
