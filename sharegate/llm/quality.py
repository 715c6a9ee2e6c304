"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Each row of ``RULES`` names a ratio, its numerator and denominator (columns of the measured text) and the
closed range that a good text keeps to. A row of the input becomes its measures, then one boolean per rule.

Stop words are compared in lower case and only asked of words in the script of their lists (and, where a column names
the language, of texts in a language with a list), so texts in other scripts and languages pass that rule.

Defined results: a null or empty text has no words, so every measure is 0 and the base rule fails it. Repeated
rows are judged one by one. Columns of the input are kept; columns that the operator adds replace equal names.
An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharegate.functions.sql import quote
from sharegate.llm.common import WORD, quoted

MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20

#: Frequent function words of four languages (lower case), as a reader would list them.
STOP_LANGUAGES = ("en", "fr", "es", "de")
NOT_LATIN = "\u0250"  # Latin letters (and digits and signs) come before this code point
STOP_WORDS = tuple("""
the of and to a in is that for it was on with be as by this are at from or an not but have
de la le et les des en un une du que pour est qui dans par pas au sur avec il elle ne ce
el y los se del las por no con su para al lo una es como más o
der die und den von zu das sich mit auf ist nicht im dem ein eine als auch für er sie bei
""".split())


@dataclass(frozen=True)
class Rule:
    """``low <= numerator / denominator <= high``, where the numerator may miss the lower bound by ``slack``
    (short texts hold few stop words by chance); a text with a zero denominator passes."""

    name: str
    numerator: str
    denominator: str
    low: float
    high: float
    slack: int = 0


RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 12.0),
    Rule("symbols_per_word", "n_symbols", "n_words", 0.0, 0.25),
    Rule("shouts_per_word", "n_shouts", "n_words", 0.0, 0.5),
    Rule("stop_words", "n_stop_words", "n_stop_base", 0.08, 1.0, slack=2),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", 0.0, 0.5),
)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_stop_base", "n_shouts")


def _repeat_words(windows: str) -> str:
    """Words covered by windows whose hash occurs twice or more: sort (hash, place), keep places with an equal
    neighbour, add up the gaps between them, each at most a window."""
    pairs = f"sort_array(transform({windows}, (h, i) -> struct(h AS h, i AS i)))"
    places = ("sort_array(transform(filter(p, (e, k) -> (k > 0 AND p[k - 1].h = e.h) OR (k + 1 < size(p) AND p[k + 1].h = e.h)), e -> e.i))")
    gaps = (f"aggregate({places}, named_struct('last', -{REPEAT_WINDOW}, 'n', 0L), (a, i) -> "
            f"named_struct('last', i, 'n', a.n + least({REPEAT_WINDOW}, i - a.last)), a -> a.n)")
    heavy = f"transform(array({pairs}), p -> {gaps})[0]"
    return f"if(size(array_distinct({windows})) = size({windows}), 0L, {heavy})"


def measured(df: DataFrame, text: str = "text", lang: str | None = None) -> DataFrame:
    """The input with ``MEASURES`` (long). Windows are compared by a 64-bit hash of their five words."""
    listed = F.lit(True) if lang is None else F.coalesce(F.col(quoted(lang)).cast("string").isin(*STOP_LANGUAGES), F.lit(True))
    stop = ", ".join(quote(w) for w in STOP_WORDS)
    window = ", ".join(f"_w[i + {k}]" for k in range(REPEAT_WINDOW))
    kept = [c for c in df.columns if c.lower() not in MEASURES]
    base = df.select(F.struct(*(F.col(quoted(c)) for c in kept)).alias("_row"), F.expr(f"coalesce(cast({quoted(text)} AS string), '')").alias("_t"), listed.alias("_listed"))
    split = base.select("_row", "_t", "_listed", F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)).alias("_w"),
                        F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"))
    hashed = split.select(
        "_row", "_t", "_w", "_l", "_listed",
        F.expr(f"if(size(_w) < {REPEAT_WINDOW}, cast(array() AS array<bigint>), transform(sequence(0, size(_w) - {REPEAT_WINDOW}), "
               f"i -> xxhash64({window})))").alias("_h"))
    return hashed.select(
        "_row.*",
        F.expr("cast(size(_w) AS bigint)").alias("n_words"),
        F.expr("cast(length(array_join(_w, '')) AS bigint)").alias("word_chars"),
        F.expr("cast(regexp_count(_t, '[#*$%&|<>]') AS bigint)").alias("n_symbols"),
        F.expr("cast(size(_l) AS bigint)").alias("n_lines"),
        F.expr("cast(size(_l) - size(array_distinct(_l)) AS bigint)").alias("n_dup_lines"),
        F.expr(_repeat_words("_h")).alias("n_repeat_words"),
        F.expr(f"cast(size(filter(_w, w -> lower(rtrim('.,', w)) IN ({stop}))) AS bigint)").alias("n_stop_words"),
        F.expr(f"if(_listed, cast(size(filter(_w, w -> w < '{NOT_LATIN}')) AS bigint), 0L)").alias("n_stop_base"),
        F.expr("cast(size(filter(_w, w -> endswith(w, '!!'))) AS bigint)").alias("n_shouts"))


def base_failed() -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def verdict(rule: Rule) -> Column:
    n, d = F.col(rule.numerator), F.col(rule.denominator)
    return (n >= F.lit(rule.low) * d - F.lit(rule.slack)) & (n <= F.lit(rule.high) * d) | (d == 0)


def judge(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, *, lang: str | None = None) -> DataFrame:
    """The input with its measures, ``base_failed``, ``failed`` (names of the rules it breaks) and ``kept``. ``lang`` names a column with
    the language; a null one does not spare a text any rule."""
    m = measured(df.drop("base_failed", "failed", "kept"), text, lang)
    broken = F.array(*(F.when(~verdict(r), F.lit(r.name)) for r in rules)) if rules else F.array().cast("array<string>")
    judged = m.withColumns({"base_failed": base_failed(), "failed": F.array_compact(broken)}) \
              .withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
    # the generator keeps later filters above it: pushed below, one would repeat every measure for each rule that reads it
    return judged.select(F.explode(F.array(F.struct("*"))).alias("_judged")).select("_judged.*")


def keep_good(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, *, lang: str | None = None) -> DataFrame:
    """The rows that pass, with the columns they came with."""
    named = [F.col(quoted(lang)).alias("lang")] if lang else []
    rows = df.select(F.struct("*").alias("row"), F.col(quoted(text)).alias("text"), *named)
    return judge(rows, "text", rules, lang="lang" if lang else None).where("kept").select("row.*")
