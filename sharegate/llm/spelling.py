"""Spelling variants by asymmetric q-chunks: one word's two disjoint chunks against the other's positional grams.

Two words are near if exactly one inserted, deleted or replaced code point turns one into the other. The shorter word (either of two
equally long ones) of length L contributes its two disjoint chunks, the halves ``[0, L // 2)`` and ``[L // 2, L)``. One edit leaves one of them
whole, and the other word holds it as a gram at the same position or, behind the edit, shifted by the difference in
length, which is 0 or 1. So the longer word contributes, for each length L it can be near to, its grams at the chunks'
positions within that shift; its grams elsewhere could join nothing. Chunks and grams meet on (length, position, text) and are
verified by edit distance.

A meeting place that very many words share is not paired out: its words are cut further. What is left of a word between the common beginning
and the common end is again two chunks, one of which survives the edit, so the members of a crowded place move to two
narrower ones, level by level, until a place holds few words or only one code point is open. At that point its words differ in
that code point alone (or in an insertion beside it) and are bounded by the alphabet. No pair is lost on the way.

``word_counts`` counts words per document and per task before the shuffle. Defined results: a null text has no
words; a null id is written as an empty string in ``<doc_id>:<word>``; repeated rows count again; ties of the most frequent near word
go to the smallest in code point order; an empty table gives an empty one; other columns are ignored. Texts and words of any length are used whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharegate.llm.common import quoted, stored, text_of

LETTERS = "a-zÀ-ÿ"  # after A-Z are in lower case
LEAST_CHARS, LEAST_COUNT, MORE = 7, 2, 10
SLIP = 31  # a word in so many of (document, word) loses a code point
TABLE = 200_000  # distinct words that a task holds before it passes them on
CROWD = 64  # words at a meeting place that are still paired


def slipped(doc_id: str, word: str) -> str:
    h = zlib.crc32(f"{doc_id}:{word}".encode("utf-8", "surrogatepass"))
    at = h % len(word)
    return word[:at] + word[at + 1:] if h % SLIP == 0 else word


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of words with ``least_chars`` code points and ``least_count`` occurrences over all documents."""
    # shorter runs cannot become words; a run is matched from its first letter, so matches are maximal
    runs = re.compile(f"[{LETTERS}]{{{least_chars},}}").findall

    def count(batches):
        held: Counter = Counter()

        def out():
            words = pa.array(list(held), pa.string())
            found = pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return found

        for batch in batches:
            for i, value in zip(batch.column("_id").to_pylist(), batch.column("_text").to_pylist(), strict=True):
                lowered = value.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes: A-Z only
                for word, n in Counter(runs(lowered)).items():
                    word = slipped(i, word)
                    if len(word) >= least_chars:
                        held[word] += n
                if len(held) > TABLE:
                    yield out()
        if held:
            yield out()

    rows = docs.select(F.coalesce(F.col(quoted(doc_id)).cast("string"), F.lit("")).alias("_id"), text_of(text).alias("_text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _place(length: Column, a: Column, b: Column, word: Column) -> Column:
    """Key of the place where words of ``length`` or one more meet that agree in the first ``a`` and the last ``b`` code points."""
    return F.xxhash64(length, a, b, F.substr(word, F.lit(1), a), F.substr(word, F.char_length(word) - b + 1, b))


def _narrower(level: DataFrame) -> DataFrame:
    """Each row (id, word, length, a, b, shorter) at the two places that halve its open middle."""
    middle = F.expr("length - a - b")
    half = F.floor(middle / 2).cast("int")
    first = F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b"))
    second = F.struct(F.col("a").alias("a"), (F.col("b") + middle - half).alias("b"))
    return level.withColumn("k", F.explode(F.array(first, second))).select("id", "word", "length", "k.a", "k.b", "shorter")


def near_words(words: DataFrame, *, crowd: int = CROWD) -> DataFrame:
    """(a, b) ids of all pairs of (id, word) that are one edit apart, each pair in both directions."""
    size = F.char_length("word")
    start = words.select("id", "word", F.explode(F.array(F.struct(size.alias("length"), F.lit(True).alias("shorter")), F.struct(size.alias("length"), F.lit(False).alias("shorter")),
                                                         F.struct((size - 1).alias("length"), F.lit(False).alias("shorter")))).alias("k"))
    level = start.select("id", "word", "k.length", F.lit(0).alias("a"), F.lit(0).alias("b"), "k.shorter").where("length > 0")
    links = None
    while True:
        placed = _narrower(level).withColumn("place", _place(F.col("length"), F.col("a"), F.col("b"), F.col("word")))
        placed = stored(placed)
        # a word meets itself; a place with more has company
        per = placed.groupBy("place").agg(F.sum(F.col("shorter").cast("long")).alias("x"), F.count(F.lit(1)).alias("n"), F.max(F.expr("length - a - b")).alias("open"))
        per = stored(per.where("x > 0 AND n > 2").select("place", ((F.col("n") > 2 * crowd) & (F.col("open") > 1)).alias("crowded")))
        met = placed.join(per, "place")
        found = _pairs(met.where("NOT crowded"))
        links = found if links is None else links.unionByName(found)
        if per.where("crowded").limit(1).count() == 0:
            break
        level = stored(met.where("crowded").select("id", "word", "length", "a", "b", "shorter"))
    links = links.distinct()  # an edit beside a seam leaves both chunks whole
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _pairs(met: DataFrame) -> DataFrame:
    short = met.where("shorter").select("place", F.col("id").alias("a"), F.col("word").alias("wa"))
    long_ = met.where("NOT shorter").select("place", F.col("id").alias("b"), F.col("word").alias("wb"))
    # of two equally long words only one direction is needed
    both = short.join(long_, "place").where("a <> b AND (char_length(wa) < char_length(wb) OR wa < wb)")
    return both.where(F.levenshtein("wa", "wb", 1) == 1).select("a", "b")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last, in doubling steps. A form is ``MORE`` times as frequent
    as its word, so a chain is at most as long as the digits of a count."""
    at = stored(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while at.where("moved").limit(1).count():
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = stored(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
    return at.select("word", "root")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, more: int = MORE, crowd: int = CROWD, **limits) -> DataFrame:
    """word, n, form, form_n (null without one), n_near, root of every word."""
    words = stored(word_counts(docs, doc_id, text, **limits).withColumn("id", F.monotonically_increasing_id()))  # written once, so ids stay
    links = near_words(words.select("id", "word"), crowd=crowd)
    other = words.select(F.col("id").alias("b"), F.struct((-F.col("n")).alias("m"), F.col("word").alias("word")).alias("other"))
    per = links.join(other, "b").groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min("other").alias("top")).withColumnRenamed("a", "id")
    rows = words.join(per, "id", "left")
    has = -F.col("top.m") >= more * F.col("n")
    rows = stored(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("top.word")).alias("form"), F.when(has, -F.col("top.m")).alias("form_n")))
    last = roots(rows.where("form IS NOT NULL").select("word", "form"))
    return rows.join(last, "word", "left").select("word", "n", "form", "form_n", "n_near", F.coalesce("root", "word").alias("root"))
