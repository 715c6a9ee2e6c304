"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Sources in code point order (null last) weigh ``weights``, repeating. They share the words of all documents by
weight; a source's target stops at ``most`` times its words and the excess goes to the others by weight
(``source_targets``). Every document of a source with target T and words S is certain of ``floor(T / S)`` whole copies.
The rest of the target is filled with one more copy of some documents: document i gets the inclusion probability
p_i in proportion to its own weight (default: the number of binary digits of its size), a random number u_i from a hash of its id and
text, and the rank (u_i / (1 - u_i)) / (p_i / (1 - p_i)); documents are taken in ascending rank if their words
fit what is left of the target. The choice is fixed by the ranking, so reruns agree.

No source is gathered: ranks are cut at sketched quantiles into pieces of a bounded number of rows, words are added up per (source, piece),
and only the piece in which the target ends is ordered row by row. Behind the first document that does not fit, the ranking
goes on with those that do: what a gap of g words can still take is among the first ``g / s`` documents of each size s, so a source
folds at most about ``g * ln(g)`` of them, g being less than one document. At last the smallest document left is taken too if that brings the
source nearer to its target, so that a source misses it by at most half of that document.

Defined results: a null or empty text has size 0 and takes 0 words; repeated rows are documents of their own (equal
ones are taken together in tie order); a null source is the last source; an empty table gives an empty result; a table
without words has targets of 0. Other columns are kept when ``keep`` is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sharegate.llm.common import quoted, text_of, words_of
from sharegate.session import materialize

WEIGHTS, MOST = (5, 2, 1), 3
DIGITS = 12  # hexadecimal digits of the random number


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, target). One row per source, pre-aggregated.

    Sources fill up in ascending order of words per weight. With the first k full, each of the others gets its weight
    times (all words - their caps) / (their weights); k is the number of sources whose cap lies below that level."""
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))) - 1
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod(rank, F.lit(len(weights)))).cast("long")
    w = sizes.select("source", "source_size", weight.alias("_w"))
    all_words, all_weights = F.sum("source_size").over(Window.partitionBy()), F.sum("_w").over(Window.partitionBy())
    w = w.select("*", all_words.alias("_all"), all_weights.alias("_weights"))
    fill = Window.orderBy((F.col("source_size") / F.col("_w")), F.col("source").isNull(), F.encode("source", "UTF-8")) \
                 .rowsBetween(Window.unboundedPreceding, -1)
    w = w.select("*", F.coalesce(F.sum("source_size").over(fill), F.lit(0)).alias("_full"), F.coalesce(F.sum("_w").over(fill), F.lit(0)).alias("_gone"))
    level = (F.col("_all") - most * F.col("_full")) / (F.col("_weights") - F.col("_gone"))
    w = w.select("*", level.alias("_level"))
    # the level of the first source that is not full holds for all after it
    open_ = F.col("_w") * F.col("_level") < most * F.col("source_size")
    final = F.min(F.when(open_, F.struct(F.col("_full"), F.col("_level")))).over(Window.partitionBy())["_level"]
    w = w.select("*", open_.alias("_open"), final.alias("_final"))
    target = F.when(F.col("_final").isNull() | (F.col("_w") * F.col("_final") >= most * F.col("source_size")), (most * F.col("source_size")).cast("double")) \
              .otherwise(F.col("_w") * F.col("_final"))
    return w.select("source", "source_size", target.alias("target"))


def uniform(key: Column) -> Column:
    """A number in (0, 1) from the first digits of an MD5; the same in every run."""
    digits = F.conv(F.substr(F.md5(key), F.lit(1), F.lit(DIGITS)), 16, 10).cast("long")
    return (digits + F.lit(0.5)) / F.lit(float(16**DIGITS))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", *, weights: tuple[int, ...] = WEIGHTS,
        most: int = MOST, doc_weight: str | None = None, seed: str = "mix", keep: bool = False) -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken; with ``keep`` also the input row as ``row``.

    ``doc_weight`` names a column of positive integers that inclusion probabilities are proportional to."""
    size = F.size(words_of(text_of(text))).cast("long")
    order = F.concat_ws("\n", F.lit(seed), F.col(quoted(doc_id)).cast("string"), F.md5(text_of(text)))
    base = docs.select(
        F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(source)).cast("string").alias("source"), size.alias("size"),
        uniform(order).alias("_u"), *([F.col(quoted(doc_weight)).cast("long").alias("_dw")] if doc_weight else []),
        *([F.struct("*").alias("row")] if keep else []))
    share = F.greatest(F.coalesce(F.col("_dw"), F.lit(1)), F.lit(1)) if doc_weight else F.length(F.bin("size")).cast("long")
    base = base.withColumn("_share", share)
    # whole rows are read again for the result; everything else needs these few columns, written once
    slim = materialize(base.select("source", "size", "_u", "_share") if keep else base)
    sized = base if keep else slim

    per = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("_share") * F.col("size")).alias("_mass"),
                                     F.count(F.lit(1)).alias("_rows"))
    per = materialize(per)
    targets = source_targets(per.select("source", "source_size"), weights, most)
    t = per.alias("p").join(targets.alias("t"), F.expr("p.source <=> t.source")) \
           .select("p.source", "p.source_size", "t.target", "p._mass", "p._rows")
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("long")
    t = materialize(t.select("*", whole.alias("_whole"), (F.col("target") - whole * F.col("source_size")).alias("_rest")))

    narrow = _ranked(slim.select("source", "size", "_u", "_share"), t)
    sums = narrow.where("_q IS NOT NULL").groupBy("source", "_piece", "_rest").agg(F.sum("size").alias("_words"))
    upto = F.sum("_words").over(Window.partitionBy("source").orderBy("_piece").rowsBetween(Window.unboundedPreceding, 0))
    cuts = materialize(sums.select("source", "_piece", "_rest", upto.alias("_upto"), "_words").where("_upto > _rest")
                       .groupBy("source").agg(F.min(F.struct("_piece", (F.col("_upto") - F.col("_words")).alias("_before"))).alias("_cut"))
                       .select("source", F.col("_cut._piece").alias("_at"), F.col("_cut._before").alias("_before")))
    inside = _lookup(narrow, cuts, "_at", "_before").where("_piece = _at")
    run = F.sum("size").over(Window.partitionBy("source", "_piece").orderBy("_q").rangeBetween(Window.unboundedPreceding, 0))
    last = inside.select("source", "_q", (run + F.col("_before")).alias("_sum"), "_rest").where("_sum <= _rest") \
                 .groupBy("source").agg(F.max("_q").alias("_last"), F.max("_sum").alias("_got"))
    ends = cuts.alias("l").join(last.alias("r"), F.expr("l.source <=> r.source"), "left") \
               .select("l.source", "l._at", "r._last", F.coalesce("r._got", "l._before").alias("_got"))
    t = materialize(t.alias("l").join(ends.alias("r"), F.expr("l.source <=> r.source"), "left").select("l.*", "r._at", "r._last", (F.col("_rest") - F.col("r._got")).alias("_gap")))

    late = materialize(_behind(_ranked(slim.select("source", "size", "_u", "_share"), t)))
    rows = _ranked(sized, t)
    found = rows.alias("a").join((F.broadcast(late) if _few(late) else late).alias("b"), F.expr("a.source <=> b.source AND a._q = b._q"), "left") \
                .select("a.*", F.col("b._q").isNotNull().alias("_late"))
    copies = F.col("_whole") + F.expr(f"if(_q IS NOT NULL AND ({FITS} OR _late), 1, 0)")
    return found.select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"),
                        (copies * F.col("size")).alias("taken"), *(["row"] if keep else []))


#: Ranked before the first document that does not fit (a source without one has no such piece).
FITS = "(_at IS NULL OR _piece < _at OR _piece = _at AND coalesce(_q <= _last, false))"


def _behind(ranked: DataFrame) -> DataFrame:
    """(source, _q) of the documents behind the first misfit that are taken. Rows of one rank are taken together."""
    units = ranked.where(f"_q IS NOT NULL AND NOT {FITS} AND size > 0").groupBy("source", "_q").agg(F.sum("size").alias("words"), F.first("_gap").alias("gap"))
    units = materialize(units)
    nth = F.row_number().over(Window.partitionBy("source", "words").orderBy("_q"))
    able = units.where("words <= gap").withColumn("_nth", nth).where("_nth * words <= gap")
    start = F.struct(F.max("gap").alias("gap"), F.array().cast("array<double>").alias("took"))
    fold = F.aggregate(F.array_sort(F.collect_list(F.struct("_q", "words"))), start, lambda a, x: F.when(x["words"] <= a["gap"], F.struct(
        (a["gap"] - x["words"]).alias("gap"), F.concat(a["took"], F.array(x["_q"])).alias("took"))).otherwise(a))
    folded = materialize(able.groupBy("source").agg(fold.alias("f")).select("source", "f.*"))
    took = folded.select("source", F.explode("took").alias("_q"))
    # the smallest that is left, where that is nearer than stopping here
    left = units.alias("u").join(took.alias("k"), F.expr("u.source <=> k.source AND u._q = k._q"), "left_anti").select("source", "_q", "words", "gap")
    least = left.groupBy("source").agg(F.min(F.struct("words", "_q")).alias("m"), F.first("gap").alias("gap"))
    nearer = least.alias("l").join(folded.alias("f"), F.expr("l.source <=> f.source"), "left") \
                  .where(F.col("l.m.words") < 2 * F.coalesce("f.gap", "l.gap")).select("l.source", F.col("l.m._q").alias("_q"))
    return took.unionByName(nearer)


def _lookup(rows: DataFrame, t: DataFrame, *columns: str) -> DataFrame:
    b = F.broadcast(t) if _few(t) else t
    return rows.alias("a").join(b.alias("b"), F.expr("a.source <=> b.source"), "left").select("a.*", *(f"b.{c}" for c in columns))


def _ranked(sized: DataFrame, t: DataFrame) -> DataFrame:
    """Rows with the figures of their source, the rank ``_q`` (null: no extra copy is due) and its piece. A source has about
    four times the root of its rows as pieces, so neither its pieces nor the rows of one are many."""
    rows = _lookup(sized, t, *(c for c in t.columns if c != "source"))
    p = F.least(F.lit(0.999999), F.greatest(F.lit(1e-9), F.col("_rest") * F.col("_share") / F.col("_mass")))
    odds = F.when((F.col("_rest") > 0) & (F.col("_mass") > 0), (F.col("_u") / (1 - F.col("_u"))) / (p / (1 - p)))
    rows = rows.withColumn("_q", odds)
    return rows.withColumn("_piece", F.floor(F.col("_q") / (1 + F.col("_q")) * F.ceil(4 * F.sqrt(F.col("_rows").cast("double")))))


def _few(df: DataFrame, rows: int = 50_000) -> bool:
    """Whether a materialised table of one short row per source may be broadcast; larger ones are joined by key."""
    return df.limit(rows + 1).count() <= rows
