"""Substring deduplication by relative Lempel-Ziv parsing against every indexed block of the corpus.

A window is ``WINDOW`` consecutive words. Every word covered by a window that also starts in a document with a smaller id is
removed; windows are judged on the input.

Index. Each text is cut into blocks at content-defined anchors: ``GRAM``-word hashes that are the smallest of
``WINDOW - GRAM + 1`` neighbours, so equal windows hold equal anchors at equal places. The index keeps for every anchor the
first document and place that has it, the hash of the block that follows there, how often the anchor occurs and whether the
same block follows everywhere. It is built by one aggregation over all texts.

Parsing. A document is factored greedily: from an anchor whose first occurrence lies in a smaller document, the factor is extended
block by block as long as the reference goes on with the same block. Windows inside a factor are duplicates.

Factor boundaries. A window that lies in no single factor may still occur in some smaller document. Such windows, if their
anchor is shared, are looked up by a 128-bit hash among the windows of the same kind of all documents. A document that is the
first to hold a run of blocks which all its other holders repeat whole needs no lookup rows for that run: the others are
parsed against it. So the lookup holds the neighbourhood of differences, not the copies.

Defined results: a null or empty text has no words and keeps none; a null id counts as the largest; rows with equal ids do not
remove each other's words; a text of one repeated word is an ordinary text; an empty table gives an empty one. Columns
of the input are kept. No step needs all holders of a passage together: anchors and windows are pre-aggregated, and joins
on them may be split by adaptive execution.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sharegate.llm.common import WORD, quoted, stored, text_of

WINDOW, GRAM = 50, 16
SLICE_WORDS = 1 << 20  # words that are hashed together in a task
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
NO_ID = (1 << 63) - 1
_U = np.uint64
_powers: dict[tuple[int, bool], np.ndarray] = {}


def _power(m: int, inverse: bool, n: int) -> np.ndarray:
    """m ** (0 .. n - 1), or of its inverse, modulo 2 ** 64."""
    have = _powers.get((m, inverse))
    if have is None or len(have) < n:
        base = np.full(max(n, SLICE_WORDS + 1), pow(m, -1, 1 << 64) if inverse else m, dtype=_U)
        base[0] = 1
        have = _powers[m, inverse] = np.cumprod(base, dtype=_U)
    return have[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """best(x[i : i + width]) for each i that has them all."""
    step = 1
    while 2 * step <= width:
        x = best(x[:-step], x[step:])
        step *= 2
    return best(x[: len(x) - (width - step)], x[width - step:]) if width > step else x


class Hashes:
    """Rolling hashes of texts that lie one after another in ``words`` (hashes of words); ``ends`` bounds them."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, window: int = WINDOW, gram: int = GRAM):
        n = len(words)
        self.gram, self.window, self.n = gram, window, n
        self.sums = [np.concatenate([np.zeros(1, _U), np.cumsum(words * _power(m, False, n), dtype=_U)]) for m in MULTIPLIERS]
        ends = np.repeat(np.cumsum(lengths), lengths)
        self.starts_window = np.arange(n) + window <= ends
        self.gram_hash, self.least = np.zeros(n, _U), np.zeros(n, _U)
        if n < window:
            self.anchor = np.zeros(n, bool)
            return
        self.gram_hash[: n - gram + 1] = self.of(0, np.arange(n - gram + 1), gram)
        width = window - gram + 1
        low = _slide(self.gram_hash[: n - gram + 1], width, np.minimum)
        self.least[: len(low)] = low
        self.least[~self.starts_window] = 0
        high = _slide(np.concatenate([np.zeros(width - 1, _U), self.least]), width, np.maximum)
        self.anchor = (high == self.gram_hash) & (high > 0)

    def of(self, which: int, start: np.ndarray, length) -> np.ndarray:
        s, m = self.sums[which], MULTIPLIERS[which]
        return _mix((s[start + length] - s[start]) * _power(m, True, self.n + 1)[start] + np.asarray(length, dtype=_U) * _U(MULTIPLIERS[1 - which]))

    def blocks(self, places: np.ndarray) -> np.ndarray:
        """Hash of the block from each anchor of one text to the end of the next anchor; 0 for the last."""
        out = np.zeros(len(places), _U)
        if len(places) > 1:
            out[:-1] = self.of(0, places[:-1], places[1:] + self.gram - places[:-1])
        return out


def _slices(lengths: np.ndarray):
    """Ranges of texts with about SLICE_WORDS words together."""
    first, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > SLICE_WORDS:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(lengths):
        yield first, len(lengths)


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of an Arrow list column of longs, nulls as empty lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])


def _anchors(batches):
    for batch in batches:
        ids, (words, at) = batch.column("_id").to_numpy(zero_copy_only=False), _lists(batch.column("_wh"))
        lengths = np.diff(at)
        for a, b in _slices(lengths):
            h = Hashes(words[at[a]:at[b]].view(_U), lengths[a:b])
            places = np.flatnonzero(h.anchor)
            owner = np.searchsorted(np.cumsum(lengths[a:b]), places, side="right")
            block = h.blocks(places)
            if len(places):
                block[np.flatnonzero(np.diff(owner))] = 0
            yield pa.RecordBatch.from_arrays([
                pa.array(ids[a:b][owner]), pa.array((places - (at[a:b] - at[a])[owner]).astype(np.int32)),
                pa.array(h.gram_hash[places].view(np.int64)), pa.array(block.view(np.int64))], names=["doc", "pos", "anchor", "block"])


def _runs(link: np.ndarray, places: np.ndarray, gram: int) -> list[tuple[int, int]]:
    """Word ranges of runs of linked anchors; ``link[j]`` joins anchors j and j + 1."""
    edge = np.diff(np.concatenate([[0], link.astype(np.int8), [0]]))
    return [(int(places[a]), int(places[b]) + gram) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def _inside(n: int, runs: list[tuple[int, int]], window: int) -> np.ndarray:
    """Window starts whose whole window lies in one run."""
    out = np.zeros(n, bool)
    for a, b in runs:
        if b - a >= window:
            out[a:b - window + 1] = True
    return out


def _factor(h: Hashes, a: int, b: int, doc: int, index: np.ndarray):
    """Of the text at words a to b: window starts inside factors, and those that need a lookup."""
    places = np.flatnonzero(h.anchor[a:b])
    found = index["anchor"]
    key = h.gram_hash[a:b][places]
    at = np.minimum(np.searchsorted(found, key), len(found) - 1)
    known, first = found[at] == key, index["doc"][at]
    block = h.blocks(places + a)
    own_place = index["pos"][at] == places
    pair = known[:-1] & known[1:] & (first[:-1] == first[1:])
    refers = pair & (first[:-1] < doc) & (np.diff(index["pos"][at]) == np.diff(places)) & (index["block"][at][:-1] == block[:-1])
    leads = pair & (first[:-1] == doc) & own_place[:-1] & own_place[1:] & index["same"][at][:-1] & (index["n"][at][:-1] == index["n"][at][1:])
    done = _inside(b - a, _runs(refers, places, h.gram), h.window)
    led = _inside(b - a, _runs(leads, places, h.gram), h.window)
    least = h.least[a:b]
    near = np.minimum(np.searchsorted(found, least), len(found) - 1)
    open_ = h.starts_window[a:b] & (found[near] == least) & ~done & ~led
    return done, np.flatnonzero(open_)


INDEX = np.dtype([("anchor", _U), ("doc", np.int64), ("pos", np.int64), ("block", _U), ("same", bool), ("n", np.int64)])


def _index_of(entry) -> np.ndarray:
    """The index entries of one document, sorted by anchor, from five parallel lists."""
    out = np.empty(len(entry["anchor"]), INDEX)
    for name in INDEX.names:
        x = np.asarray(entry[name])
        out[name] = x.astype(np.int64).view(_U) if INDEX[name] == _U else x
    return out[np.argsort(out["anchor"], kind="stable")]


def _entries(column) -> dict:
    """A list<struct> column as flat arrays and offsets."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    flat = column.flatten()
    return {"at": np.concatenate([[0], np.cumsum(sizes)]), **{f.name: flat.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(flat.type)}}


def _each(batch):
    """(row, hashes, first word, end, id, index) of each text that shares an anchor."""
    ids, (words, at), e = batch.column("_id").to_numpy(zero_copy_only=False), _lists(batch.column("_wh")), _entries(batch.column("_index"))
    lengths = np.diff(at)
    for a, b in _slices(lengths):
        h = Hashes(words[at[a]:at[b]].view(_U), lengths[a:b])
        for i in range(a, b):
            lo, hi = e["at"][i], e["at"][i + 1]
            if hi > lo and lengths[i]:
                yield i, h, int(at[i] - at[a]), int(at[i + 1] - at[a]), int(ids[i]), _index_of({n: e[n][lo:hi] for n in INDEX.names})


def _lookups(batches):
    for batch in batches:
        for _, h, a, b, doc, index in _each(batch):
            starts = _factor(h, a, b, doc, index)[1] + a
            if len(starts):
                one, two = (h.of(k, starts, h.window).view(np.int64) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), doc)), pa.array(one), pa.array(two)], names=["doc", "h1", "h2"])


_words = re.compile(WORD).findall


def _cut(batches):
    """Appends n_removed and kept (null where nothing is removed) to each row."""
    for batch in batches:
        n = batch.num_rows
        removed, kept = np.zeros(n, np.int64), [None] * n
        texts, hits = batch.column("_text"), _entries(batch.column("_hits"))
        for i, h, a, b, doc, index in _each(batch):
            dup, open_ = _factor(h, a, b, doc, index)
            lo, hi = hits["at"][i], hits["at"][i + 1]
            if hi > lo and len(open_):
                seen = set(zip(hits["h1"][lo:hi].tolist(), hits["h2"][lo:hi].tolist(), strict=True))
                one, two = (h.of(k, open_ + a, h.window).view(np.int64).tolist() for k in (0, 1))
                dup[open_[[x in seen for x in zip(one, two, strict=True)]]] = True
            starts = np.flatnonzero(dup)
            if len(starts):
                change = np.zeros(b - a + 1, np.int64)
                np.add.at(change, starts, 1)
                np.add.at(change, starts + h.window, -1)
                covered = np.cumsum(change)[:-1] > 0
                removed[i] = covered.sum()
                words = _words(texts[i].as_py())
                kept[i] = " ".join(words[k] for k in np.flatnonzero(~covered))
        columns = [c for c in batch.schema.names if c not in ("_wh", "_index", "_hits", "_text", "_id")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(removed), pa.array(kept, pa.string())],
                                         names=[*columns, "_removed", "_kept"])


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The input with ``n_words``, ``n_removed`` and ``kept_text`` (kept words joined by one space); columns of these names are replaced."""
    docs = docs.drop("n_words", "n_removed", "kept_text")
    keyed = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(quoted(doc_id)).cast("long"), F.lit(NO_ID)).alias("_id"), text_of(text).alias("_text"))
    words = F.regexp_extract_all("_text", F.lit(WORD), F.lit(0))
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    none = F.array().cast("array<bigint>")

    long_enough = F.when(F.length("_text") >= 2 * WINDOW - 1, hashes).otherwise(none)
    found = keyed.select("_id", long_enough.alias("_wh")).mapInArrow(_anchors, "doc long, pos int, anchor long, block long")
    anchors = stored(found)
    index = anchors.groupBy("anchor").agg(
        F.min(F.struct("doc", "pos", "block")).alias("first"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("n"),
        F.min("block").alias("b0"), F.max("block").alias("b1"))
    # stored, so that the joins on hot anchors and windows can be split
    shared = stored(index.where("last > first.doc").select(
        "anchor", "first.doc", F.col("first.pos").cast("long").alias("pos"), "first.block", (F.col("b0") == F.col("b1")).alias("same"), "n"))
    entry = F.struct("anchor", "doc", "pos", "block", "same", "n")
    per_doc = anchors.select("anchor", F.col("doc").alias("_id")).join(shared, "anchor") \
                     .groupBy("_id").agg(F.collect_set(entry).alias("_index"))
    per_doc = stored(per_doc)

    with_hashes = keyed.select("_id", "_text").join(per_doc, "_id").select("_id", hashes.alias("_wh"), "_index")
    windows = stored(with_hashes.mapInArrow(_lookups, "doc long, h1 long, h2 long"))
    least = stored(windows.groupBy("h1", "h2").agg(F.min("doc").alias("_least"), F.max("doc").alias("_most")).where("_most > _least"))
    hits = windows.join(least, ["h1", "h2"]).where("doc > _least") \
                  .groupBy(F.col("doc").alias("_id")).agg(F.collect_set(F.struct("h1", "h2")).alias("_hits"))

    payload = per_doc.join(hits, "_id", "left")
    rows = keyed.join(payload, "_id", "left").withColumn("_wh", F.when(F.col("_index").isNull(), none).otherwise(hashes))
    schema = T.StructType([T.StructField("_row", docs.schema), T.StructField("_removed", T.LongType()), T.StructField("_kept", T.StringType())])
    cut = rows.select("_row", "_id", "_text", "_wh", "_index", "_hits").mapInArrow(_cut, schema)
    own = F.coalesce(F.col("_row").getField(text).cast("string"), F.lit(""))
    split = cut.select("*", F.regexp_extract_all(own, F.lit(WORD), F.lit(0)).alias("_w"))
    return split.select("_row.*", F.size("_w").cast("long").alias("n_words"),
                        F.col("_removed").alias("n_removed"), F.coalesce("_kept", F.array_join("_w", " ")).alias("kept_text"))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The input, where a text that loses words becomes its kept words; rows whose every word goes are dropped.
    Other texts stay as they are, also empty ones. A column ``n_chars`` follows the text."""
    rows = docs.select(F.struct("*").alias("row"), F.col(quoted(doc_id)).alias("id"), F.col(quoted(text)).alias("text"))
    kept = drop_repeats(rows, "id", "text").where("n_removed = 0 OR n_removed < n_words")
    new = {text: F.col("kept_text"), "n_chars": F.length("kept_text")}
    columns = []
    for field in docs.schema:
        was = F.col("row").getField(field.name)
        now = F.when(F.col("n_removed") > 0, new[field.name].cast(field.dataType)).otherwise(was) if field.name in new else was
        columns.append(now.alias(field.name))
    return kept.select(*columns)
