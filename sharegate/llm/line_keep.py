"""Line deduplication that returns keep bitmaps: range-partitioned hashes, documents in order, first occurrences streamed.

A line's key is the line without ASCII white space at both ends, with A-Z in lower case. Keys of at least ``least_chars`` code
points that ``least_docs`` documents hold lose all their lines except those in the document with the largest id.

``long_lines`` turns every line that may go into a row of numbers: 128 bits of its key's hash, document, position. These
rows, not texts, are range-partitioned by (hash, document from the largest id, position) and sorted within the pieces, so that a key
that a third of all lines have is spread over as many pieces as its rows fill. A piece is streamed once: the first document
of a key is the one that keeps its lines, the others go once enough documents have passed. Only the first and the last
key of a piece can reach into its neighbours; their rows wait, and one summary row each (documents, first and last
document) is added up per key over at most two rows per piece. Positions that go are folded into one compressed bitmap per document.

Defined results: a null or empty text is one empty line, which stays; documents are counted by id, so rows with an id in common
are one document (its lines stay or go together) and each keeps a bitmap of its own text; a null id counts as one
document with the smallest id; repeated rows give repeated results; a line repeated within the document that keeps
it stays repeated; an empty table gives an empty one. Texts and lines of any length are read whole. Other columns of the input are kept by
``without_repeated_lines`` unless they have the name of a result. Keys are compared by 128 bits.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sharegate.llm.common import quoted, stored, text_of
from sharegate.operators.joins import lookup_join

LEAST_CHARS, LEAST_DOCS = 40, 5
PIECE_ROWS = 250_000  # about 10 MB of numbers
FIRST_ID = -(1 << 63)
RESULTS = ("n_lines", "n_dropped", "keep", "kept_text")


def key_of(line: bytes) -> bytes:
    """UTF-8 key of a UTF-8 line. ``bytes`` methods strip and lower ASCII only."""
    return line.strip().lower()


def chars_of(utf8: bytes) -> int:
    """Code points: bytes that do not continue one."""
    return len(utf8) if utf8.isascii() else int((np.frombuffer(utf8, np.uint8) & 0xC0 != 0x80).sum())


def _identified(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(_doc, _row, _text): the id as a number, and a hash that tells texts with the same id apart."""
    return docs.select("*", F.coalesce(F.col(quoted(doc_id)).cast("long"), F.lit(FIRST_ID)).alias("_doc"), text_of(text).alias("_text")) \
               .withColumn("_row", F.xxhash64("_text"))


def long_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(h0, h1, doc, row, pos, n_lines) of every line whose key has ``least_chars`` code points."""
    def run(batches):
        for batch in batches:
            at, hashes, pos, counts = [], [], [], []
            for k, value in enumerate(batch.column("_text").to_pylist()):
                lines = value.encode("utf-8", "surrogatepass").split(b"\n")
                for p, line in enumerate(lines):
                    key = key_of(line) if len(line) >= least_chars else b""
                    if len(key) >= least_chars and chars_of(key) >= least_chars:
                        at.append(k)
                        pos.append(p)
                        counts.append(len(lines))
                        hashes.append(xxhash.xxh3_128_digest(key))
            h = np.frombuffer(b"".join(hashes), ">i8").astype(np.int64).reshape(-1, 2)
            who = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[:, 0]), pa.array(h[:, 1]), batch.column("_doc").take(who), batch.column("_row").take(who), pa.array(pos, pa.int32()), pa.array(counts, pa.int32())],
                names=["h0", "h1", "doc", "row", "pos", "n_lines"])

    rows = _identified(docs.select(quoted(doc_id), quoted(text)), doc_id, text).select("_doc", "_row", "_text")
    return rows.mapInArrow(run, "h0 long, h1 long, doc long, row long, pos int, n_lines int")


def settle_piece(h0, h1, doc, least_docs: int):
    """What a sorted piece knows: rows that go, rows that wait, and (start, documents, last document) of its first and last key."""
    n = len(h0)
    new_key = np.concatenate([[True], (h0[1:] != h0[:-1]) | (h1[1:] != h1[:-1])])
    new_doc = new_key.copy()
    new_doc[1:] |= doc[1:] != doc[:-1]
    starts = np.flatnonzero(new_key)
    of = np.cumsum(new_key) - 1
    docs = np.add.reduceat(new_doc.astype(np.int64), starts)
    ends = np.concatenate([starts[1:], [n]]) - 1
    waits = (of == 0) | (of == len(starts) - 1)
    gone = ~waits & (docs[of] >= least_docs) & (doc != doc[starts][of])
    border = sorted({0, len(starts) - 1})
    return gone, waits, [(starts[k], docs[k], doc[ends[k]]) for k in border]


GONE, WAITS, SUMMARY = 0, 1, 2


def repeated_lines(lines: DataFrame, *, least_docs: int = LEAST_DOCS, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(doc, row, pos, n_lines) of the lines that go."""
    lines = stored(lines)
    pieces = max(1, -(-lines.count() // piece_rows))
    order = ["h0", "h1", F.desc("doc"), "row", "pos"]
    placed = lines.repartitionByRange(pieces, *order).sortWithinPartitions(*order)
    names = ["kind", "h0", "h1", "doc", "row", "pos", "n_lines", "docs", "last"]

    def run(batches):
        piece = pa.Table.from_batches(batches) if (batches := [b for b in batches if b.num_rows]) else None
        if piece is None:
            return
        a = {c: piece.column(c).to_numpy() for c in piece.column_names}
        gone, waits, border = settle_piece(a["h0"], a["h1"], a["doc"], least_docs)
        for kind, rows in ((GONE, np.flatnonzero(gone)), (WAITS, np.flatnonzero(waits))):
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), kind, np.int8)), *(pa.array(a[c][rows]) for c in names[1:7]), none, none], names=names)
        at, docs, last = (np.array(x, np.int64) for x in zip(*border, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), SUMMARY, np.int8)), *(pa.array(a[c][at]) for c in names[1:7]), pa.array(docs), pa.array(last)], names=names)

    settled = stored(placed.mapInArrow(run, "kind byte, h0 long, h1 long, doc long, row long, pos int, n_lines int, docs long, last long"))
    # at most two rows per piece; a document at the end of one piece and the start of the next is one document
    along = Window.partitionBy("h0", "h1").orderBy(F.desc("doc"), F.desc("last"))
    again = (F.lag("last").over(along) == F.col("doc")).cast("int")
    border = settled.where(F.col("kind") == SUMMARY).select("h0", "h1", "doc", "docs", F.coalesce(again, F.lit(0)).alias("again")) \
                    .groupBy("h0", "h1").agg(F.max("doc").alias("keeps"), F.sum(F.col("docs") - F.col("again")).alias("n")).where(F.col("n") >= least_docs)
    waiting = settled.where(F.col("kind") == WAITS).select("h0", "h1", "doc", "row", "pos", "n_lines")
    late = lookup_join(waiting, stored(border.select("h0", "h1", "keeps")), ["h0", "h1"], "inner", spread_by="row").where("doc <> keeps")
    columns = ["doc", "row", "pos", "n_lines"]
    return settled.where(F.col("kind") == GONE).select(*columns).unionByName(late.select(*columns))


def pack_bits(kept: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(kept).tobytes(), 6)


def unpack_bits(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), count=n).astype(bool)


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS,
                 piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(doc, row, n_lines, n_dropped, keep) of the documents that lose a line: ``keep`` is a zlib-compressed bitmap with a bit per line. ``doc``
    is the id and ``row`` the hash of the text, as ``apply_bitmaps`` looks them up."""
    gone = repeated_lines(long_lines(docs, doc_id, text, least_chars=least_chars), least_docs=least_docs, piece_rows=piece_rows)
    per = gone.groupBy("doc", "row").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("at"))

    def run(batches):
        for batch in batches:
            packed, dropped = [], []
            for n, at in zip(batch.column("n_lines").to_pylist(), batch.column("at"), strict=True):
                kept = np.ones(n, bool)
                kept[at.values.to_numpy()] = False
                dropped.append(len(at))
                packed.append(pack_bits(kept))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("row"), batch.column("n_lines"), pa.array(dropped, pa.int32()), pa.array(packed, pa.binary())],
                                             names=["doc", "row", "n_lines", "n_dropped", "keep"])

    return per.mapInArrow(run, "doc long, row long, n_lines int, n_dropped int, keep binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs`` with n_lines, n_dropped (long) and kept_text. Texts meet their bitmaps on (id, hash of the text)."""
    docs = docs.drop(*(c for c in RESULTS if c in docs.columns))
    columns = docs.columns
    rows = _identified(docs, doc_id, text)
    own = bitmaps.select(F.col("doc").alias("_doc"), F.col("row").alias("_row"), F.col("keep").alias("_keep"))
    met = rows.join(own, ["_doc", "_row"], "left").select(F.struct(*(F.col(quoted(c)) for c in columns)).alias("_in"), "_text", "_keep")

    def run(batches):
        for batch in batches:
            total, dropped, kept_texts = [], [], []
            for value, keep in zip(batch.column("_text").to_pylist(), batch.column("_keep").to_pylist(), strict=True):
                n = value.count("\n") + 1
                total.append(n)
                if keep is None:
                    dropped.append(0)
                    kept_texts.append(value)
                    continue
                bits = unpack_bits(keep, n)
                dropped.append(n - int(bits.sum()))
                kept_texts.append("\n".join(line for line, b in zip(value.split("\n"), bits.tolist(), strict=True) if b))
            yield pa.RecordBatch.from_arrays([batch.column("_in"), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept_texts, pa.string())],
                                             names=["_in", "n_lines", "n_dropped", "kept_text"])

    schema = met.select("_in").withColumns({"n_lines": F.lit(0).cast("long"), "n_dropped": F.lit(0).cast("long"), "kept_text": F.lit("")}).schema
    return met.mapInArrow(run, schema).select("_in.*", "n_lines", "n_dropped", "kept_text")


def without_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """Every row with n_lines, n_dropped and kept_text, by bitmaps made from the same rows."""
    return apply_bitmaps(docs, stored(keep_bitmaps(docs, doc_id, text, **limits)), doc_id, text)
