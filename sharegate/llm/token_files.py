"""Token ids as Simple-8b words: selectors pack varying counts of ids into 64-bit words.

A word has a selector in its top 4 bits and 60 bits of data. Selectors 1 to 14 stand for 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2 and
1 ids of 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30 and 60 bits. Selector 0 is the escape: the next word is one id of up
to 64 bits. Ids are packed greedily, as many as fit, and anew in every block of ``BLOCK_IDS``, whose first words are listed, so that
each block is decoded on its own, by arrays.

A file is a Parquet folder, which every store that Spark writes to can hold and Spark can split: a row is a chunk of whole documents
(about ``CHUNK_IDS`` ids; a longer document is a chunk of its own) with
``part`` (range piece of ids) and ``chunk`` (its number there), ``doc_ids`` and ``counts`` in order, ``offsets`` (first word of each block), ``n_ids`` and
``words`` (little-endian uint64). Documents lie in ascending id order over parts and chunks.

Defined results: a null or empty text has only the end id; equal ids lie in text order; a null id comes first; an
empty table gives a file without rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sharegate.llm import tokenize
from sharegate.llm.common import piece_of, quoted, range_bounds, size_estimate

COUNTS = (0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
BLOCK_IDS, CHUNK_IDS, PART_BYTES, MOST_PARTS = 4096, 1 << 18, 4 << 20, 20_000
_U = np.uint64
_COUNT = np.array(COUNTS, np.int64)
_COUNT[0] = 1


def encode(ids: np.ndarray, block: int = BLOCK_IDS) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block) of unsigned ids."""
    ids, n = np.asarray(ids, dtype=_U), len(ids)
    if not n:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    place = np.arange(n)
    room = np.minimum(np.minimum((place // block + 1) * block, n) - place, max(COUNTS)).astype(np.uint8)  # ids left in the block
    top = int(ids.max())
    small = ids.astype(np.uint32) if top < 1 << 32 else ids
    least = np.zeros(n, np.uint8)  # the selectors up to this one are too narrow
    for bits in BITS[1:]:
        if top >> bits:
            least += small >= small.dtype.type(1 << bits)
    widest, seen = least.copy(), 1  # among an id and those behind it, ``seen`` in all
    selector = np.zeros(n, np.uint8)  # 0: escape
    for s in range(14, 0, -1):  # the densest that fits wins
        for k in range(seen, min(COUNTS[s], n)):
            np.maximum(widest[:n - k], least[k:], out=widest[:n - k])
        seen = COUNTS[s]
        fits = (widest < s) & (room >= seen)
        if s < 14 and not fits.any():
            break  # nor does a denser one
        selector[fits] = s
    step = _COUNT[selector].astype(np.uint8).tobytes()
    starts, at = [], 0
    put = starts.append
    while at < n:
        put(at)
        at += step[at]
    starts = np.array(starts)
    chosen = selector[starts]
    length = 1 + (chosen == 0)
    to = np.cumsum(length) - length
    words = np.zeros(int(length.sum()), _U)
    for s in np.unique(chosen):
        mine = chosen == s
        if s == 0:
            words[to[mine] + 1] = ids[starts[mine]]
            continue
        value, at = np.full(mine.sum(), int(s) << 60, _U), starts[mine]
        for k in range(COUNTS[s]):
            value |= ids[at + k] << _U(k * BITS[s])
        words[to[mine]] = value
    return words, to[np.searchsorted(starts, np.arange(0, n, block))]


def decode(words: np.ndarray) -> np.ndarray:
    """Ids of a run of words that starts at a block's first word and ends before another's."""
    words = np.asarray(words, dtype=_U)
    selector = (words >> _U(60)).astype(np.int64)
    maybe = np.flatnonzero(selector == 0)
    raw = np.zeros(len(words), bool)
    if len(maybe):  # a word after an escape is raw, whatever its bits
        last = -1
        for i in maybe.tolist():
            if i != last:
                raw[i + 1], last = True, i + 1
    selector[raw] = 1
    count = np.where(raw, 0, _COUNT[selector])
    at = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), _U)
    for s in np.unique(selector[~raw]):
        mine = np.flatnonzero(~raw & (selector == s))
        if s == 0:
            out[at[mine]] = words[mine + 1]
            continue
        mask = _U((1 << BITS[s]) - 1)
        for k in range(COUNTS[s]):
            out[at[mine] + k] = (words[mine] >> _U(k * BITS[s])) & mask
    return out


def read_ids(words: bytes, offsets, n_ids: int, start: int, stop: int, block: int = BLOCK_IDS) -> np.ndarray:
    """Ids start to stop of a chunk; only the blocks they lie in are decoded."""
    if stop <= start:
        return np.zeros(0, _U)
    w = np.frombuffer(words, "<u8")
    first, last = start // block, (stop - 1) // block
    ids = decode(w[offsets[first]:offsets[last + 1] if last + 1 < len(offsets) else len(w)])
    return ids[start - first * block:stop - first * block]


FILE = "part int, chunk int, doc_ids array<bigint>, counts array<bigint>, n_ids bigint, offsets array<bigint>, words binary"


def write_token_file(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", *, tokenizer: str | None = None) -> None:
    """Encode every whole text and write the ids at ``path``, in ascending order of the integer ``doc_id``."""
    model = tokenizer or tokenize.default_path()
    rows = docs.select(F.col(quoted(doc_id)).cast("long").alias("doc_id"), F.col(quoted(text)).cast("string").alias("text"))
    parts = min(MOST_PARTS, size_estimate(rows, "text", PART_BYTES))
    bounds = range_bounds(rows, "doc_id", parts)
    placed = rows.withColumn("part", piece_of(F.col("doc_id"), bounds)).repartitionByRange(len(bounds) + 1, "part").sortWithinPartitions("part", "doc_id", "text")

    def run(batches):
        each = tokenize.encoder(model).each
        part, chunk, held, docs_, counts, size = None, 0, [], [], [], 0

        def done():
            words, offsets = encode(np.frombuffer(b"".join(held), "<u4"))
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "chunk": pa.array([chunk], pa.int32()), "doc_ids": pa.array([docs_], pa.list_(pa.int64())),
                "counts": pa.array([counts], pa.list_(pa.int64())), "n_ids": pa.array([size], pa.int64()),
                "offsets": pa.array([offsets], pa.list_(pa.int64())), "words": pa.array([words.astype("<u8").tobytes()], pa.binary())})

        for batch in batches:
            for doc, raw, p in zip(batch.column(0).to_pylist(), each(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                if docs_ and (p != part or size + len(raw) // 4 > CHUNK_IDS):
                    yield done()
                    chunk = chunk + 1 if p == part else 0
                    held, docs_, counts, size = [], [], [], 0
                part = p
                held.append(raw)
                docs_.append(doc)
                counts.append(len(raw) // 4)
                size += len(raw) // 4
        if docs_:
            yield done()

    placed.mapInArrow(run, FILE).write.parquet(path)


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, chunk, place (in the chunk), start (ids of all documents before it), n_tokens, ids (little-endian uint32).

    Parts and chunks before a document are added up from their counts: running sums within a part, and one total per
    part, of which there are at most MOST_PARTS."""
    file = spark.read.schema(FILE).parquet(path)
    heads = file.select("part", "chunk", "n_ids")
    before = F.sum("n_ids").over(Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    totals = heads.groupBy("part").agg(F.sum("n_ids").alias("_total"))
    earlier = F.sum("_total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = F.broadcast(totals.select("part", F.coalesce(earlier, F.lit(0)).alias("_earlier")))
    starts = heads.select("part", "chunk", F.coalesce(before, F.lit(0)).alias("_before")).join(parts, "part") \
                  .select("part", "chunk", (F.col("_before") + F.col("_earlier")).alias("_start"))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids = read_ids(r["words"], r["offsets"], r["n_ids"], 0, r["n_ids"]).astype("<u4")
                ends = np.cumsum(r["counts"])
                n = len(ends)
                first = ends - np.array(r["counts"], np.int64)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([r["part"]] * n, pa.int32()), "chunk": pa.array([r["chunk"]] * n, pa.int32()), "place": pa.array(first, pa.int64()),
                    "doc_id": pa.array(r["doc_ids"], pa.int64()), "n_tokens": pa.array(r["counts"], pa.int64()),
                    "ids": pa.array([ids[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary())})

    found = file.mapInArrow(run, "part int, chunk int, place bigint, doc_id bigint, n_tokens bigint, ids binary")
    return found.withColumn("ids_crc32", F.crc32("ids")).join(starts, ["part", "chunk"]) \
                .select("doc_id", "part", "chunk", "place", (F.col("_start") + F.col("place")).alias("start"), "n_tokens", "ids", "ids_crc32")
