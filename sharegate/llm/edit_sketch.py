"""Document fingerprints by randomised edit embedding, with bit-sampled banding and verification.

A shared random walk reads a text: at step j it stays on the current character or moves to the next one, as a random
bit of (j, character) says. Texts at a small edit distance fall into step again soon after an edit, so their walks show
the same character at most steps: edit distance becomes Hamming distance. A fingerprint samples ``SAMPLES`` steps of the walk, one byte of the
character's hash each. Sample t looks at the last of its own record steps before the end of the walk; the records of a random
order are the same for all texts, so texts of nearly equal length look at the same steps, and each step is equally
likely. The likeness of two fingerprints is the share of equal samples.

The random bits repeat after ``PERIOD`` steps and treat characters of one of ``CLASSES`` classes alike.

``with_next_edit`` orders documents by id over range pieces and gives each its next one; ``near_classes`` and ``with_classes`` band and verify.
Fingerprints with a likeness of 0.8 differ in at most 25 samples, so of 32 bands of four samples 7 are equal in both, and of six groups
of bands one holds two of those: a key for each two bands of a group (70 keys of eight samples) misses no pair, and texts that
are not alike hardly ever share one. Keys travel packed, six bytes each. The members of a key meet in one task, with their fingerprints, as a
tile; the key of a large crowd is cut into parts, and each two parts are a tile. A tile gives the links of a spanning forest, no more than it has members:
classes grow from one member to the next, and only members that no class has reached are compared, so a crowd costs its members
times those that are not like it, less those whose distance from the class's first member tells that they are not.

Defined results: a null text is empty; an empty text has the fingerprint of zeros, like only another empty text; equal texts have equal
fingerprints; rows with equal ids are ordered by text; a null id comes first, and a class is named by its smallest id, which is null
only where no member has one; an empty table gives an empty one. Texts
of any length are read whole.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sharegate.llm import dartminhash
from sharegate.llm.common import piece_of, quoted, range_bounds, size_estimate, stored, text_of

SAMPLES, PERIOD, CLASSES = 128, 4096, 64
CELLS = 1 << 23  # padded characters that walk together
PART_BYTES, MOST_PARTS, CHUNK_CHARS = 4 << 20, 20_000, 4_000_000
FIRST_ID = -(1 << 63)


def _class_of(codes: np.ndarray) -> np.ndarray:
    x = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Walk:
    """The shared random choices, made from a seed."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        moves = rng.integers(0, 2, (CLASSES, PERIOD), dtype=np.int8)
        # steps from j until the walk leaves a character: distance to the next move, at least 1
        far = np.where(np.tile(moves, 2) == 1, np.arange(2 * PERIOD), 4 * PERIOD)
        far = np.minimum.accumulate(far[:, ::-1], axis=1)[:, ::-1][:, :PERIOD]
        self.stay = (far - np.arange(PERIOD) + 1).astype(np.int32).reshape(-1)
        self.records = []
        for _ in range(SAMPLES):
            at, found = 0, []
            while at < 1 << 40:
                found.append(at)
                at = max(at + 1, int((at + 1) / rng.random()))
            self.records.append(np.array(found, np.int64))

    def fingerprints(self, texts: list[str]) -> np.ndarray:
        """Texts x SAMPLES bytes."""
        out = np.zeros((len(texts), SAMPLES), np.uint8)
        order = sorted((i for i, t in enumerate(texts) if t), key=lambda i: -len(texts[i]))
        at = 0
        while at < len(order):
            width = max(1, min(len(order) - at, CELLS // len(texts[order[at]])))
            self._together([texts[i] for i in order[at:at + width]], order[at:at + width], out)
            at += width
        return out

    def _together(self, texts: list[str], rows: list[int], out: np.ndarray) -> None:
        """``texts`` from the longest to the shortest, one character of each at a time."""
        codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        sizes = np.array([len(c) for c in codes])
        kind = np.zeros((sizes[0], len(texts)), np.int32)
        hashed = []
        for k, c in enumerate(codes):
            h = _class_of(c)
            kind[: len(c), k] = ((h >> np.uint64(40)) % np.uint64(CLASSES)).astype(np.int32) * PERIOD
            hashed.append((1 + (h >> np.uint64(20)) % np.uint64(255)).astype(np.uint8))
        step = np.zeros((sizes[0] + 1, len(texts)), np.int64 if sizes[0] > 1 << 27 else np.int32)
        active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # texts longer than i
        for i in range(sizes[0]):
            n = active[i]
            now = step[i, :n]
            np.add(now, self.stay.take(kind[i, :n] + (now & (PERIOD - 1))), out=step[i + 1, :n])
        ends = step[sizes, np.arange(len(texts))]
        seen = np.empty((SAMPLES, len(texts)), np.int64)
        for t, r in enumerate(self.records):
            seen[t] = r[np.searchsorted(r, ends, side="left") - 1]
        for k, row in enumerate(rows):
            place = np.searchsorted(step[: sizes[k] + 1, k], seen[:, k], side="right") - 1
            out[row] = hashed[k][place]


_walks: dict[int, Walk] = {}


def walk(seed: int = 1) -> Walk:
    if seed not in _walks:
        _walks[seed] = Walk(seed)
    return _walks[seed]


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) characters give way to the first as many (or all) of the next document."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _pack_parts(batches):
    """Rows of a batch by their part, compressed together: a quarter of the bytes of single texts."""
    for batch in batches:
        part = batch.column("part").to_numpy()
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.append(True, part[order][1:] != part[order][:-1])).tolist() if len(part) else []
        blobs = []
        for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True):
            sink = pa.BufferOutputStream()
            rows = batch.select(["guest", "key", "text", "doc_id"]).take(pa.array(order[a:b]))
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(rows)
            blobs.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(part[order][cuts], pa.int32()), pa.array(blobs, pa.binary())], names=["part", "rows"])


def _unpack(blob: bytes):
    rows = pa.ipc.open_stream(blob).read_all()
    return zip(*(rows.column(c).to_pylist() for c in ("guest", "key", "text", "doc_id")), strict=True)


def with_next_edit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hexadecimal), near_edited, near_next.

    Texts are shuffled once, to range pieces of ids. The first document of each piece also goes to the piece before it, so
    that every document sits beside its next one; the driver learns only which pieces have rows."""
    rows = docs.select(F.col(quoted(doc_id)).cast("long").alias("doc_id"), text_of(text).alias("text"),
                       F.coalesce(F.col(quoted(doc_id)).cast("long"), F.lit(FIRST_ID)).alias("key"))
    bounds = range_bounds(rows, "key", min(MOST_PARTS, size_estimate(rows, "text", PART_BYTES)))
    placed = rows.withColumn("part", piece_of(F.col("key"), bounds))
    firsts = {r["part"]: r["key"] for r in placed.groupBy("part").agg(F.min("key").alias("key")).collect()}  # at most MOST_PARTS numbers
    parts = sorted(firsts)
    before = [(parts[k - 1], firsts[p]) for k, p in enumerate(parts)]
    heads = F.broadcast(docs.sparkSession.createDataFrame(before, "_to int, key long"))
    guests = placed.join(heads, "key").groupBy("_to", "key").agg(F.min("text").alias("text"), F.first("doc_id").alias("doc_id"))
    everyone = placed.select("part", F.lit(0).alias("guest"), "key", "text", "doc_id") \
                     .unionByName(guests.select(F.col("_to").alias("part"), F.lit(1).alias("guest"), "key", "text", "doc_id"))
    packed = everyone.mapInArrow(_pack_parts, "part int, rows binary").repartition(len(bounds) + 1, "part").sortWithinPartitions("part")

    def sketch(ids, texts, following):
        """Rows of the texts; ``following`` is the next of the last."""
        n = len(texts)
        nexts = [*texts[1:], following]
        other = [edited(a, b) for a, b in zip(texts, nexts, strict=True)]
        prints = walk().fingerprints([*texts, following, *other])
        own, after, edits = prints[:n], prints[1:n + 1], prints[n + 1:]
        hexes = [p.tobytes().hex() for p in own]
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array(ids, pa.int64()), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in other],
            "fingerprint": hexes, "edited_fingerprint": [p.tobytes().hex() for p in edits],
            "near_edited": (own == edits).mean(axis=1), "near_next": (own == after).mean(axis=1)})

    def sketched(blobs):
        """The documents of one part in order; its guest, if any, comes last and is only a neighbour."""
        rows = sorted((row for b in blobs for row in _unpack(b)), key=lambda r: (r[0], r[1], r[2].encode("utf-8", "surrogatepass")))
        own = [r for r in rows if not r[0]]
        following = rows[len(own)][2] if len(own) < len(rows) else own[0][2]  # the very last is followed by the very first
        start = held = 0
        for k, row in enumerate(own):
            held += len(row[2])
            if held > CHUNK_CHARS or k == len(own) - 1:
                yield sketch([r[3] for r in own[start:k + 1]], [r[2] for r in own[start:k + 1]], own[k + 1][2] if k + 1 < len(own) else following)
                start, held = k + 1, 0

    def run(batches):
        part, blobs = None, []
        for batch in batches:
            for p, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if blobs and p != part:
                    yield from sketched(blobs)
                    blobs = []
                part = p
                blobs.append(blob)
        if blobs:
            yield from sketched(blobs)

    return packed.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                                   "near_edited double, near_next double")


def fingerprinted(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input with ``fingerprint`` (bytes)."""
    docs = docs.drop("fingerprint")
    columns = docs.columns

    def run(batches):
        for batch in batches:
            prints = walk().fingerprints([t or "" for t in batch.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array([p.tobytes() for p in prints], pa.binary())], names=[*columns, "fingerprint"])

    return docs.mapInArrow(run, docs.withColumn("fingerprint", F.lit(None).cast("binary")).schema)


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, likeness: float = 0.8) -> DataFrame:
    """(doc_id, class_id): connected classes of fingerprints with the likeness, the class id being the smallest id."""
    rows = stored(fingerprinted(docs.select(F.col(quoted(doc_id)).cast("long").alias("doc_id"), text_of(text).alias("text"))).select("doc_id", "fingerprint"))
    return rows.join(print_classes(rows, likeness=likeness), "fingerprint").select("doc_id", "class_id")


def with_classes(rows: DataFrame, *, likeness: float = 0.8) -> DataFrame:
    """The rows of ``with_next_edit`` with ``class_id`` as in ``near_classes``."""
    rows = stored(rows)
    prints = rows.select("doc_id", F.unhex("fingerprint").alias("fingerprint"))
    found = print_classes(prints, likeness=likeness).select(F.lower(F.hex("fingerprint")).alias("fingerprint"), "class_id")
    return rows.join(found, "fingerprint").select(*rows.columns, "class_id")


BANDS, SLICE_KEYS, TILE, LINK_ROWS = 32, 1 << 20, 1 << 14, 1 << 14


def band_pairs(likeness: float) -> list[tuple[int, int]]:
    """Two bands for each key. With ``d`` differing samples BANDS - d bands are equal; spread over one group less than that, two of them share a group."""
    clean = BANDS - (SAMPLES - math.ceil(likeness * SAMPLES))
    if clean < 2:
        raise ValueError(f"a likeness above {1 - (BANDS - 2) / SAMPLES} is needed")
    groups = min(clean - 1, BANDS // 2)
    return [pair for g in range(groups) for pair in itertools.combinations(range(g, BANDS, groups), 2)]


def _key_blobs(pairs: list[tuple[int, int]], slices: int):
    """(nid, fingerprint) to rows of packed keys: per batch and slice the ids of the batch, and for each key its id's place and 32 bits."""
    first, second = (np.array(x) for x in zip(*pairs, strict=True))
    salt = np.random.default_rng(7).integers(0, 1 << 63, len(pairs), np.uint64)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 14):
                piece = batch.slice(at, 1 << 14)
                bands = np.frombuffer(b"".join(piece.column("fingerprint").to_pylist()), "<u4").reshape(-1, BANDS).astype(np.uint64)
                key = (bands[:, first] << np.uint64(32) | bands[:, second]) ^ salt
                for shift, factor in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
                    key = (key ^ key >> np.uint64(shift)) * np.uint64(factor)
                key = (key ^ key >> np.uint64(32)).reshape(-1)
                where = (key >> np.uint64(32)) % np.uint64(slices)
                order = np.argsort(where, kind="stable")
                cuts = np.searchsorted(where[order], np.arange(slices + 1))
                ids = zlib.compress(np.diff(piece.column("nid").to_numpy(), prepend=0).astype("<i8").tobytes(), 1)
                place, bits = (order // len(pairs)).astype("<u2"), key[order].astype("<u4")  # the low half
                full = [s for s in range(slices) if cuts[s] < cuts[s + 1]]
                yield pa.RecordBatch.from_pydict({
                    "slice": pa.array(full, pa.int32()), "ids": pa.array([ids] * len(full), pa.binary()),
                    "place": pa.array([place[cuts[s]:cuts[s + 1]].tobytes() for s in full], pa.binary()),
                    "bits": pa.array([bits[cuts[s]:cuts[s + 1]].tobytes() for s in full], pa.binary())})

    return run


def _tiles(most: int):
    """Keys with company, slice by slice, as tiles (tile, nid) named by a hash of their members, so that equal sets are one tile. A key with up to
    twice ``most`` members is one tile; of a larger one every two parts of ``most`` members are one, so that each two members meet."""
    def met(blobs):
        bits = np.concatenate([np.frombuffer(b[2], "<u4") for b in blobs])
        nid = np.concatenate([np.cumsum(np.frombuffer(zlib.decompress(b[0]), "<i8"))[np.frombuffer(b[1], "<u2")] for b in blobs])
        order = np.lexsort((nid, bits))
        bits, nid = bits[order], nid[order]
        start = np.flatnonzero(np.append(True, bits[1:] != bits[:-1]))
        size = np.diff(np.append(start, len(bits)))
        hashed = dartminhash._mix(nid.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        name = np.add.reduceat(hashed, start)
        kept = np.flatnonzero(size >= 2)
        kept = kept[np.unique(np.stack([nid[start[kept]].astype(np.uint64), name[kept]]), axis=1, return_index=True)[1]]
        whole, of = np.zeros(len(start), bool), np.repeat(np.arange(len(start)), size)
        whole[kept[size[kept] <= 2 * most]] = True
        inside = whole[of]
        yield rows(name[of[inside]], nid[inside])
        for k in kept[size[kept] > 2 * most].tolist():
            members = np.arange(start[k], start[k] + size[k])
            for x, y in itertools.combinations(np.array_split(members, -(-len(members) // most)), 2):
                both = np.append(x, y)
                yield rows(np.full(len(both), hashed[both].sum()), nid[both])

    def rows(tile, nid):
        return pa.RecordBatch.from_arrays([pa.array(tile.view(np.int64)), pa.array(nid, pa.int64())], names=["tile", "nid"])

    def run(batches):
        number, blobs = None, []
        for batch in batches:
            for s, *blob in zip(*(batch.column(c).to_pylist() for c in ("slice", "ids", "place", "bits")), strict=True):
                if blobs and s != number:
                    yield from met(blobs)
                    blobs = []
                number = s
                blobs.append(blob)
        if blobs:
            yield from met(blobs)

    return run


def _forest(prints: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Links that join the members of a tile as all its pairs with ``least`` equal samples would: one for each member but the first of a class.

    A member is compared only with those that no class has reached yet, and of these only with those that lie about as far from the
    class's first member as it does itself: distances differ by no more than the two are apart."""
    apart = prints.shape[1] - least
    left, links = np.arange(len(prints)), []
    while len(left) > 1:
        first, left = left[0], left[1:]
        off = (prints[left] != prints[first]).sum(axis=1)
        near = off <= apart
        todo = list(zip(left[near].tolist(), off[near].tolist(), strict=True))
        links += [(int(first), k) for k, _ in todo]
        left, off = left[~near], off[~near]
        while todo and len(left):
            k, own = todo.pop()
            may = np.flatnonzero(np.abs(off - own) <= apart)
            near = may[(prints[left[may]] != prints[k]).sum(axis=1) <= apart]
            if len(near):
                found = left[near].tolist()
                links += [(k, x) for x in found]
                todo += zip(found, off[near].tolist(), strict=True)
                left, off = np.delete(left, near), np.delete(off, near)
    return links


def _linked(least: int):
    """(tile, nid, fingerprint) sorted by tile to the links (a, b) of each tile."""
    def links_of(pieces):
        nid, prints = (np.concatenate(x) for x in zip(*pieces, strict=True))
        order = np.argsort(nid)
        found = np.array(_forest(prints[order], least), np.int64).reshape(-1, 2)
        return np.sort(nid[order][found], axis=1)

    def rows_of(found):
        ends = np.concatenate(found)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

    def run(batches):
        now, pieces, found, held = None, [], [], 0
        for batch in batches:
            tile, nid = batch.column("tile").to_numpy(), batch.column("nid").to_numpy()
            prints = np.frombuffer(b"".join(batch.column("fingerprint").to_pylist()), np.uint8).reshape(-1, SAMPLES)
            cuts = [*np.flatnonzero(np.append(True, tile[1:] != tile[:-1])).tolist(), len(tile)] if len(tile) else []
            for x, y in itertools.pairwise(cuts):
                if pieces and tile[x] != now:
                    found.append(links_of(pieces))
                    held += len(found[-1])
                    pieces = []
                    if held > LINK_ROWS:
                        yield rows_of(found)
                        found, held = [], 0
                now = tile[x]
                pieces.append((nid[x:y], prints[x:y]))
        if pieces:
            found.append(links_of(pieces))
        if found:
            yield rows_of(found)

    return run


def print_classes(rows: DataFrame, *, likeness: float = 0.8, tile: int = TILE) -> DataFrame:
    """(fingerprint, class_id) of each fingerprint of (doc_id, fingerprint). Equal fingerprints are one node; no pair with the likeness is missed."""
    pairs = band_pairs(likeness)
    nodes = stored(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id")).withColumn("nid", F.monotonically_increasing_id()))  # written once, so it stays
    slices = max(1, -(-nodes.count() * len(pairs) // SLICE_KEYS))
    keys = nodes.select("nid", "fingerprint").mapInArrow(_key_blobs(pairs, slices), "slice int, ids binary, place binary, bits binary")
    tiles = keys.repartition(slices, "slice").sortWithinPartitions("slice").mapInArrow(_tiles(tile), "tile long, nid long").distinct()
    members = tiles.join(nodes.select("nid", "fingerprint"), "nid").select("tile", "nid", "fingerprint")
    links = members.repartition("tile").sortWithinPartitions("tile").mapInArrow(_linked(math.ceil(likeness * SAMPLES)), "a long, b long")
    label = dartminhash.components(links.distinct())
    named = stored(nodes.join(label.withColumnRenamed("node", "nid"), "nid", "left").select("fingerprint", "doc_id", F.coalesce("label", "nid").alias("label")))
    return named.join(named.groupBy("label").agg(F.min("doc_id").alias("class_id")), "label").select("fingerprint", "class_id")
