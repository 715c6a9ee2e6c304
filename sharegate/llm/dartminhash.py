"""MinHash near-duplicates by DartMinHash: sparse signatures of weighted sets, banded into candidates, verified exactly.

Every element of a document owns a region of width weight and unlimited rank. Darts fall on it at one per unit of area, placed
by hashes of (element, cell), so equal elements of two documents hold equal darts. Each dart belongs to one of
``BANDS * ROWS`` coordinates; a coordinate keeps its dart of the least rank, and two documents agree in a coordinate with the
probability of their weighted Jaccard similarity. Only ranks up to (k ln k + 2 k) / weight are thrown at first, so a document
costs about its size or k ln k, whichever is larger; empty coordinates throw on.

Elements are runs of ``SHINGLE`` words (all words, if there are fewer). Their weight is 1, that is, plain Jaccard, or with ``counted`` the
number of times the text holds them: sum of lesser counts over sum of greater counts. Texts
with equal words are one node. Nodes that share a band form a bucket; its members are compared with one centre, another for each band,
so that a bucket costs as many comparisons as it has members. The members of buckets that are not one class after that are joined on
the rare beginnings of their shingle sets (``prefix_pairs``), which finds every link between them. All comparisons are exact. Classes are the connected
components of verified links, found by star contraction.

At similarity 0.8 two nodes share no band of 6 in 40 with probability 5e-6; no other link is lost. Tests measure it against all pairs.

Defined results: a null or empty text has no words and is a class of its own; repeated rows and copies share a class; the
class id is the smallest id in it; a null id counts as larger than all; an empty table gives an empty one; other
columns of the input do not matter and are kept.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sharegate.llm.common import WORD, quoted, stored, text_of
from sharegate.operators.joins import lookup_join

SHINGLE, SIMILARITY = 5, (4, 5)  # as a fraction: at least 4 / 5
BANDS, ROWS = 40, 6
STEP = 1.05  # ratio of size classes
SLICE_CELLS = 1 << 20
NO_ID = (1 << 63) - 1
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _poisson_table() -> np.ndarray:
    """Number of darts in a cell of area 1, by 16 hash bits."""
    p = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])
    return np.searchsorted(p, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.int64)


_DARTS = _poisson_table()


def _places(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and running number within it, for counts[i] copies of each i."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def _throw(sig: np.ndarray, elements, weights, owner, low, high, k: int) -> None:
    """Lower ``sig`` (documents x k) by the darts of rank low[document] <= rank < high[document]."""
    cell, w = _places(np.ceil(weights).astype(np.int64))
    key = _mix(elements[cell] + w.astype(_U) * _U(0x9E3779B97F4A7C15))
    part = np.minimum(weights[cell] - w, 1.0)
    doc = owner[cell]
    at, r = _places((high - low)[doc])
    rank, doc, part = r + low[doc][at], doc[at], part[at]
    seed = _mix(key[at] ^ _mix(rank.astype(_U) + _U(0xD1B54A32D192ED03)))
    hit, j = _places(_DARTS[(seed & _U(0xFFFF)).astype(np.int64)])
    dart = _mix(seed[hit] + (j + 1).astype(_U) * _U(0xC2B2AE3D27D4EB4F))
    coordinate = (((dart & _U(0xFFFFFF)) * _U(k)) >> _U(24)).astype(np.int64)
    value = rank[hit] + (dart >> _U(24)).astype(np.float64) * 2.0**-40
    place = doc[hit] * k + coordinate
    if (part < 1).any():
        inside = (_mix(dart) >> _U(11)).astype(np.float64) * 2.0**-53 < part[hit]
        place, value = place[inside], value[inside]
    np.minimum.at(sig.reshape(-1), place, value)


def signatures(elements: np.ndarray, lengths: np.ndarray, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Documents x k least ranks. ``elements`` are 64-bit hashes of the documents' elements one after another, each at
    most once in a document; a document without weight keeps infinities."""
    weights = np.ones(len(elements)) if weights is None else weights
    sig = np.full((len(lengths), k), np.inf)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    total = np.bincount(owner, weights, len(lengths)) if len(owner) else np.zeros(len(lengths))
    live = np.flatnonzero(total > 0)
    low = np.zeros(len(lengths), np.int64)
    high = np.ceil((k * math.log(k) + 2 * k) / np.maximum(total, 1e-9)).astype(np.int64)
    while len(live):
        for some in _slices(np.maximum(total[live], 1) * (high - low)[live]):
            docs = live[some[0]:some[1]]
            mine = np.isin(owner, docs) if len(docs) < len(lengths) else np.ones(len(owner), bool)
            _throw(sig, elements[mine], weights[mine], owner[mine], low, high, k)
        live = live[np.isinf(sig[live]).any(axis=1)]
        low[live], high[live] = high[live], 2 * high[live]
    return sig


def _slices(sizes: np.ndarray):
    first, total = 0, 0.0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > SLICE_CELLS:
            yield first, i
            first, total = i, 0.0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Documents x bands hashes of ``rows`` coordinates each."""
    bits = np.ascontiguousarray(sig).view(_U).reshape(len(sig), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=_U) * _U(0x9E3779B97F4A7C15), (len(sig), bands)).copy()
    for j in range(rows):
        out = _mix(out ^ bits[:, :, j])
    return out.view(np.int64)


def weighted_elements(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct elements of each document one after another, their number in each document, and how often each occurs."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    return values[at], np.bincount(owner[at], minlength=len(lengths)), np.diff(np.append(at, len(values))).astype(np.float64)


def bag_as_set(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Every further occurrence of an element in a document becomes an element of its own, so that sets compare like bags."""
    elements, sizes, weights = weighted_elements(values, lengths)
    at, turn = _places(weights.astype(np.int64))
    return np.where(turn > 0, _mix(elements[at] ^ _mix(turn.astype(_U) * _U(0x9E3779B97F4A7C15))), elements[at])


def _bags(batches):
    for batch in batches:
        column = batch.column("s")
        sizes = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
        bags = bag_as_set(column.flatten().to_numpy(zero_copy_only=False).view(_U), sizes).view(np.int64)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("nid"), pa.ListArray.from_arrays(offsets, pa.array(bags))], names=["nid", "s"])


def _sign(batches, counted: bool = False):
    for batch in batches:
        column = batch.column("_s")
        sizes = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
        values, at = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])
        for a, b in _slices(np.maximum(sizes, 1500)):
            mine, lengths, weights = values[at[a]:at[b]].view(_U), sizes[a:b], None
            if counted:
                mine, lengths, weights = weighted_elements(mine, lengths)
            bands = band_hashes(signatures(mine, lengths, BANDS * ROWS, weights), BANDS, ROWS)
            bands = pa.FixedSizeListArray.from_arrays(pa.array(bands.reshape(-1)), BANDS).cast(pa.list_(pa.int64()))
            rest = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([rest.column("doc"), rest.column("node"), bands], names=["doc", "node", "bands"])


def shingles(words: Column) -> Column:
    """Hashes of runs of SHINGLE words, of all words if there are fewer, of none if there are none."""
    size = F.size(words)
    runs = F.transform(F.sequence(F.lit(0), size - SHINGLE), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(SHINGLE))))
    return F.when(size >= SHINGLE, runs).when(size > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))


def _nodes(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc, node (digest of the words; null without words), _w."""
    rows = docs.select(F.coalesce(F.col(quoted(doc_id)).cast("long"), F.lit(NO_ID)).alias("doc"),
                       F.regexp_extract_all(text_of(text), F.lit(WORD), F.lit(0)).alias("_w"))
    return rows.select("doc", F.when(F.size("_w") > 0, F.unhex(F.md5(F.array_join("_w", " ")))).alias("node"), "_w")


def star_pairs(members: DataFrame, key: str, spin: Column) -> DataFrame:
    """Pairs (a, b) of each member ``nid`` and the centre of its bucket, a < b, once. The centre has the least ``spin``. With
    a column ``label`` only members of another label than the centre's are paired."""
    extra = [c for c in ("label",) if c in members.columns]
    m = members.select(key, "nid", *extra, spin.alias("_spin"))
    centre = stored(m.groupBy(key).agg(F.min(F.struct("_spin", "nid", *extra)).alias("_c"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
                    .select(key, F.col("_c.nid").alias("_centre"), *(F.col(f"_c.{c}").alias(f"_{c}") for c in extra)))
    pairs = m.join(centre, key).where("nid <> _centre" + "".join(f" AND {c} <> _{c}" for c in extra))
    return pairs.select(F.least("nid", "_centre").alias("a"), F.greatest("nid", "_centre").alias("b")).distinct()


def _sets(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame, counted: bool = False) -> DataFrame:
    """(nid, s): distinct shingles of the wanted nodes, from the first document of each; ``counted``: a repeated one as often as it occurs.
    Texts are not shuffled while the list of wanted nodes is small enough to send; beyond that they are joined by (node, doc)."""
    rows = docs.select(F.coalesce(F.col(quoted(doc_id)).cast("long"), F.lit(NO_ID)).alias("doc"), text_of(text).alias("_t"))
    words = F.regexp_extract_all("_t", F.lit(WORD), F.lit(0))
    named = rows.withColumn("node", F.unhex(F.md5(F.array_join(words, " "))))
    found = lookup_join(named, wanted, ["node", "doc"], "inner", spread_by="doc", salts=1).select("nid", words.alias("_w"))  # a key is there once: no salt
    if counted:
        return found.select("nid", shingles(F.col("_w")).alias("s")).mapInArrow(_bags, "nid long, s array<bigint>")
    return found.select("nid", F.array_distinct(shingles(F.col("_w"))).alias("s"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose shingle sets have the similarity."""
    sized = sets.select("nid", F.size("s").alias("n"), "s")
    num, den = SIMILARITY
    near = pairs.join(sized.select(F.col("nid").alias("a"), F.col("n").alias("na")), "a").join(sized.select(F.col("nid").alias("b"), F.col("n").alias("nb")), "b") \
                .where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num).select("a", "b")
    near = stored(near)
    both = near.join(sized.select(F.col("nid").alias("b"), F.col("s").alias("sb")), "b").join(sized.select(F.col("nid").alias("a"), F.col("s").alias("sa")), "a")
    alike = F.size(F.array_intersect("sa", "sb")) * (num + den) >= (F.size("sa") + F.size("sb")) * num
    return both.where(alike).select("a", "b").distinct()


def prefix_pairs(sets: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of other labels among (nid, label, s): each pair that can have the similarity is there.

    Shingles are ordered: those of one label only come first, as they belong to no pair, then the others by how many sets hold them. Sets of m <= n
    shingles with the similarity share at least (m + n) * num / (num + den) of them, so that the first ones of each, up to that many
    before the end, hold a shared one. The larger set looks each class of smaller sizes up with the prefix of that class,
    so that shingles of a template are only met by sets of which little else is left."""
    num, den = SIMILARITY
    items = sets.select("nid", "label", F.size("s").alias("n"), F.explode("s").alias("w"))
    common = stored(items.groupBy("w").agg(F.count(F.lit(1)).alias("df"), F.min("label").alias("l0"), F.max("label").alias("l1"))
                    .where("l0 < l1").select("w", "df"))
    ranked = lookup_join(items, common, ["w"], "inner", spread_by="nid").groupBy("nid", "label", "n") \
        .agg(F.sort_array(F.collect_list(F.struct("df", "w"))).alias("ws")).withColumn("c", F.size("ws")).where(f"c * {den} >= n * {num}")
    ranked = stored(ranked.select("nid", "label", "n", "c", F.slice("ws.w", 1, F.expr(f"c - int(ceil(n * {num} / {den})) + 1")).alias("ws")))
    placed = ranked.select("nid", "label", "n", "c", F.posexplode("ws").alias("k", "w")).withColumn("left", F.expr("c - k"))  # shared ones from here on
    step = math.log(STEP)
    size_class = lambda n: f"int(floor(ln({n}) / {step}))"
    least = lambda m, n: f"({m} + {n}) * {num} <= left * {num + den}"
    small = placed.where(least("n", "n")).select("w", F.expr(size_class("n")).alias("z"), F.col("nid").alias("x"), F.col("label").alias("lx"), F.col("n").alias("m"), F.col("left").alias("left_x"))
    classes = F.expr(f"sequence({size_class(f'ceil(n * {num} / {den})')}, {size_class('n')})")
    large = placed.withColumn("z", F.explode(classes)).where(least(f"greatest(n * {num} / {den}, floor(pow({STEP}, z)) - 1)", "n"))
    both = stored(large).join(stored(small), ["w", "z"]).where("(m < n OR m = n AND x < nid) AND lx <> label") \
        .where(f"m * {den} >= n * {num} AND (m + n) * {num} <= least(left, left_x) * {num + den}")
    return both.select(F.least("nid", "x").alias("a"), F.greatest("nid", "x").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node with an edge; the label is the least node of its connected component.

    Alternates two steps until no edge changes: each node's larger neighbours move to its least neighbour, then its smaller ones do.
    Least neighbours are aggregated before they meet the edges; no node's edges are gathered."""

    def moved(e: DataFrame, larger: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.col("u")).alias("m"))
        if larger:  # (u, v), v > u: v meets the least around u
            found = both.where("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("x"), F.col("m").alias("y"))
        else:  # smaller neighbours of u, and u itself, meet the least around u
            near = both.where("b < a").join(low, F.col("a") == F.col("u"))
            found = near.select(F.explode(F.array("a", "b")).alias("x"), F.col("m").alias("y"))
        return found.where("x <> y").select(F.col("y").alias("a"), F.col("x").alias("b")).distinct()

    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = stored(edges.select("a", "b"))
    before = state(edges)
    while True:
        edges = stored(moved(moved(edges, True), False))
        now = state(edges)
        if now == before:
            break
        before = now
    return stored(edges.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(
        edges.select(F.col("a").alias("node"), F.col("a").alias("label"))).distinct())


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, counted: bool = False) -> DataFrame:
    """One row per row of the input: doc_id, node, label (of the class), class_id (least id of its class), n_links (verified links of its text).

    ``counted`` weighs every shingle by its number in the text, so that texts which repeat a passage differ from those that hold it once."""
    signed = stored(_nodes(docs, doc_id, text).select("doc", "node", shingles(F.col("_w")).alias("_s"))
                    .mapInArrow(functools.partial(_sign, counted=counted), "doc long, node binary, bands array<bigint>"))
    nodes = stored(signed.where("node IS NOT NULL").groupBy("node").agg(F.min("doc").alias("doc"), F.first("bands").alias("bands"))
                   .withColumn("nid", F.monotonically_increasing_id()))  # written once, so it stays

    # only buckets with company go on
    in_bands = nodes.select("nid", F.posexplode("bands").alias("band", "bucket"))
    company = stored(in_bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket"))
    members = stored(in_bands.join(company, "bucket"))
    wanted = members.select("nid").distinct().join(nodes.select("nid", "node", "doc"), "nid")
    sets = stored(_sets(docs, doc_id, text, stored(wanted), counted))

    pairs = stored(star_pairs(members, "bucket", F.xxhash64("nid", "bucket")))
    links = stored(_verified(pairs, sets))
    label = components(links)

    # members of buckets that hold more than one class: all their pairs, without those that cannot have the similarity
    labelled = members.join(label.withColumnRenamed("node", "nid"), "nid", "left").withColumn("label", F.coalesce("label", "nid"))
    labelled = stored(labelled)
    mixed = stored(labelled.groupBy("bucket").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 < l1").select("bucket"))
    open_ = stored(labelled.join(mixed, "bucket").select("nid", "label").distinct())
    more = prefix_pairs(sets.join(open_, "nid")).join(pairs, ["a", "b"], "left_anti")
    links = stored(links.unionByName(_verified(stored(more), sets)))
    label = components(links)

    n_links = links.select(F.explode(F.array("a", "b")).alias("nid")).groupBy("nid").agg(F.count(F.lit(1)).alias("n_links"))
    named = nodes.select("nid", "node", "doc").join(label.withColumnRenamed("node", "nid"), "nid", "left").join(n_links, "nid", "left") \
                 .select("node", "doc", F.coalesce("label", "nid").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    named = stored(named)
    first = named.groupBy("label").agg(F.min("doc").alias("class_id"))
    per_node = stored(named.join(first, "label").select("node", "label", "class_id", "n_links"))
    found = signed.where("node IS NOT NULL").select("doc", "node").join(per_node, "node") \
                  .unionByName(signed.where("node IS NULL").select("doc", "node", F.lit(None).cast("long").alias("label"), F.col("doc").alias("class_id"), F.lit(0).cast("long").alias("n_links")))
    none = F.lit(NO_ID)
    return found.select(F.nullif("doc", none).alias("doc_id"), "node", "label", F.nullif("class_id", none).alias("class_id"), "n_links")



def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, counted: bool = False) -> DataFrame:
    """The input with one row of each class of near duplicates, that of its smallest id (then of the smallest digest, then
    text). Rows without words are no near duplicates of anything and stay. Texts are shuffled once, by (id, digest)."""
    rows = near_duplicates(docs, doc_id, text, counted=counted)
    first = rows.where("node IS NOT NULL").groupBy("label").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "node")).alias("k")).select("k.doc", "k.node")
    wordless = rows.where("node IS NULL").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.unhex(F.md5(F.lit(""))).alias("node")).distinct()
    keys = first.unionByName(wordless).select(F.col("doc").alias("_doc"), F.col("node").alias("_node"))
    words = F.array_join(F.regexp_extract_all(text_of(text), F.lit(WORD), F.lit(0)), " ")
    keyed = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(quoted(doc_id)).cast("long"), F.lit(NO_ID)).alias("_doc"), F.unhex(F.md5(words)).alias("_node"))
    turn = F.row_number().over(Window.partitionBy("_doc", "_node").orderBy(F.col("_row").getField(text).cast("string")))
    kept = keyed.join(keys, ["_doc", "_node"]).withColumn("_turn", turn)
    return kept.where((F.col("_turn") == 1) | (F.col("_node") == F.unhex(F.md5(F.lit(""))))).select("_row.*")
