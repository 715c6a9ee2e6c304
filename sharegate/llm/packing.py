"""Best-fit packing by a grouping genetic algorithm on islands.

Items are dealt by hash into shards of at most about ``SHARD_ITEMS``, so that every shard has the same mix of sizes. The packings of a shard
evolve on ``ISLANDS`` islands. An individual is a set of bins. Crossover injects whole well-filled bins of one
parent into the other, dissolves bins that hold an item twice, and puts displaced items back by best fit, the largest first;
mutation dissolves some of the emptiest bins. Between epochs every island sends its elite to the next one. A shard that reaches the lower bound
(its tokens over the capacity, rounded up) stops. The best packing of a shard counts.

Shards are rows; islands are copies of the sizes of a shard (4 bytes an item), so an executor can be lost at any time: epochs
are tables, and evolution is seeded by shard, island and epoch.

Defined results: an item of size 0 is placed like any other; an item above the capacity is refused (cut it first, see
``token_pieces``); repeated rows are items of their own; null sizes count as 0; an empty table gives an empty result; other columns are
kept, and columns named sequence_id or offset are replaced.
"""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sharegate.llm import tokenize
from sharegate.llm.common import quoted, stored

CAPACITY = 1024
SHARD_ITEMS, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 32_768, 3, 2, 6, 4


class Room:
    """Open bins by free space; the bin with the least space that fits is found with one bit mask."""

    def __init__(self, capacity: int):
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def put(self, b: int, free: int) -> None:
        self.at[free].append(b)
        self.mask |= 1 << free

    def take(self, size: int) -> tuple[int, int]:
        """(bin, free space) of the tightest fit, or (-1, 0)."""
        above = self.mask >> size
        if not above:
            return -1, 0
        free = size + (above & -above).bit_length() - 1
        found = self.at[free].pop()
        if not self.at[free]:
            self.mask &= ~(1 << free)
        return found, free


Packing = tuple[list[list[int]], list[int]]  # bins and what they hold


def best_fit(bins: list[list[int]], filled: list[int], items: list[int], sizes: list[int], capacity: int) -> Packing:
    """Put ``items`` (in this order) into ``bins`` or into new ones. Bins that receive an item are copied first."""
    room, own = Room(capacity), set()
    for b, f in enumerate(filled):
        if f < capacity:
            room.put(b, capacity - f)
    for i in items:
        b, free = room.take(sizes[i])
        if b < 0:
            b, free = len(bins), capacity
            bins.append([])
            filled.append(0)
            own.add(b)
        elif b not in own:
            bins[b] = list(bins[b])
            own.add(b)
        bins[b].append(i)
        filled[b] += sizes[i]
        if free > sizes[i]:
            room.put(b, free - sizes[i])
    return bins, filled


def fitness(p: Packing, capacity: int) -> tuple[int, int]:
    """Fewer bins first, then unequal ones: full bins beside empty ones leave room for the next generation."""
    return -len(p[0]), sum(f * f for f in p[1])


def crossover(into: Packing, of: Packing, sizes: list[int], capacity: int, rng: random.Random) -> Packing:
    order = sorted(range(len(of[0])), key=of[1].__getitem__, reverse=True)[: max(1, len(of[0]) // 2)]
    injected = rng.sample(order, max(1, len(order) // 2))
    taken = {i for b in injected for i in of[0][b]}
    bins, filled, displaced = [of[0][b] for b in injected], [of[1][b] for b in injected], []
    for b, f in zip(*into, strict=True):
        if taken.isdisjoint(b):
            bins.append(b)
            filled.append(f)
        else:
            displaced += [i for i in b if i not in taken]
    return mutate((bins, filled), sizes, capacity, rng, displaced)


def mutate(p: Packing, sizes: list[int], capacity: int, rng: random.Random, displaced: list[int] = ()) -> Packing:
    """Dissolve some of the emptiest bins and put their items back with the displaced ones, the largest first."""
    bins, filled = p
    open_ = [b for b, f in enumerate(filled) if f < capacity]
    worst = sorted(open_, key=filled.__getitem__)[: max(2, len(open_) // 10)]
    gone = set(rng.sample(worst, min(len(worst), rng.randint(1, max(1, len(worst))))))
    loose = [*displaced, *(i for b in gone for i in bins[b])]
    loose.sort(key=sizes.__getitem__, reverse=True)
    return best_fit([b for k, b in enumerate(bins) if k not in gone], [f for k, f in enumerate(filled) if k not in gone], loose, sizes, capacity)


def _code(p: Packing, n: int) -> bytes:
    out = np.empty(n, np.int32)
    for b, members in enumerate(p[0]):
        out[members] = b
    return out.tobytes()


def _bins(code: bytes) -> list[list[int]]:
    of = np.frombuffer(code, np.int32)
    if not len(of):
        return []
    order = np.argsort(of, kind="stable")
    ends = np.flatnonzero(np.diff(of[order])) + 1
    order = order.tolist()
    return [order[a:b] for a, b in zip([0, *ends.tolist()], [*ends.tolist(), len(order)], strict=True)]


def evolve(sizes: list[int], population: list[bytes], capacity: int, seed: str, generations: int = GENERATIONS) -> list[bytes]:
    """The best POPULATION individuals after some generations, the best first."""
    rng, n = random.Random(seed), len(sizes)
    least = max(1, -(-sum(sizes) // capacity))
    people = [(b, [sum(sizes[i] for i in x) for x in b]) for b in map(_bins, population)]
    if not people:
        people = [best_fit([], [], sorted(range(n), key=sizes.__getitem__, reverse=True), sizes, capacity)]
        while len(people) < POPULATION and len(people[0][0]) > least:
            people.append(mutate(people[0], sizes, capacity, rng))
    rank = lambda p: fitness(p, capacity)
    people.sort(key=rank, reverse=True)
    for _ in range(generations):
        if len(people[0][0]) <= least:
            break
        a, b = people[0], people[rng.randrange(1, len(people))] if len(people) > 1 else people[0]
        people = sorted([*people, crossover(a, b, sizes, capacity, rng), crossover(b, a, sizes, capacity, rng)], key=rank, reverse=True)[:POPULATION]
    return [_code(p, n) for p in people[:POPULATION]]


def pack(items: DataFrame, size: str = "length", capacity: int = CAPACITY, *, islands: int = ISLANDS, epochs: int = EPOCHS,
         shard_items: int = SHARD_ITEMS) -> DataFrame:
    """The input with ``sequence_id`` and ``offset``, gapless from 0 in each sequence."""
    items = items.drop("sequence_id", "offset")
    total = items.agg(F.count(F.lit(1)), F.max(F.col(quoted(size)).cast("long"))).first()
    if (total[1] or 0) > capacity:
        raise ValueError(f"an item of {total[1]} is above the capacity of {capacity}")
    n_shards = max(1, -(-total[0] // shard_items))
    length = F.coalesce(F.col(quoted(size)).cast("int"), F.lit(0))
    # equal rows get equal hashes; so many of them that they unbalance the shards are told apart by a second number
    shard = F.pmod(F.xxhash64(*(F.col(quoted(c)) for c in items.columns), F.monotonically_increasing_id()), F.lit(n_shards)).cast("int")
    dealt = stored(items.select(F.struct(*(F.col(quoted(c)) for c in items.columns)).alias("item"), length.alias("size"), shard.alias("shard")))
    shards = stored(dealt.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("size", "item"))).alias("items"))
                    .select("shard", "items.size", "items.item"))

    def generation(epoch: int):
        def run(batches):
            for batch in batches:
                rows = batch.to_pylist()
                found = [evolve(r["size"], r["people"], capacity, f"{r['shard']}/{r['island']}/{epoch}") for r in rows]
                counts = [len(_bins(p[0])) if r["size"] else 0 for r, p in zip(rows, found, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    batch.column("shard"), batch.column("island"), pa.array(found, pa.list_(pa.binary())), pa.array(counts, pa.int32())],
                    names=["shard", "island", "people", "n_bins"])
        return run

    lots = F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island")
    sizes = shards.select("shard", "size")
    state = None
    for epoch in range(epochs):
        start = sizes.select("shard", "size", lots)
        if state is None:
            people = start.withColumn("people", F.array().cast("array<binary>"))
        else:
            # the elite of each island also goes to the next one
            moved = state.select("shard", ((F.col("island") + 1) % islands).alias("island"), F.slice("people", 1, 1).alias("elite"))
            people = start.join(state, ["shard", "island"]).join(moved, ["shard", "island"]) \
                          .select("shard", "size", "island", F.array_distinct(F.concat("people", "elite")).alias("people"))
        spread = people.select("shard", "island", "size", "people").repartition(max(1, min(n_shards * islands, 10_000)), "shard", "island")
        state = stored(spread.mapInArrow(generation(epoch), "shard int, island int, people array<binary>, n_bins int"))

    best = state.groupBy("shard").agg(F.min(F.struct("n_bins", "island", F.get("people", F.lit(0)).alias("code"))).alias("b")).select("shard", "b.code")

    def place(batches):
        for batch in batches:
            bins, offsets = [], []
            for sizes, code in zip(batch.column("size").to_pylist(), batch.column("code").to_pylist(), strict=True):
                at = [0] * len(sizes)
                for members in _bins(code):
                    used = 0
                    for i in members:
                        at[i] = used
                        used += sizes[i]
                bins.append(np.frombuffer(code, np.int32))
                offsets.append(np.array(at, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array(bins, pa.list_(pa.int32())), pa.array(offsets, pa.list_(pa.int32()))],
                                             names=["shard", "bin", "offset"])

    placed = sizes.join(best, "shard").select("shard", "size", "code").mapInArrow(place, "shard int, bin array<int>, offset array<int>")
    rows = shards.select("shard", "item").join(placed, "shard").select("shard", F.explode(F.arrays_zip("item", "bin", "offset")).alias("x"))
    return rows.select("x.item.*", (F.col("shard").cast("long") * (1 << 31) + F.col("x.bin")).alias("sequence_id"), F.col("x.offset").cast("long").alias("offset"))


def token_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of every document's ids and end id. Only documents above the
    capacity are cut; their first piece takes what is over."""
    path = tokenizer or tokenize.default_path()

    def run(batches):
        each = tokenize.encoder(path).each
        for batch in batches:
            ids, out = batch.column(0), ([], [], [], [], [])
            for row, raw in enumerate(each(batch.column(1))):
                n, start, piece = len(raw) // 4, 0, 0
                while start < n:
                    size = (n % capacity or capacity) if start == 0 and n > capacity else min(capacity, n)
                    for column, value in zip(out, (row, piece, start, size, zlib.crc32(raw[4 * start:4 * (start + size)])), strict=True):
                        column.append(value)
                    start, piece = start + size, piece + 1
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(out[0], pa.int32())), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:])],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).cast("string").alias("text"))
    return rows.mapInArrow(run, T.StructType([
        T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]))
