"""Conversation repair by a Viterbi walk whose survivors coalesce.

A conversation should read ``s?(ua)+`` in the initials of its roles, or be empty. Its turns are kept (K, free), given the role user
or assistant (R, 2) or deleted (D, 3; blank and repeated turns must be), and empty turns are inserted (I, 2); a truncated turn that
stays costs 1 more. ``Walk`` holds one survivor per state (nothing yet, system, user, assistant): its cost and a node of a tree of
back pointers, runs of one letter being one node. Nodes count their references, so what no survivor descends
from is gone at once; as soon as all survivors share an ancestor, the letters up to it are final, are handed out and forgotten. A survivor that another one
beats by more than it costs to take its place is dropped, which lets the rest coalesce. Survivors of equal cost are
compared over all letters since their common ancestor, and the smaller string stays.

A conversation may hold any share of all turns. Turns are range-partitioned by (conversation, turn, role, text), equal
ones folded into one row with a count. A piece solves the conversations that lie within it; of its first and its last one, which may go on next door, it
gives costs and the order of strings from each state to each state. These summaries (at most two per piece) are chained per
conversation, which fixes the state at every cut, and the pieces are then walked again between the fixed states. Strings that have
used equally many turns and end in a turn's letter are never beginnings of each other, so their order at a cut stands.

Defined results: turns are ordered by turn (null first), role, text; null roles and texts are one space; a role
without a letter has no initial and cannot be kept; repeated rows are repeated turns; a null conversation id is a
conversation of its own; an empty conversation has zeros, an empty audit and the hash of an empty string; an empty table
gives an empty one. Other columns are ignored. Repeats are recognised by 128 bits of role and text.
"""

from __future__ import annotations

import functools
import hashlib

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharegate.llm.common import quoted, size_estimate, stored
from sharegate.operators.joins import lookup_join

SPACE = " \t\n\x0b\x0c\r"
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
TAKES = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = {NOTHING: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: What it costs the row's state at most to do whatever the column's state can do next.
IMITATE = {NOTHING: (0, 0, 2, 0), SYSTEM: (4, 0, 2, 4), USER: (5, 2, 0, 2), ASSISTANT: (3, 0, 2, 0)}
TO_END = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
LEGAL = ("su", "ua", "au")
PIECE_BYTES, CHUNK_CHARS = 16 << 20, 4 << 20


class Node:
    __slots__ = ("parent", "letter", "count", "depth", "held", "kids")

    def __init__(self, parent, letter: str = ""):
        self.parent, self.letter, self.count, self.held, self.kids = parent, letter, 1, 0, set()
        self.depth = parent.depth + 1 if parent else 0
        if parent:
            parent.kids.add(self)


def _release(node: Node) -> None:
    while node.parent and not node.held and not node.kids:
        node.parent.kids.discard(node)
        node = node.parent


def _runs_since(a: Node, b: Node, last_a: str, last_b: str):
    """Runs of both strings behind the common ancestor, from its end, each with a last letter."""
    ra, rb = [(last_a, 1)] if last_a else [], [(last_b, 1)] if last_b else []
    while a is not b:
        if a.depth >= b.depth:
            ra.append((a.letter, a.count))
            a = a.parent
        else:
            rb.append((b.letter, b.count))
            b = b.parent
    return ra, rb


def smaller(a: Node, b: Node, last_a: str = "", last_b: str = "") -> bool:
    """Whether the string of ``a`` and ``last_a`` comes before that of ``b`` and ``last_b``."""
    ra, rb = _runs_since(a, b, last_a, last_b)
    (x, n), (y, m) = (ra.pop() if ra else ("", 0)), (rb.pop() if rb else ("", 0))
    while n and m:
        if x != y:
            return x < y
        k = min(n, m)
        n, m = n - k, m - k
        if not n and ra:
            x, n = ra.pop()
        if not m and rb:
            y, m = rb.pop()
    return bool(m)


class Walk:
    """Viterbi over turns from one state; ``emit(letter, count)`` gets what is final, in order."""

    def __init__(self, entry: int = NOTHING, emit=None):
        self.root, self.emit = Node(None), emit
        self.root.held = 1
        self.at = {entry: (0, self.root)}
        self.most_open = 0

    def _insert(self) -> None:
        for source in (NOTHING, SYSTEM, ASSISTANT, USER):
            if source not in self.at:
                continue
            cost, node = self.at[source]
            target = TAKES[source, NEXT[source][0]]
            old = self.at.get(target)
            if old is None or cost + INSERT < old[0] or cost + INSERT == old[0] and smaller(node, old[1], "I"):
                new = Node(node, "I")
                new.held = 1
                self.at[target] = (cost + INSERT, new)
                if old:
                    old[1].held -= 1
                    _release(old[1])

    def turn(self, initial: str, must_go: bool, truncated: bool) -> None:
        self._insert()
        best: dict = {}
        for state, (cost, node) in self.at.items():
            options = [(state, cost + DELETE, "D")]
            if not must_go:
                stay = cost + (TRUNCATED if truncated else 0)
                if (state, initial) in TAKES:
                    options.append((TAKES[state, initial], stay, "K"))
                options.append((TAKES[state, NEXT[state][0]], stay + REROLE, "R"))
            for target, c, letter in options:
                old = best.get(target)
                if old is None or c < old[0] or c == old[0] and smaller(node, old[1], letter, old[2]):
                    best[target] = (c, node, letter)
        best = {x: b for x, b in best.items() if all(b[0] <= c[0] + IMITATE[y][x] for y, c in best.items())}
        used = [b[1] for b in best.values()]
        before = [node for _, node in self.at.values()]
        self.at = {}
        for state, (cost, node, letter) in best.items():
            if node.letter == letter and node.parent and not node.kids and node.held == 1 and sum(u is node for u in used) == 1:
                node.count, node.depth = node.count + 1, node.depth + 1  # a run goes on
                new = node
            else:
                new = Node(node, letter)
            new.held += 1
            self.at[state] = (cost, new)
        for node in before:
            node.held -= 1
        for node in before:
            _release(node)
        self._settle()

    def _settle(self) -> None:
        while len(self.root.kids) == 1 and not self.root.held:
            (self.root,) = self.root.kids
            self.root.parent = None
            if self.emit:
                self.emit(self.root.letter, self.root.count)

    def exits(self) -> dict:
        """state -> (cost, rank of its string among the states)."""
        order = sorted(self.at, key=functools.cmp_to_key(lambda x, y: -1 if smaller(self.at[x][1], self.at[y][1]) else 1))
        return {x: (self.at[x][0], k) for k, x in enumerate(order)}

    def finish(self, state: int, closing: bool) -> int:
        """Hand out the rest of the survivor in ``state`` and, at the end of a conversation, what closes it; returns the cost."""
        cost, node = self.at[state]
        rest = []
        while node is not self.root:
            rest.append((node.letter, node.count))
            node = node.parent
        end = [("I", 1) for _ in TO_END[state]] if closing else []
        for letter, count in rest[::-1] + end:
            if self.emit:
                self.emit(letter, count)
        return cost + INSERT * len(end)


def best_end(exits: dict) -> int:
    """The state to end in: a user turn still needs an answer, a system turn a user turn and its answer."""
    return min(exits, key=lambda x: (exits[x][0] + INSERT * len(TO_END[x]), exits[x][1]))


class Writer:
    """Applies letters to the turns they are about."""

    def __init__(self, state: int = NOTHING):
        self.state, self.pending, self.first, self.audit, self.lines, self.chars = state, [], 0, [], [], 0

    def turn(self, role: str | None, text: str | None, count: int = 1) -> None:
        self.pending.append([role, text, count])

    def _take(self, n: int):
        while n:
            turn = self.pending[self.first]
            k = min(n, turn[2])
            n, turn[2] = n - k, turn[2] - k
            if not turn[2]:
                self.pending[self.first] = None
                self.first += 1
            yield turn
        if self.first > 1000 and 2 * self.first > len(self.pending):
            del self.pending[:self.first]
            self.first = 0

    def _line(self, role: str, text: str, initial: str) -> None:
        self.state = TAKES[self.state, initial]
        self.lines.append(f"{role}:{text}")
        self.chars += len(self.lines[-1])

    def emit(self, letter: str, count: int) -> None:
        self.audit.append(letter * count)
        if letter == "I":
            for _ in range(count):
                self._line(NEXT[self.state], "", NEXT[self.state][0])
            return
        for role, text, _ in self._take(count):
            if letter == "R":
                role = NEXT[self.state]
            if letter != "D":
                self._line(role, text, role[:1])


def walked(turns, writer: Writer, walk: Walk):
    """Feed (role, text, n, must_go, truncated): all copies of a turn but the first must go."""
    for role, text, n, must_go, truncated in turns:
        if not must_go:
            writer.turn(role, text)
            walk.turn(role[:1], False, truncated)
            n -= 1
        if n:
            writer.turn(None, None, n)
            for _ in range(n):
                walk.turn("", True, False)
        yield


def solve(turns: list) -> tuple[int, str, str]:
    """Cost, audit and hash of a whole conversation of (role, text, n, must_go, truncated)."""
    writer = Writer()
    walk = Walk(emit=writer.emit)
    sha, wrote = hashlib.sha256(), False

    def flush():
        nonlocal wrote
        if writer.lines:
            sha.update((("\n" if wrote else "") + "\n".join(writer.lines)).encode("utf-8", "surrogatepass"))
            wrote, writer.lines, writer.chars = True, [], 0

    for _ in walked(turns, writer, walk):
        if writer.chars > CHUNK_CHARS:
            flush()
    cost = walk.finish(best_end(walk.exits()), True)
    flush()
    return cost, "".join(writer.audit), sha.hexdigest()


def summary(turns: list, entries) -> list:
    """[entry, exit, cost, rank] for every way through a piece of a conversation."""
    out = []
    for entry in entries:
        walk = Walk(entry)
        for _ in walked(turns, Writer(entry), walk):
            pass
        out += [[entry, x, c, r] for x, (c, r) in walk.exits().items()]
    return out


def illegal_pairs(turns: list) -> int:
    """Neighbouring initials that are not su, ua or au; copies of a turn are neighbours too."""
    initials = [t[0][:1] for t in turns]
    return sum(t[2] - 1 for t in turns) + sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


def chain(pieces: list) -> tuple[int, int, list]:
    """Cost, illegal pairs and (entry, exit) of each piece, from (first initial, last initial, illegal, moves) in order."""
    at, back = {NOTHING: (0, 0)}, []
    illegal, before = 0, None
    for first, last, within, moves in pieces:
        illegal += within + (before is not None and before + first not in LEGAL)
        before = last
        best: dict = {}
        for entry, x, c, rank in moves:
            if entry in at:
                found = (at[entry][0] + c, at[entry][1], rank, entry)
                best[x] = min(best.get(x, found), found)
        order = sorted(best, key=lambda x: best[x][1:3])
        back.append({x: best[x][3] for x in best})
        at = {x: (best[x][0], k) for k, x in enumerate(order)}
    end = best_end(at)
    cost, ways, x = at[end][0] + INSERT * len(TO_END[end]), [], end
    for step in reversed(back):
        ways.append((step[x], x))
        x = step[x]
    return cost, illegal, ways[::-1]


def turns_of(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) with nulls of role and text as one space."""
    return conversations.select(
        F.col(quoted(conv_id)).alias("conv_id"), F.col(quoted(turn)).alias("turn"),
        F.coalesce(F.col(quoted(role)).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(quoted(text)).cast("string"), F.lit(" ")).alias("text"))


def damaged(turns: DataFrame) -> DataFrame:
    """Test damage by crc32 of ``conv_id:turn``: of 20 residues 0 drops, 1 empties, 2 cuts ``.!?``, 3 repeats, 4 gives the role user."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    k = F.col("_k")
    text = F.when(k == 1, "").when(k == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    hurt = turns.withColumn("_k", F.crc32(F.encode(name, "UTF-8")) % 20).where(k != 0)
    return hurt.select("conv_id", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.explode(F.array_repeat(F.lit(True), F.when(k == 3, 2).otherwise(1))).alias("_")).drop("_")


def with_faults(turns: DataFrame) -> DataFrame:
    """Distinct turns with their number ``n``, and whether a turn is blank, was ``seen`` at an earlier turn, is truncated."""
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    hashes = F.xxhash64("role", "text"), F.xxhash64("text", "role", F.lit(1))
    unique = stored(turns.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
                    .select("*", hashes[0].alias("h0"), hashes[1].alias("h1"), F.xxhash64("conv_id", "turn", "text").alias("_any"), F.col("conv_id").isNull().alias("no_id"),
                            F.coalesce(F.xxhash64(F.col("conv_id").cast("string")), F.lit(0)).alias("_conv")))
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    # (no_id, conv hash) instead of the id: keys without nulls; two ids with one hash are kept apart by the third column
    key = ["no_id", "_conv", "h0", "h1"]
    earliest = unique.groupBy(*key, F.col("conv_id").alias("_id")).agg(F.min(when).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    met = lookup_join(unique, stored(earliest.groupBy(*key).agg(F.collect_list(F.struct("_id", "first")).alias("firsts"))), key, "left", spread_by="_any")
    own = F.get(F.filter("firsts", lambda f: f["_id"].eqNullSafe(F.col("conv_id"))), F.lit(0))["first"]
    blank = end == ""
    return met.select("conv_id", "turn", "role", "text", "n", blank.alias("blank"), F.coalesce(when > own, F.lit(False)).alias("seen"),
                      (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("truncated"))


RESULT, TURN, SUMMARY = 0, 1, 2


def repair(turns: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    Conversations of ``every`` (conv_id) without a turn have zeros."""
    rows = stored(with_faults(turns).withColumn("must_go", F.expr("blank OR seen")))
    bad = F.col("must_go")
    counts = rows.groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps"), F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).when(F.col("seen"), F.col("n")).otherwise(F.col("n") - 1)).alias("duplicate"),
        F.sum(F.when(~bad & F.col("truncated"), 1).otherwise(0)).alias("truncated"))
    solved = _solved(rows.select("conv_id", "turn", "role", "text", "n", "must_go", "truncated"))
    whose = rows.select("conv_id").distinct() if every is None else every.select("conv_id").distinct()
    out = whose.alias("w").join(counts.alias("c"), F.expr("w.conv_id <=> c.conv_id"), "left").join(solved.alias("s"), F.expr("w.conv_id <=> s.conv_id"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c.split(".")[1])
    return out.select("w.conv_id", *map(zero, ("c.gaps", "c.blank", "c.duplicate", "c.truncated", "s.illegal", "s.cost")),
                      F.coalesce("s.audit", F.lit("")).alias("audit"), F.coalesce("s.sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _solved(rows: DataFrame) -> DataFrame:
    """(conv_id, illegal, cost, audit, sha) of every conversation."""
    kind_of_id = rows.schema["conv_id"].dataType.simpleString()
    pieces = size_estimate(rows, "text", PIECE_BYTES)
    order = ["conv_id", "turn", "role", "text"]
    placed = rows.repartitionByRange(pieces, *order).sortWithinPartitions(*order)
    names = ["kind", "conv_id", "part", "side", "seq", "role", "text", "n", "must_go", "truncated", "illegal", "cost", "audit", "sha", "moves"]
    schema = (f"kind byte, conv_id {kind_of_id}, part int, side int, seq long, role string, text string, n long, must_go boolean, truncated boolean, "
              "illegal long, cost long, audit string, sha string, moves array<array<int>>")
    arrow = pa.schema([("kind", pa.int8()), ("part", pa.int32()), ("side", pa.int32()), ("seq", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("n", pa.int64()),
                       ("must_go", pa.bool_()), ("truncated", pa.bool_()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("sha", pa.string()),
                       ("moves", pa.list_(pa.list_(pa.int32())))])

    def first_pass(batches):
        part, out, ids, current, turns, side, id_type = TaskContext.get().partitionId(), [], [], None, [], 0, None

        def batch():
            made = {f.name: pa.array([o.get(f.name) for o in out], f.type) for f in arrow}
            made["conv_id"] = pa.array(ids, id_type)
            out.clear(), ids.clear()
            return pa.RecordBatch.from_arrays([made[n] for n in names], names=names)

        def border(side):
            """Turns of a conversation that may go on next door, and its summary."""
            rows = [{"kind": TURN, "part": part, "side": side, "seq": k, "role": r, "text": t, "n": n, "must_go": m, "truncated": c} for k, (r, t, n, m, c) in enumerate(turns)]
            moves = summary(turns, range(4) if side == 0 else (NOTHING,))
            rows.append({"kind": SUMMARY, "part": part, "side": side, "role": turns[0][0][:1], "text": turns[-1][0][:1], "illegal": illegal_pairs(turns), "moves": moves})
            out.extend(rows)
            ids.extend([current] * len(rows))

        for b in batches:
            id_type = b.schema.field("conv_id").type
            for i, *turn in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text", "n", "must_go", "truncated")), strict=True):
                if turns and i != current:
                    if side == 0:
                        border(0)
                        side = 1
                    else:
                        cost, audit, sha = solve(turns)
                        out.append({"kind": RESULT, "illegal": illegal_pairs(turns), "cost": cost, "audit": audit, "sha": sha})
                        ids.append(current)
                    turns = []
                current = i
                turns.append(turn)
            if out:
                yield batch()
        if turns:
            border(side)
            yield batch()

    made = stored(placed.mapInArrow(first_pass, schema))
    plan_schema = f"conv_id {kind_of_id}, part int, side int, seq long, entry int, exit int, last boolean, illegal long, cost long"

    def chained(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["part", "side"])
        cost, illegal, ways = chain(list(zip(group["role"], group["text"], group["illegal"].astype(int), group["moves"], strict=True)))
        n = len(group)
        return pd.DataFrame({"conv_id": group["conv_id"], "part": group["part"], "side": group["side"], "seq": -1, "entry": [w[0] for w in ways], "exit": [w[1] for w in ways],
                             "last": [k == n - 1 for k in range(n)], "illegal": illegal, "cost": cost})

    summaries = made.where(F.col("kind") == SUMMARY).select("conv_id", "part", "side", "role", "text", "illegal", "moves")
    plan = stored(summaries.groupBy("conv_id").applyInPandas(chained, plan_schema))  # at most two short rows per piece in all
    again = made.where(F.col("kind") == TURN).select("conv_id", "part", "side", "seq", "role", "text", "n", "must_go", "truncated") \
                .unionByName(plan.select("conv_id", "part", "side", "seq", "entry", "exit", "last"), allowMissingColumns=True)
    again = again.repartitionByRange(pieces, "part").sortWithinPartitions("part", "side", "seq")

    def second_pass(batches):
        plan, turns, writer, walk, id_type, chunk = None, 0, None, None, None, 0

        def chunk_row():
            nonlocal chunk
            row = pa.RecordBatch.from_arrays([pa.array([plan[0]], id_type), pa.array([plan[1]], pa.int32()), pa.array([chunk], pa.int64()), pa.array(["".join(writer.audit)]),
                                              pa.array(["\n".join(writer.lines)]), pa.array([bool(writer.lines)])], names=["conv_id", "part", "chunk", "audit", "lines", "has_lines"])
            writer.audit, writer.lines, writer.chars, chunk = [], [], 0, chunk + 1
            return row

        for b in batches:
            id_type = b.schema.field("conv_id").type
            for i, part, seq, entry, exit_, last, *turn in zip(*(b.column(c).to_pylist() for c in (
                    "conv_id", "part", "seq", "entry", "exit", "last", "role", "text", "n", "must_go", "truncated")), strict=True):
                if seq < 0:
                    if plan:
                        walk.finish(plan[2], plan[3])
                        yield chunk_row()
                    plan, writer, chunk = (i, part, exit_, last), Writer(entry), 0
                    walk = Walk(entry, writer.emit)
                    continue
                for _ in walked([turn], writer, walk):
                    pass
                if writer.chars > CHUNK_CHARS:
                    yield chunk_row()
        if plan:
            walk.finish(plan[2], plan[3])
            yield chunk_row()

    chunks = again.mapInArrow(second_pass, f"conv_id {kind_of_id}, part int, chunk long, audit string, lines string, has_lines boolean")

    def hashed(batches):
        started, current, sha, audit, wrote, id_type = False, None, None, [], False, None

        def result():
            return pa.RecordBatch.from_arrays([pa.array([current], id_type), pa.array(["".join(audit)]), pa.array([sha.hexdigest()])], names=["conv_id", "audit", "sha"])

        for b in batches:
            id_type = b.schema.field("conv_id").type
            for i, letters, lines, has in zip(*(b.column(c).to_pylist() for c in ("conv_id", "audit", "lines", "has_lines")), strict=True):
                if not started or i != current:
                    if started:
                        yield result()
                    started, current, sha, audit, wrote = True, i, hashlib.sha256(), [], False
                audit.append(letters)
                if has:
                    sha.update((("\n" if wrote else "") + lines).encode("utf-8", "surrogatepass"))
                    wrote = True
        if started:
            yield result()

    # one row per piece of a conversation, and one hash state that reads them in order
    ends = chunks.repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk").mapInArrow(hashed, f"conv_id {kind_of_id}, audit string, sha string")
    figures = plan.where("last").select("conv_id", "illegal", "cost")
    cut = figures.alias("f").join(ends.alias("e"), F.expr("f.conv_id <=> e.conv_id")).select("f.conv_id", "illegal", "cost", "audit", "sha")
    return made.where(F.col("kind") == RESULT).select("conv_id", "illegal", "cost", "audit", "sha").unionByName(cut)
