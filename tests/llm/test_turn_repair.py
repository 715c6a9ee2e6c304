import hashlib
import itertools
import os
import random
import zlib

import pytest

from sharegate.llm import queries, turn_repair

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WHITE = " \t\n\x0b\x0c\r"


def _damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else "".join(c for c in text if c not in ".!?") if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def _faults(turns):
    """blank, duplicate, truncated or None of each turn in order."""
    seen, out = set(), []
    for _, role, text in turns:
        body = text.strip(WHITE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def _cheapest(turns, faults):
    """Least (cost, audit, lines) over whole strings; the key of a state is the initials' last one."""
    ok = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}

    def inserted(best):
        for _ in range(3):
            for last, (cost, audit, lines) in list(best.items()):
                for role in ("user", "assistant"):
                    if (last, role[0]) in ok:
                        new = (cost + 2, audit + "I", (*lines, f"{role}:"))
                        if role[0] not in best or new[:2] < best[role[0]][:2]:
                            best[role[0]] = new
        return best

    best = {"": (0, "", ())}
    for (_, role, text), fault in zip(turns, faults, strict=True):
        now = {}
        for last, (cost, audit, lines) in inserted(best).items():
            options = [(last, cost + 3, "D", lines)]
            if fault not in ("blank", "duplicate"):
                more = 1 if fault == "truncated" else 0
                options += [(role[:1], cost + more, "K", (*lines, f"{role}:{text}"))] if (last, role[:1]) in ok else []
                options += [(r[0], cost + 2 + more, "R", (*lines, f"{r}:{text}")) for r in ("user", "assistant") if (last, r[0]) in ok]
            for state, c, letter, out in options:
                new = (c, audit + letter, out)
                if state not in now or new[:2] < now[state][:2]:
                    now[state] = new
        best = now
    best = inserted(best)
    return min((best[x] for x in ("", "a") if x in best), key=lambda b: b[:2])


def _row(conv, rows):
    """Expected row of the turns of a conversation."""
    turns = sorted(((t, r, x) for _, t, r, x in rows), key=lambda t: ((t[0] is not None, t[0] or 0), t[1].encode(), t[2].encode()))
    faults = _faults(turns)
    cost, audit, lines = _cheapest(turns, faults)
    known = [t for t, _, _ in turns if t is not None]
    initials = [r[:1] for _, r, _ in turns]
    return (conv, max(known) - min(known) + 1 - len(set(known)) if known else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def _brute(rows, every):
    by = {c: [] for c in every}
    for r in rows:
        by[r[0]].append(r)
    return {_row(c, t) for c, t in by.items()}


def _got(df):
    rows = [tuple(r[c] for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = _brute(_damaged(rows), {r[0] for r in rows})
    assert _got(queries.op13_conversation_repair(spark, SF)) == want and {c for r in want for c in r[7]} == set("DIKR")


def _enumerated(turns):
    """Least (cost, audit) over every sequence of edits with at most two insertions between turns."""
    import re
    best = None
    gaps = [g for n in range(3) for g in itertools.product("ua", repeat=n)]
    choices = [[("D", "", 3)] + ([] if must else [("K", i, cut), ("R", "u", 2 + cut), ("R", "a", 2 + cut)]) for i, must, cut in turns]
    for edits in itertools.product(*choices):
        for put in itertools.product(gaps, repeat=len(turns) + 1):
            initials = "".join("".join(g) + (e[1] if e else "") for g, e in itertools.zip_longest(put, edits))
            if re.fullmatch("(s?(ua)+)?", initials):
                found = (sum(e[2] for e in edits) + 2 * sum(map(len, put)), "".join("I" * len(g) + (e[0] if e else "") for g, e in itertools.zip_longest(put, edits)))
                best = min(best or found, found)
    return best


def test_walk_equals_enumeration():
    kinds = [("u", False, 0), ("a", False, 0), ("s", False, 0), ("a", False, 1), ("t", False, 1), ("u", True, 0)]
    for n in range(3):
        for turns in itertools.product(kinds, repeat=n):
            letters = []
            walk = turn_repair.Walk(emit=lambda x, k, to=letters: to.append(x * k))
            for t in turns:
                walk.turn(*t)
            cost = walk.finish(turn_repair.best_end(walk.exits()), True)
            assert (cost, "".join(letters)) == _enumerated(turns), turns


@pytest.mark.parametrize("seed", range(3))
def test_walk_and_chained_pieces_equal_whole_strings(seed):
    """Long conversations, whole and cut anywhere, against strings that are compared whole."""
    rng = random.Random(seed)
    for _ in range(150):
        turns = [(k, rng.choice(["user", "assistant", "assistant", "system", "tool", "user"]), rng.choice(["a.", f"{k}!", f"{k}", "", f"{k}."])) for k in range(rng.randrange(1, 40))]
        faults = _faults(turns)
        given = [(r, x, 1, f in ("blank", "duplicate"), f == "truncated") for (_, r, x), f in zip(turns, faults, strict=True)]
        cost, audit, lines = _cheapest(turns, faults)
        assert turn_repair.solve(given) == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
        cuts = sorted(rng.sample(range(1, len(given)), min(len(given) - 1, 4)))
        pieces = [given[a:b] for a, b in zip([0, *cuts], [*cuts, len(given)])]
        total, _, ways = turn_repair.chain([(p[0][0][:1], p[-1][0][:1], turn_repair.illegal_pairs(p), turn_repair.summary(p, range(4))) for p in pieces])
        letters, kept = [], []
        for k, (piece, (entry, end)) in enumerate(zip(pieces, ways, strict=True)):
            writer = turn_repair.Writer(entry)
            walk = turn_repair.Walk(entry, writer.emit)
            for _ in turn_repair.walked(piece, writer, walk):
                pass
            walk.finish(end, k == len(pieces) - 1)
            letters += writer.audit
            kept += writer.lines
        assert (total, "".join(letters), tuple(kept)) == (cost, audit, lines)


def test_open_part_of_a_long_walk_stays_small():
    """Runs that must go, and turns that leave two ways open, do not pile up nodes."""
    rng = random.Random(1)
    out = []
    walk = turn_repair.Walk(emit=lambda x, k: out.append(k))
    walk.turn("a", False, False)  # R or IK: both cost 2
    most = 0
    for k in range(30_000):
        walk.turn(rng.choice("ua"), k < 10_000 or rng.random() < 0.2, rng.random() < 0.3)
        if k % 50 == 0 or k < 200:
            nodes, todo = 0, [walk.root]
            while todo:
                nodes += 1
                todo += todo.pop().kids
            most = max(most, nodes)
    assert most < 60 and sum(out) > 29_000


@pytest.mark.parametrize("piece", [1 << 8, 1 << 24])
def test_conversations_over_pieces(spark, monkeypatch, piece):
    """A conversation with a third of all turns, cut into many pieces; nulls anywhere, ties, repeats, clashing columns."""
    monkeypatch.setattr(turn_repair, "PIECE_BYTES", piece)
    rng = random.Random(9)
    pick = lambda: (rng.choice(["user", "assistant", "system", "assistant", "", None]), rng.choice(["Hi.", "No!", "so", "", " \t", None, "x " * 9 + "."]))
    rows = [(1, rng.choice([k, k, k // 2, None]), *pick()) for k in range(120)] + [(1, k, "user", f"own {k}.") for k in range(0, 120, 2)]
    rows += [(rng.choice([2, 3, 4, 5, None]), rng.randrange(9), *pick()) for _ in range(90)] + [(7, None, "user", "only null turns"), (8, 1, "user", "y " * 500_000)]
    rows += rows[:20] + [(6, 3, "assistant", "again.")] * 40
    df = spark.createDataFrame([(c, t, r, x, "p", 1, True) for c, t, r, x in rows], "conv_id long, turn long, role string, text string, part string, seq int, must_go boolean")
    clean = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert _got(turn_repair.repair(turn_repair.turns_of(df))) == _brute(clean, {r[0] for r in rows})
    hurt = turn_repair.turns_of(df)
    assert _got(turn_repair.repair(turn_repair.damaged(hurt), hurt)) == _brute(_damaged(rows), {r[0] for r in rows})
    assert turn_repair.repair(turn_repair.turns_of(df.limit(0))).collect() == []
