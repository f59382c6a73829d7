"""Conversation repair against a search over all edits, in small and shared conversations."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pandas as pd
import pytest

from voltaspan.llm import dialogue_repair as dr

PATTERN = re.compile("(s?(ua)+)?")


def cheapest(rows: list[tuple[str, str]]) -> tuple[int, str, list[str]]:
    """By cost, then by edits: the first whole sequence of edits that fits. Rows role, fault."""
    heap = [(0, "", 0, "", ())]
    best: dict = {}
    while True:
        cost, audit, k, initials, lines = heapq.heappop(heap)
        if k == len(rows) and PATTERN.fullmatch(initials):
            return cost, audit, list(lines)
        node = (k, initials[:1] if len(initials) < 2 else "s" * (initials[0] == "s") + "+" + initials[-1])
        if not any(PATTERN.fullmatch(initials + rest) for rest in ("", "a", "ua")) or best.setdefault(node, (cost, audit)) < (cost, audit):
            continue
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 2, audit + "I", k, initials + role[0], (*lines, f"{role}:")))
        if k < len(rows):
            role, text, fault = rows[k]
            heapq.heappush(heap, (cost + 3, audit + "D", k + 1, initials, lines))
            if fault not in ("blank", "duplicate"):
                late = fault == "truncated"
                if role[:1]:
                    heapq.heappush(heap, (cost + late, audit + "K", k + 1, initials + role[0], (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 2 + late, audit + "R", k + 1, initials + new[0], (*lines, f"{new}:{text}")))


def brute(table: list[tuple]) -> dict:
    """The contract, row by row."""
    conversations: dict = {}
    for conv_id, turn, role, text in table:
        rows = conversations.setdefault(conv_id, [])
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        rows += [(turn, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    out = {}
    for conv_id, rows in conversations.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in rows:
            plain = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            faults.append("blank" if not plain else "duplicate" if (role, text) in seen else "truncated" if plain[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {r[0] for r in rows if r[0] is not None}
        cost, audit, lines = cheapest([(r[1], r[2], f) for r, f in zip(rows, faults)])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv_id] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(spark, table: list[tuple], parts: int = 3) -> dict:
    df = spark.createDataFrame([(*r, "x", 1) for r in table], "conv_id long, turn long, role string, text string, symbol string, n int")
    rows = [tuple(r) for r in dr.query(df.repartition(parts)).collect()]
    assert len(rows) == len({r[0] for r in rows})
    return {r[0]: r[1:] for r in rows}


def test_lattice_against_a_search_over_edits():
    rng = random.Random(3)
    for _ in range(300):
        symbols = "".join(rng.choices("suaoSUAOx", k=rng.randrange(13)))
        roles = {"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "user"}
        rows = [(roles[c.lower()], f"t{i}", "blank" if c == "x" else "truncated" if c.isupper() else "") for i, c in enumerate(symbols)]
        cost, audit, lines = cheapest(rows)
        assert dr.repair(symbols)[:2] == (cost, audit), symbols
        assert list(dr.repaired([(r, t, 1) for r, t, _ in rows], audit)) == lines


def test_prices_are_dual_feasible_and_tight_on_the_path():
    lattice = dr.Lattice("auUsx", dr.WHOLE, True)
    cost = lattice.cost(dr.START)
    assert lattice.prices[dr.START] - lattice.prices[lattice.end] == cost
    for i, out in enumerate(lattice.arcs):
        assert all(lattice.prices[i] <= c + lattice.prices[j] for _, c, j in out)


def test_pieces_join_to_the_whole():
    rng = random.Random(8)
    for _ in range(60):
        symbols = "".join(rng.choices("suaoSUAOx", k=rng.randrange(60)))
        cuts = sorted(rng.sample(range(len(symbols) + 1), min(3, len(symbols) + 1)))
        pieces = [symbols[i:j] for i, j in zip([0, *cuts], [*cuts, len(symbols)])]
        exits = dr._exits(pd.DataFrame({"conv_id": 1, "piece": range(len(pieces)), "ways": [dr.crossing(p) for p in pieces]}))
        state, edits, costs = dr.START, "", []
        for piece, (_, _, e, ends) in zip(pieces, exits.sort_values("piece").itertuples(index=False)):
            cost, found, state = dr.repair(piece, state, tuple(None if x is None or x != x else x for x in e), ends)
            costs.append(cost)
            edits += found
        assert (costs[0], edits) == dr.repair(symbols)[:2]


def test_given_rows(spark):
    rng = random.Random(2)
    texts = ["Yes.", "No!", "Why?", "half a", "", " \n", None, "One. Two", "End. \t"]
    table = [(c, t, rng.choice(["user", "assistant", "system", "tool", None, "", "user"]), rng.choice(texts)) for c in range(120) for t in rng.sample(range(9), rng.randrange(1, 7))]
    assert got(spark, table) == brute(table)


def test_odd_rows(spark):
    table = [(1, None, "user", "a."), (1, None, "assistant", "b."), (1, 5, "user", "a."), (1, 5, "user", "a."), (1, -3, "tool", "é?"), (None, 1, "user", "x."), (None, None, None, None), (2, 1, "assistant", "y"), (2, 1, "assistant", "y"), (2, 1, "assistant", "y"), (3, 2**62, "user", "z."), (3, -(2**62), "user", "q." * 50_000)]
    assert got(spark, table) == brute(table)
    dropped = next(c for c in range(100, 999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert got(spark, [(dropped, 0, "user", "gone.")]) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert got(spark, []) == {}


@pytest.mark.parametrize("size", [1 << 9, 1 << 12])
def test_one_conversation_over_many_tasks(spark, monkeypatch, size):
    monkeypatch.setattr(dr, "PIECE_BYTES", size)
    rng = random.Random(4)
    table = [(7, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Yes.", "what", f"Word {t}.", f"Say {t}", " "])) for t in range(400)]
    table += [(c, t, "user", f"{c} {t}.") for c in (6, 8, 9) for t in range(3)]
    assert got(spark, table, 5) == brute(table)
