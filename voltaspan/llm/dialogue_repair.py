"""Repair of conversation structure by an auction algorithm for shortest paths.

A conversation should be one optional system row, then pairs of user and assistant. Edits (keep,
rerole, delete, insert) lead through a lattice: a level for each row, a node for each state of that
pattern. The cheapest repair is a shortest path. The auction gives every node a price and grows a
path from its origin: where the last node's price is below its best arc plus the price behind it,
the price rises to that and the path gives the node up; else the path takes that arc. When the path
arrives, the prices are dual optimal: of the arcs, those of shortest paths are tight (the price falls
by just their cost). They are traced letter by letter, the smallest first.

Long conversations are solved in blocks of rows, from the last to the first: what a block's exits
cost is what the next one's prices say of its entries. So prices stay small, and pieces of one
conversation, however many rows it has, are solved in different tasks.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltaspan.llm.common import flushed, lean, partitions, written

DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: States: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
_WANTED = ("user", "user", "assistant", "user")  # what a state takes besides a system row
#: What the exits of a whole conversation cost; None: no exit.
WHOLE = (0, None, None, 0)
BLOCK = 8
#: Text of one task, about; a conversation that needs more is shared by several.
PIECE_BYTES = 32 << 20

Exits = tuple[int | None, ...]


class Lattice:
    """Levels 0 to n over a block of rows, four states each. ``symbols`` has a letter for each row:
    the initial of its role (``o``: any other), in capitals if truncated, ``x`` if it must go.
    ``exits`` has what each state of the last level still costs. Rows may be inserted before each
    row, and after the last one in the ``last`` block."""

    def __init__(self, symbols: str, exits: Exits, last: bool):
        n = len(symbols)
        self.end = end = 4 * (n + 1)
        arcs: list[list[tuple[str, int, int]]] = [[] for _ in range(end)]  # by letter
        for k in range(n + 1):
            symbol = symbols[k] if k < n else ""
            late, initial = TRUNCATED * symbol.isupper(), symbol.lower()
            for q in range(4):
                out, other = arcs[4 * k + q], _NEXT[_WANTED[q][0], q]
                if k == n and exits[q] is not None:
                    out.append(("", exits[q], end))
                if k < n:
                    out.append(("D", DELETE, 4 * (k + 1) + q))
                if k < n or last:
                    out.append(("I", INSERT, 4 * k + other))
                if k < n and (initial, q) in _NEXT:
                    out.append(("K", late, 4 * (k + 1) + _NEXT[initial, q]))
                if symbol and initial != "x":
                    out.append(("R", REROLE + late, 4 * (k + 1) + other))
        leads, before = {end}, 0
        while len(leads) > before:  # arcs that lead nowhere would let prices rise for ever
            before = len(leads)
            leads |= {i for i, out in enumerate(arcs) if any(j in leads for _, _, j in out)}
        self.arcs = [[arc for arc in out if arc[2] in leads] for out in arcs]
        self.prices = [0] * (end + 1)
        self.traced: dict[int, tuple[str, int]] = {}

    def _converge(self, origin: int) -> None:
        """The auction from one origin; prices of earlier ones stay valid."""
        prices, arcs, path = self.prices, self.arcs, [origin]
        while (i := path[-1]) != self.end:
            best, to = min([(cost + prices[j], j) for _, cost, j in arcs[i]])
            if prices[i] < best:
                prices[i] = best  # no arc is tight: the node is worth more, the path contracts
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)

    def cost(self, state: int) -> int | None:
        """Of the cheapest way from a state at the first level."""
        if not self.arcs[state]:
            return None
        self._converge(state)
        return self.prices[state]

    def trace(self, state: int) -> tuple[str, int]:
        """Its edits, the least in ASCII among the cheapest, and the state in which it ends."""
        if state not in self.traced:
            self._converge(state)
            at, letters = state, []
            while True:
                for letter, cost, to in self.arcs[at]:
                    if self.prices[at] == cost + self.prices[to]:
                        if to != self.end:
                            self._converge(to)  # a price behind a tight arc may still be too low
                        if self.prices[at] == cost + self.prices[to]:
                            break
                letters.append(letter)
                if to == self.end:
                    break
                at = to
            self.traced[state] = "".join(letters), at % 4
        return self.traced[state]


_lattice = functools.lru_cache(4096)(Lattice)


def _solved(symbols: str, exits: Exits, last: bool) -> tuple[list[tuple[str, Exits, bool]], Exits]:
    """Blocks with their exits (the least of them 0), in order, and what the entries cost."""
    cuts = range(0, len(symbols), BLOCK) or [0]
    blocks = []
    for start in reversed(cuts):
        least = min(c for c in exits if c is not None)
        block = symbols[start : start + BLOCK], tuple(None if c is None else c - least for c in exits), last and start == cuts[-1]
        blocks.append(block)
        of = _lattice(*block)
        exits = tuple(None if (c := of.cost(q)) is None else c + least for q in range(4))
    return blocks[::-1], exits


def crossing(symbols: str) -> list[int | None]:
    """What it costs to get through the rows, from each state to each state (16 numbers)."""
    ways = [_solved(symbols, tuple(0 if q == to else None for q in range(4)), True)[1] for to in range(4)]
    return [ways[to][of] for of in range(4) for to in range(4)]


def repair(symbols: str, state: int = START, exits: Exits = WHOLE, last: bool = True) -> tuple[int, str, int]:
    """Cost (exits included), edits, and the state at the end of the cheapest repair."""
    blocks, entries = _solved(symbols, exits, last)
    cost, edits = entries[state], []
    for block in blocks:
        found, state = _lattice(*block).trace(state)
        edits.append(found)
    return cost, "".join(edits), state


def repaired(rows: Iterable[tuple[str, str, int]], edits: str, state: int = START) -> Iterator[str]:
    """Lines ``role:text`` after the edits of rows role, text, copies."""
    letters = iter(edits)

    def inserts():
        nonlocal state
        for letter in letters:
            if letter != "I":
                return letter
            yield f"{_WANTED[state]}:"
            state = _NEXT[_WANTED[state][0], state]

    for role, text, n in rows:
        for _ in range(n):
            letter = yield from inserts()
            if letter != "D":
                role = role if letter == "K" else _WANTED[state]
                yield f"{role}:{text}"
                state = _NEXT[role[0], state]
    yield from inserts()


@dataclass
class Tally:
    """Faults and turns of adjacent rows."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first: str | None = None
    last: str | None = None
    low: int | None = None
    high: int | None = None
    turns: int = 0

    def plus(self, x: Tally) -> Tally:
        """With the tally of the rows that follow."""
        if x.first is None:
            return self
        if self.first is None:
            return x
        met = self.last + x.first not in ("su", "ua", "au")
        turns = self.turns + x.turns - (self.high is not None and self.high == x.low)
        return Tally(self.blank + x.blank, self.duplicate + x.duplicate, self.truncated + x.truncated, self.illegal + x.illegal + met, self.first, x.last, x.low if self.low is None else self.low, self.high if x.high is None else x.high, turns)

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else min(self.high - self.low + 1 - self.turns, 2**63 - 1)


def tally(turn: int | None, role: str, symbol: str, blank: bool, n: int) -> Tally:
    """Of a row and its copies; two of one role beside each other are never legal."""
    known = (turn, turn, 1) if turn is not None else (None, None, 0)
    return Tally(n * blank, 0 if blank else n if symbol == "x" else n - 1, int(symbol.isupper()), n - 1, role[:1], role[:1], *known)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows conv_id, turn, role, text, n (copies; 0: dropped, the conversation is known all the same),
    as the check sum of ``conv_id:turn`` says; equal rows are one."""
    of = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    of = of.withColumn("hit", F.crc32(F.concat(named[0], F.lit(":"), named[1])) % 20)
    hit = F.col("hit")
    role = F.when(hit == 0, "").when(hit == 4, "user").otherwise(F.col("role"))
    text = F.when(hit.isin(0, 1), "").when(hit == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    n = F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1)
    turn = F.when(hit != 0, F.col("turn"))
    return of.select("conv_id", turn.alias("turn"), role.alias("role"), text.alias("text"), n.alias("n")).groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))


def marked(rows: DataFrame) -> DataFrame:
    """Adds ``symbol`` and ``blank`` to damaged rows: whether role and text have been seen before is
    the one thing that needs other rows. Those are met by their hash (SHA-256), and only where
    several turns have them."""
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    rows = written(rows.withColumn("hash", F.unhex(F.sha2(F.concat("role", F.lit(":"), "text").cast("binary"), 256))), "rows")
    firsts = rows.where("n > 0").groupBy("conv_id", "hash").agg(F.min(place).alias("first"), F.max(place).alias("latest")).where("latest > first")
    firsts = written(firsts.select(F.col("conv_id").alias("of"), F.col("hash").alias("same"), "first"), "firsts")
    both = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("hash") == F.col("same")), "left")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    seen = F.coalesce(place > F.col("first"), F.lit(False))
    late = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    initial = F.substring("role", 1, 1)
    symbol = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return both.select("conv_id", "turn", "role", "text", "n", F.when(blank | seen, "x").when(late, F.upper(symbol)).otherwise(symbol).alias("symbol"), blank.alias("blank"))


_RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_SCHEMA = pa.schema(
    [("conv_id", pa.int64()), ("kind", pa.int32()), ("piece", pa.int32()), ("seq", pa.int64())]
    + [(c, pa.int64()) for c in _RESULT] + [("audit", pa.string()), ("sha", pa.string())]
    + [("first", pa.string()), ("last", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()), ("ways", pa.list_(pa.int64()))]
    + [("role", pa.string()), ("text", pa.string()), ("n", pa.int64()), ("symbol", pa.string())]
)
_DDL = "conv_id long, kind int, piece int, seq long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, sha string, first string, last string, low long, high long, turns long, ways array<long>, role string, text string, n long, symbol string"
FINAL, HEADER, LINE = range(3)


@dataclass
class _Piece:
    conv_id: int | None
    tally: Tally = field(default_factory=Tally)
    symbols: list[str] = field(default_factory=list)
    lines: list[tuple[str, str, int, str]] = field(default_factory=list)

    def add(self, turn, role, text, n, symbol, blank) -> None:
        if n:
            self.tally = self.tally.plus(tally(turn, role, symbol, blank, n))
            self.symbols.append(symbol + "x" * (n - 1))
            self.lines.append((role, text, n, symbol))

    def result(self) -> tuple:
        cost, edits, _ = repair("".join(self.symbols))
        sha = hashlib.sha256("\n".join(repaired((x[:3] for x in self.lines), edits)).encode("utf-8", "surrogatepass"))
        t = self.tally
        return (self.conv_id, FINAL, None, None, t.gaps, t.blank, t.duplicate, t.truncated, t.illegal, cost, edits, sha.hexdigest(), *[None] * 10)

    def parts(self, piece: int) -> Iterator[tuple]:
        t = self.tally
        yield (self.conv_id, HEADER, piece, -1, None, t.blank, t.duplicate, t.truncated, t.illegal, None, None, None, t.first, t.last, t.low, t.high, t.turns, crossing("".join(self.symbols)), *[None] * 4)
        for seq, line in enumerate(self.lines):
            yield (self.conv_id, LINE, piece, seq, *[None] * 14, *line)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _in_order(batches: Iterator[pa.RecordBatch]):
    """Conversations of a sorted partition: those within it whole; the first and the last may go on
    elsewhere and become pieces."""
    lean()
    piece = TaskContext.get().partitionId()

    def rows():
        now, first = None, True
        for conv_id, *row in _rows(batches):
            if now is not None and conv_id != now.conv_id:
                if first:
                    yield from now.parts(piece)
                else:
                    yield now.result()
                now, first = None, False
            now = now or _Piece(conv_id)
            now.add(*row)
        if now is not None:
            yield from now.parts(piece)

    yield from flushed(rows(), _SCHEMA)


def _exits(pdf: pd.DataFrame) -> pd.DataFrame:
    """What the exits of each piece of a conversation cost, from the last to the first."""
    pdf = pdf.sort_values("piece", ascending=False)
    exits, out = WHOLE, []
    for i, (piece, ways) in enumerate(zip(pdf["piece"].tolist(), pdf["ways"])):
        out.append((pdf["conv_id"].iloc[0], piece, list(exits), i == 0))
        ways = [None if w is None or w != w else int(w) for w in ways]
        sums = [[w + e for w, e in zip(ways[4 * q : 4 * q + 4], exits) if w is not None and e is not None] for q in range(4)]
        exits = tuple(min(s, default=None) for s in sums)
    return pd.DataFrame(out, columns=["conv_id", "piece", "exits", "ends"])


_HEAD = ["conv_id", "piece", "seq", "blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns", "exits", "ends", "role", "text", "n", "symbol"]


def _joined(batches: Iterator[pa.RecordBatch]):
    """Conversations of several pieces, row after row: one piece is held at a time."""
    lean()
    schema = pa.schema([_SCHEMA.field(c) for c in ("conv_id", *_RESULT, "audit", "sha")])

    def rows():
        now = None

        def piece_done():
            nonlocal state
            if head is None:
                return
            total, found, state_after = repair("".join(x[3] + "x" * (x[2] - 1) for x in lines), state, head[0], head[1])
            costs.append(total)
            edits.append(found)
            for line in repaired((x[:3] for x in lines), found, state):
                sha.update(("\n" * bool(written_lines) + line).encode("utf-8", "surrogatepass"))
                written_lines.append(1) if not written_lines else None
            state = state_after

        def result():
            t = whole
            return (now, t.gaps, t.blank, t.duplicate, t.truncated, t.illegal, costs[0], "".join(edits), sha.hexdigest())

        started, head = False, None
        for conv_id, _, seq, blank, duplicate, truncated, illegal, first, last, low, high, turns, exits, ends, *line in _rows(batches):
            if seq < 0:  # a piece begins
                piece_done()
                if not started or conv_id != now:
                    if started:
                        yield result()
                    started, now, state, whole, costs, edits, sha, written_lines = True, conv_id, START, Tally(), [], [], hashlib.sha256(), []
                whole = whole.plus(Tally(blank, duplicate, truncated, illegal, first, last, low, high, turns))
                head, lines = (tuple(exits), ends), []
            else:
                lines.append(line)
        piece_done()
        if started:
            yield result()

    yield from flushed(rows(), schema)


def _ranged(rows: DataFrame) -> DataFrame:
    """Rows in the order of conversations and turns, cut into ranges. Ranges know a beginning of
    texts only: whatever makes their bounds stays small."""
    size = rows.agg(F.sum(F.octet_length("text") + F.octet_length("role")).alias("s")).first()["s"] or 0
    parts = max(partitions(rows), -(-size // PIECE_BYTES))
    long_role = F.length("role") > 16
    start: list[Column | str] = ["conv_id", "turn", F.substring("role", 1, 16), long_role, F.when(long_role, "").otherwise(F.substring("text", 1, 48))]
    return rows.repartitionByRange(parts, *start).sortWithinPartitions("conv_id", "turn", "role", "text")


def repair_all(rows: DataFrame, keep: Sequence[str] = _RESULT) -> DataFrame:
    """One row per conversation of damaged rows (conv_id, turn, role, text, n copies): its faults,
    the cost of its cheapest repair, its edits (``audit``) and the hash of what they give.

    A conversation within one range of the sorted table is solved there. Of one that several share,
    each task finds what its piece costs from state to state; from these follow the exits of each
    piece, and each piece's edits from its exits. Only the hash, which SHA-256 takes up from
    beginning to end, needs all rows of such a conversation one after another: they are sorted
    and pass through one task, which holds a piece at a time.
    """
    found = written(_ranged(written(marked(rows), "marked").select("conv_id", "turn", "role", "text", "n", "symbol", "blank")).mapInArrow(_in_order, _DDL), "repairs")
    heads = found.where(F.col("kind") == HEADER)
    exits = heads.select("conv_id", "piece", "ways").groupBy("conv_id").applyInPandas(_exits, "conv_id long, piece int, exits array<long>, ends boolean")
    exits = exits.select(F.col("conv_id").alias("of"), F.col("piece").alias("part"), "exits", "ends")
    heads = heads.join(exits, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("piece") == F.col("part")))
    lines = found.where(F.col("kind") == LINE).withColumns({"exits": F.lit(None).cast("array<long>"), "ends": F.lit(None).cast("boolean")})
    ordered = heads.select(_HEAD).unionByName(lines.select(_HEAD)).repartition(partitions(found), "conv_id").sortWithinPartitions("conv_id", "piece", "seq")
    long = ordered.mapInArrow(_joined, "conv_id long, " + ", ".join(f"{c} long" for c in _RESULT) + ", audit string, sha string")
    columns = ["conv_id", *keep, "audit", F.col("sha").alias("repaired_sha256")]
    return found.where(F.col("kind") == FINAL).select(columns).unionByName(long.select(columns))


def query(conversations: DataFrame) -> DataFrame:
    """Every conversation of the table, damaged and repaired.

    A null role or text is one space, which is no role of the pattern and a blank text; so is a null
    in ``conv_id:turn``. An empty role has no initial: it can't be kept. Null conversations are one.
    Rows of one turn are taken by role, then text; equal rows of one turn are duplicates. Turns may
    be null, negative or far apart; gaps beyond a long are the largest long. Columns beyond conv_id,
    turn, role and text are passed over. An empty table gives an empty table.
    """
    return repair_all(damaged(conversations))
