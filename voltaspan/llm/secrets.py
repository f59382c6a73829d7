"""Secret scan in DataFrame functions: patterns, and entropy of windows over candidate strings.

Patterns give the base spans. Then, for each character class, every maximal run of its characters
is a candidate. A window slides over the candidate one character at a time. What it holds is kept
as counts by symbol: one goes up and one goes down at each step, and with them the sum of
``c * log2(c)`` over the counts, from which Shannon's entropy follows:
``H = log2(w) - sum / w``. A candidate is a span if some window of it reaches the class's entropy
and nothing on the allow list matches it.

The sum is kept in integers (``SCALE`` to one), so that any engine finds the same spans.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 1 << 20

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"


@dataclass(frozen=True)
class CharClass:
    """A class of characters: candidates are runs of ``least`` or more, windows have ``window``."""

    kind: str
    symbols: str
    least: int
    window: int
    bits: float

    @property
    def pattern(self) -> str:
        escaped = "".join("\\" + c if c in "\\]^-" else c for c in self.symbols)
        return f"[{escaped}]{{{self.least},}}"

    @property
    def terms(self) -> list[int]:
        """``c * log2(c)`` for the counts that a window can have."""
        return [round(SCALE * c * math.log2(c)) if c else 0 for c in range(self.window + 1)]

    @property
    def most(self) -> int:
        """The sum that a window may have and still reach ``bits``."""
        return math.floor(SCALE * self.window * (math.log2(self.window) - self.bits))


_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLASSES = (
    CharClass("entropy_hex", _DIGITS + "abcdef" + "ABCDEF", 20, 20, 2.9),
    CharClass("entropy_base64", _UPPER + _LOWER + _DIGITS + "+/=_-", 20, 20, 3.6),
)
#: Candidates that match one of these whole are no secrets: letters alone (words), digits alone
#: (numbers), words or numbers joined by signs (paths, names, rules), UUIDs, runs of one character.
ALLOWED = (
    r"[A-Za-z]+",
    r"[0-9]+",
    r"[+/=_-]*(([A-Z]?[a-z]+|[A-Z]+|[0-9]+)[+/=_-]+)*([A-Z]?[a-z]+|[A-Z]+|[0-9]+)?[+/=_-]*",
    r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",
    r"[A-Za-z0-9+/=_-]*(EXAMPLE|example)[A-Za-z0-9+/=_-]*",
)
BASE_KINDS = ("assign", "access", "hex")
_BLOCK = 512


def _summed(lengths: Column, start: Column) -> Column:
    """For each of the lengths, ``start`` and all lengths before it."""
    grown = F.aggregate(lengths, F.array(start), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    return F.slice(grown, 1, F.size(lengths))


def _starts(lengths: Column) -> Column:
    """The sum of all lengths before each one. In blocks, so that the work is no square of the
    number of matches in a long text."""
    zero = F.lit(0).cast("long")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")), lambda b: F.slice(lengths, b * _BLOCK + 1, _BLOCK))
    sums = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda a, n: a + n))
    starts = _summed(sums, zero)
    return F.flatten(F.transform(blocks, lambda b, i: _summed(b, F.element_at(starts, i + 1))))


def _long(column: Column) -> Column:
    return F.length(column).cast("long")


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of structs start, end (code points, end exclusive), found, group: the leftmost
    matches that don't overlap. What stands between matches gives their places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    of_group = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    between = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(found)), _long)
    steps = F.zip_with(between, found, lambda gap, m: gap + _long(m))
    placed = F.zip_with(_starts(steps), F.arrays_zip(between.alias("gap"), found.alias("found"), of_group.alias("group")), _span)
    return F.when(text.rlike(pattern), placed).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,found:string,group:string>>"))


def _span(start: Column, m: Column) -> Column:
    begin = start + m["gap"]
    return F.struct(begin.alias("start"), (begin + _long(m["found"])).alias("end"), m["found"].alias("found"), m["group"].alias("group"))


def least_sum(found: Column, c: CharClass) -> Column:
    """The least sum of ``c * log2(c)`` that a window over the candidate has: its highest entropy.

    State of the fold: counts by symbol, their sum, the least sum so far.
    """
    terms = F.array(*[F.lit(t).cast("long") for t in c.terms])
    term = lambda n: F.element_at(terms, n + 1)
    symbols = F.transform(F.slice(F.split(found, ""), 1, F.length(found)), lambda ch: F.instr(F.lit(c.symbols), ch))
    first = F.slice(symbols, 1, c.window)
    counts = F.transform(F.sequence(F.lit(1), F.lit(len(c.symbols))), lambda s: F.size(F.filter(first, lambda x: x == s)))
    whole = F.aggregate(counts, F.lit(0).cast("long"), lambda a, n: a + term(n))
    state = F.struct(counts.alias("counts"), whole.alias("sum"), whole.alias("least"))
    steps = F.zip_with(
        F.slice(symbols, 1, F.greatest(F.size(symbols) - c.window, F.lit(0))),
        F.slice(symbols, c.window + 1, F.greatest(F.size(symbols) - c.window, F.lit(0))),
        lambda out, into: F.struct(out.alias("out"), into.alias("into")),
    )

    def step(s: Column, x: Column) -> Column:
        out, into, counts = x["out"], x["into"], s["counts"]
        gone, come = F.element_at(counts, out), F.element_at(counts, into)
        total = F.when(out == into, s["sum"]).otherwise(s["sum"] - term(gone) + term(gone - 1) - term(come) + term(come + 1))
        moved = F.transform(counts, lambda n, i: n - (i + 1 == out).cast("int") + (i + 1 == into).cast("int"))
        return F.struct(moved.alias("counts"), total.alias("sum"), F.least(s["least"], total).alias("least"))

    return F.aggregate(F.when(F.size(symbols) > c.window, steps).otherwise(F.slice(steps, 1, 0)), state, step, lambda s: s["least"])


def _kind(spans: Column, kind: str, order: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def _marks(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _high(c: CharClass, allow: str):
    """Whether a candidate has a window of high entropy and isn't on the allow list."""
    return lambda s: ~s["found"].rlike(allow) & (least_sum(s["found"], c) <= F.lit(c.most).cast("long"))


def find(docs: DataFrame, classes: tuple[CharClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """``docs`` with an array ``secrets`` of structs start, order, end, kind: all spans of a text.

    A null or empty text has none. Rows are taken one by one: nulls, repeated rows and other
    columns stay as they are; an empty table gives an empty table. A column named ``secrets`` is
    replaced. No row is moved: the plan is one scan and projections.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    assign = F.filter(matches(text, ASSIGN, 2), lambda s: F.length(s["group"]) >= 6)
    spans = [_kind(assign, "assign", 0), _kind(matches(text, ACCESS), "access", 1), _kind(matches(text, HEX), "hex", 2)]
    allow = "^(?:" + "|".join(f"(?:{a})" for a in allowed) + ")$"
    for order, c in enumerate(classes, len(spans)):
        spans.append(_kind(F.filter(matches(text, c.pattern), _high(c, allow)), c.kind, order))
    return docs.withColumn("secrets", F.array_sort(F.concat(*spans)))


def scan(docs: DataFrame) -> DataFrame:
    """Rows doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy."""
    found = find(docs.select("doc_id", "text"))
    count = lambda *kinds: F.size(F.filter("secrets", lambda s: s["kind"].isin(*kinds))).cast("long")
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(_marks(base), 256).alias("base_sha256"),
        _marks(F.col("secrets")).alias("spans"),
        count(*[c.kind for c in CLASSES]).alias("n_entropy"),
    )


def redact(docs: DataFrame, mark: str = "<SECRET>") -> DataFrame:
    """``docs`` with every span of secrets in ``text`` replaced by ``mark``; spans that touch or
    overlap become one. Texts without secrets, null ones too, stay as they are."""
    found = find(docs)
    last = lambda a: F.element_at(a, -1)
    pair = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    join = lambda acc, s: F.concat(
        F.slice(acc, 1, F.size(acc) - 1), F.array(pair(last(acc)["start"], F.greatest(last(acc)["end"], s["end"])))
    )
    merged = F.aggregate(
        "secrets", empty, lambda acc, s: F.when((F.size(acc) > 0) & (s["start"] <= last(acc)["end"]), join(acc, s)).otherwise(F.concat(acc, F.array(pair(s["start"], s["end"]))))
    )
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(merged, lambda s: s["end"]))
    ends = F.concat(F.transform(merged, lambda s: s["start"]), F.array(_long(F.col("text"))))
    kept = F.zip_with(begins, ends, lambda b, e: F.col("text").substr((b + 1).cast("int"), (e - b).cast("int")))
    return found.withColumn("text", F.when(F.size("secrets") > 0, F.array_join(kept, mark)).otherwise(F.col("text"))).drop("secrets")
