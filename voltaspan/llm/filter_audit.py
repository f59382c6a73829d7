"""Audit of filters that are applied one after another: what each removes, in every order.

Each document has a mask: one bit for each filter that it fails. Spark makes the masks from whole
texts and counts them by part. What is left of a part, however large, is at most a row for each
mask and label. On these a decision diagram is built, one level for each filter, equal nodes kept
once, with the number of documents below each node. Swaps of adjacent levels take it through all
orders of the filters. In an order, documents that the step removes are those below the failing
branch of the path on which all filters so far have passed.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltaspan.llm.common import written

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
#: Conditions A to D hold 200 words, a share of 50 % distinct words, 2 % capitals, and these signs.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 200, 50, 2, r"[#$%&*|]"

Count = tuple[int, int, int]  # documents, good ones, toxic ones


def _plus(a: Count, b: Count) -> Count:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


class Diagram:
    """A decision diagram over failure masks with the counts of documents as weights.

    Nodes of a level are kept by what they lead to: (passing child, failing child), so equal parts
    of the function are one node. Leaves are counts. Every path has all levels, so the weight of a
    node is the sum of its children's.
    """

    def __init__(self, counts: dict[int, Count], order: str = FILTERS):
        self.order = list(order)
        self.children: list[tuple[int, int] | None] = []
        self.weight: list[Count] = []
        self.known: dict[tuple, int] = {}
        bits = [1 << FILTERS.index(f) for f in order]

        def build(level: int, mask: int) -> int:
            if level == len(bits):
                return self._leaf(counts.get(mask, (0, 0, 0)))
            return self._node(level, build(level + 1, mask), build(level + 1, mask | bits[level]))

        self.root = build(0, 0)

    def _leaf(self, count: Count) -> int:
        return self._kept(("leaf", count), None, count)

    def _node(self, level: int, passed: int, failed: int) -> int:
        return self._kept((level, passed, failed), (passed, failed), _plus(self.weight[passed], self.weight[failed]))

    def _kept(self, key: tuple, children: tuple[int, int] | None, weight: Count) -> int:
        if key not in self.known:
            self.known[key] = len(self.children)
            self.children.append(children)
            self.weight.append(weight)
        return self.known[key]

    def swap(self, level: int) -> None:
        """The filters at ``level`` and the next change places. Only nodes of these two levels are
        made anew: of the four grandchildren of a node the middle ones change sides."""
        moved: dict[int, int] = {}

        def down(node: int, at: int) -> int:
            if node not in moved:
                passed, failed = self.children[node]
                if at < level:
                    moved[node] = self._node(at, down(passed, at + 1), down(failed, at + 1))
                else:
                    (pp, pf), (fp, ff) = self.children[passed], self.children[failed]
                    moved[node] = self._node(level, self._node(level + 1, pp, fp), self._node(level + 1, pf, ff))
            return moved[node]

        self.root = down(self.root, 0)
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> Iterator[tuple[str, Count, Count]]:
        """Filter, what is kept after it, what it removes, along the path on which all pass."""
        at = self.root
        for name in self.order:
            at, failed = self.children[at]
            yield name, self.weight[at], self.weight[failed]


def swaps(n: int) -> list[int]:
    """Levels to swap, one after another, so that every order of n comes up once: the last element
    sweeps through each order of the others."""
    if n < 2:
        return []
    out: list[int] = []
    for i, inner in enumerate([*swaps(n - 1), None]):
        out += range(n - 2, -1, -1) if i % 2 == 0 else range(n - 1)
        if inner is not None:
            out.append(inner + (i % 2 == 0))  # the swept element stands at the front or at the end
    return out


def audit(counts: dict[int, Count]) -> list[tuple]:
    """Rows filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley for all orders and steps."""
    diagram = Diagram(counts)
    orders: list[tuple[str, list]] = [("".join(diagram.order), list(diagram.steps()))]
    for level in swaps(len(FILTERS)):
        diagram.swap(level)
        orders.append(("".join(diagram.order), list(diagram.steps())))
    shapley, fails, unique = dict.fromkeys(FILTERS, 0), {}, {}
    for order, steps in orders:
        fails[order[0]] = steps[0][2][0]
        unique[order[-1]] = steps[-1][2][0]
        for name, _, removed in steps:
            shapley[name] += removed[0]
    return [
        (order, i, kept[0], removed[0], fails[name] - removed[0], unique[name], removed[1], removed[2], shapley[name])
        for order, steps in orders for i, (name, kept, removed) in enumerate(steps, 1)
    ]


def conditions(text: Column, words: Column) -> list[Column]:
    """Whether a text fails A, B, C, D; ``words`` are its words."""
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * F.length(text), text.rlike(SIGNS)]


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows part, mask, good, toxic, n (documents): counted, so parts of any size are small.

    Texts are read once; what goes on is a narrow table of ids, masks and hashes (SHA-256), written
    to the shared folder. Only texts that several ids have are looked up again, by their hashes.
    """
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    split = whole.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    text = F.col("text")
    four = sum((F.when(c, F.lit(1 << i)).otherwise(0) for i, c in enumerate(conditions(text, F.col("words")))), F.lit(0))
    narrow = written(split.select("doc_id", "part", four.cast("int").alias("mask"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("hash")), "masks")
    # written, so that joins read both sides from shuffles alone: Spark can split a hot text or id there
    first = written(narrow.groupBy("hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("last > first").select("hash", "first"), "originals")
    flags = [F.max(F.coalesce(F.col(a) == 1, F.lit(False))).alias(b) for a, b in (("quality", "good"), ("toxic", "toxic_doc"))]
    marked = written(labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*flags), "labels")
    copy = F.when(F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)), 1 << 4).otherwise(0)
    rows = narrow.join(first, "hash", "left").join(marked, "doc_id", "left")
    return rows.groupBy("part", (F.col("mask") + copy).alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic_doc", F.lit(False)).alias("toxic")).agg(F.count("*").alias("n"))


_COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def interactions(counted: DataFrame) -> DataFrame:
    """The audit of each part from rows part, mask, good, toxic, n, as ``masks`` gives them: 128 of
    a part at most meet in a task."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        counts: dict[int, Count] = {}
        for mask, good, toxic, n in zip(*(pdf[c].tolist() for c in ("mask", "good", "toxic", "n"))):
            counts[mask] = _plus(counts.get(mask, (0, 0, 0)), (n, n * good, n * toxic))
        found = pd.DataFrame(audit(counts), columns=["filter_order", "step", *_COLUMNS])
        found.insert(0, "part", pdf["part"].iloc[0])
        return found

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COLUMNS)
    return counted.groupBy("part").applyInPandas(one, schema)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Five filters over whole texts: one row per part (source), order and step.

    A null text counts as empty, a null source as the empty part. An empty text fails A alone, and E
    if a smaller id has one too. Ids that are null are neither copies nor originals; rows that
    repeat an id with its text are no copies of each other. Labels that repeat an id count once: one
    row of quality 1 (toxic 1) is enough; null labels count as none. Columns beyond doc_id, text and
    source are passed over. An empty table gives no row.
    """
    return interactions(masks(docs, labels))


def orders(names: Sequence[str] = FILTERS) -> list[str]:
    """All orders of the filters."""
    return ["".join(p) for p in itertools.permutations(names)]
