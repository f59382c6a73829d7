"""Packing token streams into windows, by deficit round robin over source queues.

Every source is a queue of its documents' tokens in ascending doc_id order. A window has ``size``
tokens. Each turn a queue's credit grows by its quantum, its share of the window; it serves the
whole tokens of its credit and carries the rest, its deficit, to the next window.

With the shares fixed, credit after any number of windows has a closed form. So a partition that
begins at a window takes up exactly the deficits with which the one before it ends: nothing is
handed on from task to task. Let ``A[k]`` be the sum of the shares of queues 0 to k and ``A`` that
of all. After w windows queues 0 to k have together served ``floor(size * w * A[k] / A)`` tokens,
and queue k the difference from queues 0 to k-1. So windows are full, and no queue is ever a whole
token away from its target. It needs two tokens of quantum in a queue; smaller ones share one.
When a queue runs dry under other shares than the corpus has, its credit goes to those left: one
window is dealt token by token, and a new run of windows begins (``Schedule``).
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltaspan.llm.bpe import groups
from voltaspan.llm.common import NULL_ID, flushed, id_array, id_bounds, ranges, trim, written
from voltaspan.llm.wordcache import vocabulary_size, word_cache


class Schedule:
    """Which tokens of which queue go to which window. ``totals``: tokens of each queue."""

    def __init__(self, totals: list[int], size: int, shares: list[int] | None = None) -> None:
        self.size, self.totals = size, totals
        #: Runs of windows: first window, tokens that each queue served before it, cumulated shares.
        self.runs: list[tuple[int, list[int], list[int]]] = []
        left, served, window = list(totals), [0] * len(totals), 0
        while any(left):
            weights = list(totals) if shares is None else [s if n else 0 for s, n in zip(shares, left)]
            if not sum(weights):  # only queues without a share are left: by what they still have
                weights = left
            cumulated = [0]
            for x in weights:
                cumulated.append(cumulated[-1] + x)
            self.runs.append((window, served, cumulated))
            windows = -(-sum(left) // size) if shares is None else self._until_dry(left, cumulated)
            if shares is not None and windows == 0:
                take = self._dealt(left, weights)
                self.runs[-1] = (window, served, [0, *np.cumsum(take).tolist()])  # one window, as dealt
                windows, gone = 1, take
            else:
                ends = [self._upto(c, cumulated[-1], windows) for c in cumulated]
                gone = [min(n, b - a) for a, b, n in zip(ends, ends[1:], left)]
            window += windows
            served = [a + b for a, b in zip(served, gone)]
            left = [a - b for a, b in zip(left, gone)]
        self.windows, self.first = window, [r[0] for r in self.runs]

    def _upto(self, share: int, whole: int, windows: int) -> int:
        return self.size * windows * share // whole

    def _until_dry(self, left: list[int], cumulated: list[int]) -> int:
        """Windows for which every queue with a share has its quota."""
        low, high = 0, sum(left) // self.size
        while low < high:
            mid = (low + high + 1) // 2
            ends = [self._upto(c, cumulated[-1], mid) for c in cumulated]
            if all(b - a <= n for a, b, n in zip(ends, ends[1:], left)):
                low = mid
            else:
                high = mid - 1
        return low

    def _dealt(self, left: list[int], weights: list[int]) -> list[int]:
        """One window in which queues run dry: room goes round by the shares of those that have tokens."""
        take, room = [0] * len(left), min(self.size, sum(left))
        while room:
            live = [k for k, n in enumerate(left) if take[k] < n and weights[k]] or [k for k, n in enumerate(left) if take[k] < n]
            whole = sum(weights[k] or 1 for k in live)
            for k in live:
                more = min(left[k] - take[k], room, max(1, room * (weights[k] or 1) // whole))
                take[k] += more
                room -= more
        return take

    def served(self, queue: int, window: int) -> tuple[int, int]:
        """Tokens that the queue, and that all queues before it in this run, served before the window."""
        first, before, cumulated = self.runs[max(0, bisect_right(self.first, window) - 1)]
        low = self._upto(cumulated[queue], cumulated[-1], window - first)
        return before[queue] + self._upto(cumulated[queue + 1], cumulated[-1], window - first) - low, low

    def pieces(self, queue: int, start: int, n: int) -> Iterator[tuple[int, int, int]]:
        """Window, offset in it and length of the pieces of tokens start to start + n of a queue."""
        low, high = 0, self.windows
        guess = start * self.windows // max(self.totals[queue], 1)  # queues are mostly served alike throughout
        if self.served(queue, least := max(0, guess - 2))[0] <= start:
            low = least
        if (most := guess + 3) < self.windows and self.served(queue, most)[0] > start:
            high = most - 1
        while low < high:  # the last window before which at most ``start`` tokens were served
            mid = (low + high + 1) // 2
            if mid < self.windows and self.served(queue, mid)[0] <= start:
                low = mid
            else:
                high = mid - 1
        window, end = low, start + n
        mine = self.served(queue, window)[0]
        while start < end:
            until = self.served(queue, window + 1)[0] if window + 1 < self.windows else self.totals[queue]
            take = min(end, until) - start
            if take > 0:
                yield window, self._lead(queue, window) + start - mine, take
                start += take
            mine = until
            window += 1

    def _lead(self, queue: int, window: int) -> int:
        """Tokens of the window that come from queues before this one."""
        run = max(0, bisect_right(self.first, window) - 1)
        first, before, cumulated = self.runs[run]
        at = window - first
        if window + 1 < self.windows:
            return self._upto(cumulated[queue], cumulated[-1], at + 1) - self._upto(cumulated[queue], cumulated[-1], at)
        # the last window takes what is left
        return sum(self.totals[:queue]) - sum(before[:queue]) - self._upto(cumulated[queue], cumulated[-1], at)


def queue_shares(totals: dict, rest: int, size: int, mixture: dict | None) -> tuple[dict, int, list[int], list[int] | None]:
    """Queue of each source in ``totals``, queue of all other sources (``rest`` tokens together),
    tokens of each queue, share of each queue.

    Without a mixture the shares are those of the corpus. Sources with a quantum of less than two
    tokens go into one queue with the others; if that has less than two, into the smallest other
    queue.
    """
    weight = {s: n if mixture is None else round(mixture.get(s, 0) * 2**32) for s, n in totals.items()}
    left = rest if mixture is None else 0
    whole = (sum(weight.values()) + left) or 1
    order = sorted(totals, key=lambda s: (s is not None, s))
    large = [s for s in order if weight[s] * size >= 2 * whole]
    small = [s for s in order if weight[s] * size < 2 * whole]
    queues = [[s] for s in large]
    if not large or (sum(weight[s] for s in small) + left) * size >= 2 * whole:
        queues, others = [*queues, small], len(queues)
    else:
        others = min(range(len(queues)), key=lambda k: weight[queues[k][0]])
        queues[others].extend(small)
    of = {s: k for k, q in enumerate(queues) for s in q}
    tokens = [sum(totals[s] for s in q) + rest * (k == others) for k, q in enumerate(queues)]
    return of, others, tokens, None if mixture is None else [sum(weight[s] for s in q) for q in queues]


TOKENS = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("part", pa.int32()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, spaced: bool = False, end_id: int = 2, size: int = 4096, mixture: dict | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset
    (and ids, little-endian unsigned 16-bit, if asked for).

    Documents are encoded whole (null text: empty) and ``end_id`` is added; every id is in exactly
    one piece. All sequences but the last are full. Queues are the values of ``source`` (null is
    one of them); ``mixture`` maps sources to target proportions. Null ids come first in their
    queue; repeated rows stay, and rows of equal doc_id go by their ids. Other columns are not
    read. An empty table gives no piece.

    The driver gets the tokens of the sources that have a queue of their own, and no document. A
    vocabulary that 16 bits don't hold is an error.
    """
    if max(end_id + 1, vocabulary_size(path)) > 1 << 16:
        raise ValueError(f"ids of {path} don't fit into two bytes")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"))
    bounds = id_bounds(texts, "doc_id", ranges(texts))

    def encode(batches: Iterator[pa.RecordBatch]):
        trim()
        w = word_cache(path, spaced)

        def rows():
            for keys, found in groups(batches):
                parts = np.searchsorted(bounds, id_array(pa.array([k[0] for k in keys], pa.int64())), "right").tolist()
                for part, (key, source), x in zip(parts, keys, w.encode_batch(found)):
                    ids = np.append(np.frombuffer(x, "<u4"), np.uint32(end_id))
                    yield key, source, part, len(ids), ids.astype("<u2").tobytes()

        yield from flushed(rows(), TOKENS, nbytes=4 << 20)

    rows = texts.select("doc_id", "source", "text")
    tokens = written(rows.mapInArrow(encode, "doc_id long, source string, part int, n_tokens long, ids binary"), "tokens")
    by_source = written(tokens.groupBy("source").agg(F.sum("n_tokens").alias("n")), "sources")
    whole = by_source.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # sources of two tokens a window or more: size / 2 of them at most; or those that the mixture names
    named = F.col("n") * size >= 2 * whole if mixture is None else F.coalesce(F.col("source").isin([s for s in mixture if s is not None]), F.lit(None in mixture))
    by_name = {r["source"]: r["n"] for r in by_source.where(named).toLocalIterator()}
    of, others, totals, shares = queue_shares(by_name, whole - sum(by_name.values()), size, mixture)
    schedule = Schedule(totals, size, shares)
    spark = docs.sparkSession
    queues = F.broadcast(spark.createDataFrame([(s, k) for s, k in of.items()], "source string, queue int"))  # at most size / 2 rows, or the mixture's
    queued = tokens.join(queues, tokens["source"].eqNullSafe(queues["source"]), "left").drop(queues["source"]).withColumn("queue", F.coalesce("queue", F.lit(others)))

    # tokens before each id range of a queue, from one row per range and queue
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranged = queued.groupBy("queue", "part").agg(F.sum("n_tokens").alias("n"))
    starts = ranged.select("queue", "part", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("before"))

    schema = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")] + [("ids", pa.binary())] * with_ids)

    def cut(batches: Iterator[pa.RecordBatch]):
        at = (None, 0)

        def rows():
            nonlocal at
            for b in batches:
                fixed = zip(*(b.column(i).to_pylist() for i in range(5)), b.column(5))
                for queue, part, start_of, doc_id, n, ids in fixed:
                    if at[0] != (queue, part):
                        at = ((queue, part), start_of)
                    ids, done = np.frombuffer(ids.as_py(), "<u2"), 0
                    for window, offset, length in schedule.pieces(queue, at[1], n):
                        piece = ids[done : done + length]
                        row = (doc_id, done, length, zlib.crc32(piece.astype("<u4")), n, window, offset)
                        yield (*row, piece.tobytes()) if with_ids else row
                        done += length
                    at = (at[0], at[1] + n)

        yield from flushed(rows(), schema)

    parted = queued.join(F.broadcast(starts) if ranged_is_small(starts) else starts, ["queue", "part"])
    ordered = parted.select("queue", "part", "before", "doc_id", "n_tokens", "ids").repartition("queue", "part")
    ordered = ordered.sortWithinPartitions("queue", "part", F.coalesce("doc_id", F.lit(NULL_ID)), "ids")
    return ordered.mapInArrow(cut, PIECES + ", ids binary" * with_ids)


def ranged_is_small(starts: DataFrame, most: int = 200_000) -> bool:
    """One row of three numbers per id range and queue; broadcast only up to ``most`` of them."""
    return starts.limit(most + 1).count() <= most
