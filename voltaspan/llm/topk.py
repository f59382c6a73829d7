"""Exact top-k by inner product: norm-sorted blocks, rotated partial sums, residual bounds.

Vectors are laid out in blocks by descending length. A query scores the block of the longest
vectors first, which gives it a threshold: the k-th best score there. By Cauchy-Schwarz no vector
of a block scores more than the query's length times the block's greatest, so whole blocks fall
away from queries, and the rest meet in pairs of blocks. Within a block both sides are rotated by
the right singular vectors of a bounded sample, which puts most of the length into the first
coordinates. There the partial sum over those plus the product of both residual lengths bounds
the score; only pairs that can still reach the threshold get the exact integer product.

Every vector that a bound drops scores below the k-th best: results are exact. The rotation
changes only how soon bounds drop a vector. Bounds are in floating point, with a slack in
proportion to the product of both lengths; scores are in whole numbers of any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltaspan.llm.common import flushed, written

ROWS, QUERIES, FIRST = 4096, 4096, 16
_MARGIN, _SLACK = 1e-6, 1e-9
#: Components beyond this size, which no single-precision number reaches, count as this size.
HUGE = 2.0**256
#: Rows of one short record that go to every task, at most.
FEW = 200_000
LONG = 2**63


def integers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """Rows vec_id, v (array of whole doubles): floor(scale * x) of each component as double.
    Vectors that are null or hold a null, NaN or infinite component are left out, and rows of null
    vec_id. An empty vector stays."""

    def whole(e):
        y = F.greatest(F.least(F.lit(float(scale)) * e.cast("double"), F.lit(HUGE)), F.lit(-HUGE))
        return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)  # larger ones are whole

    fine = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select("vec_id", F.transform("embedding", whole).alias("v"))


def rotation(rows: DataFrame, sample: int = 4096) -> np.ndarray:
    """Right singular vectors of at most ``sample`` vectors, those of least id hash, by descending
    singular value. Of vectors of several sizes the most frequent size counts."""
    some = rows.where(F.size("v") > 0).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toLocalIterator()
    by_size: dict[int, list] = {}
    for r in some:
        by_size.setdefault(len(r["v"]), []).append(r["v"])
    if not by_size:
        return np.eye(0)
    most = max(by_size.values(), key=len)
    return np.linalg.svd(np.array(most, np.float64), full_matrices=True)[2].T


def narrow(v: np.ndarray) -> np.ndarray:
    """Whole doubles in the smallest type that holds them."""
    top = np.abs(v).max(initial=0)
    for kind in ("<i2", "<i4"):
        if top < 2 ** (8 * int(kind[2]) - 1):
            return v.astype(kind)
    return v.astype("<f8")


class _Block:
    """Ids, whole vectors and lengths of some rows of one size; what bounds need, once rotated."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, turn: np.ndarray) -> None:
        self.ids, self.v = ids, v
        self.real = v.astype(np.float64)
        self.most = np.abs(self.real).max(initial=0)
        self.length = np.sqrt((self.real**2).sum(axis=1))
        turned = self.real @ turn if turn.shape[0] == v.shape[1] else self.real
        self.head = np.ascontiguousarray(turned[:, :FIRST])
        self.rest = np.sqrt((turned[:, FIRST:] ** 2).sum(axis=1))


def exact(q: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Whole inner products row by row; ``most`` bounds the product of two components."""
    if most * max(1, q.shape[1]) < 2.0**62:
        return np.einsum("ij,ij->i", q.astype(np.int64), b.astype(np.int64))
    return np.array([sum(int(x) * int(y) for x, y in zip(u, v)) for u, v in zip(q.tolist(), b.tolist())] + [None], object)[:-1]


def best(q: _Block, b: _Block, k: int, least: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(query, vec_id, score): for each query the k best of a block, of those that can reach
    ``least``. ``b`` is in descending length, or nearly."""
    if not len(b.ids) or not len(q.ids):
        return
    longest = b.length.max()
    for i in range(0, len(q.ids), 64):
        part = slice(i, i + 64)
        floor, length = least[part], q.length[part]
        need = np.where(np.isfinite(floor), floor * (1 - np.sign(floor) * _MARGIN) - 1, -np.inf)
        if (length * longest * (1 + _SLACK) < need).all():
            continue
        bound = q.head[part] @ b.head.T + q.rest[part, None] * b.rest
        if np.isinf(need).any():  # no threshold yet: the first of the block, the longest, give one
            head = np.sort(q.real[part] @ b.real[: max(64, 4 * k)].T, axis=1)[:, ::-1]
            if head.shape[1] > k:  # one more, as the query itself doesn't count
                need = np.maximum(need, head[:, k] - 1 - _SLACK * length * longest)
        rows, cols = np.nonzero(bound >= need[:, None] - _SLACK * length[:, None] * b.length)
        own = q.ids[part][rows] == b.ids[cols]
        rows, cols = rows[~own], cols[~own]
        if not len(rows):
            continue
        score = np.concatenate([exact(q.v[part][rows[j : j + (1 << 16)]], b.v[cols[j : j + (1 << 16)]], q.most * b.most) for j in range(0, len(rows), 1 << 16)])
        place = score if score.dtype != object else np.unique(score, return_inverse=True)[1]
        order = np.lexsort((b.ids[cols], -place, rows))
        rows, cols, score = rows[order], cols[order], score[order]
        starts = np.searchsorted(rows, np.arange(rows[-1] + 2))
        take = np.arange(len(rows)) - starts[rows] < k
        yield from zip(q.ids[part][rows[take]].tolist(), b.ids[cols[take]].tolist(), score[take].tolist())


BLOCK = pa.schema([("size", pa.int32()), ("kind", pa.string()), ("ids", pa.binary()), ("v", pa.binary()), ("longest", pa.float64())])
BLOCK_COLUMNS = "size int, kind string, ids binary, v binary, longest double"


def _packed(rows: DataFrame, each: int) -> DataFrame:
    """One row per block of at most ``each`` vectors of one size, in descending length; ``part``
    tells blocks apart."""

    def pack(batches: Iterator[pa.RecordBatch]):
        held: list[tuple[int, np.ndarray]] = []

        def block():
            v = np.array([x[1] for x in held], np.float64).reshape(len(held), -1)
            longest, v = float(np.sqrt((v**2).sum(axis=1)).max()), narrow(v)
            row = (v.shape[1], v.dtype.str, np.array([x[0] for x in held], np.int64).tobytes(), v.tobytes(), longest)
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, BLOCK)], schema=BLOCK)

        for b in batches:
            values, cuts = b.column(1).values.to_numpy(), b.column(1).offsets.to_pylist()
            for vec_id, i, j in zip(b.column(0).to_pylist(), cuts, cuts[1:]):
                if held and (len(held) == each or len(held[0][1]) != j - i):
                    yield block()
                    held = []
                held.append((vec_id, values[i:j]))
        if held:
            yield block()

    squared = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    keyed = rows.select("vec_id", "v", F.size("v").alias("n"), squared.alias("squared"))
    placed = keyed.repartitionByRange(F.col("n"), F.col("squared").desc(), "vec_id").sortWithinPartitions("n", F.col("squared").desc(), "vec_id")
    return placed.select("vec_id", "v").mapInArrow(pack, BLOCK_COLUMNS).withColumn("part", F.monotonically_increasing_id())


def _block(size: int, kind: str, ids: bytes, v: bytes, turn: np.ndarray) -> _Block:
    of = np.frombuffer(ids, np.int64)
    return _Block(of, np.frombuffer(v, kind).reshape(len(of), size), turn)


def _small(rows: DataFrame) -> DataFrame:
    """Up to FEW rows (of numbers, or of one block for each size) go to every task; more are met by a shuffle."""
    return F.broadcast(rows) if rows.limit(FEW + 1).count() <= FEW else rows


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """Rows query_id, rank (from 1), vec_id, score: the k candidates (all, if fewer) of the
    greatest integer inner product, ties to the smaller vec_id. ``queries`` are rows of the same
    columns; a candidate of the query's own id doesn't count.

    Vectors that are null or hold null or non-finite components, and rows of null id, take no
    part. Vectors meet those of their own size only; empty ones score 0 with each other. Of rows
    of one id the first by components stays. A score that no long holds is given as the nearest
    long, and ranks as it is. Components beyond HUGE count as HUGE. Other columns are not read.
    Empty tables give an empty table.
    """
    rows = written(integers(vectors, scale).groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    asked = integers(queries, scale).groupBy("vec_id").agg(F.min("v").alias("v"))
    turn = vectors.sparkSession.sparkContext.broadcast(rotation(rows))
    blocks = written(_packed(rows, ROWS), "blocks")
    wanted = written(_packed(asked, QUERIES), "queries")
    names = ["size", "kind", "ids", "v"]

    # the longest vectors of each size: one block per size, at most ROWS vectors
    leads = blocks.groupBy("size").agg(F.max_by(F.struct("kind", "ids", "v"), F.struct("longest", -F.col("part"))).alias("lead"))
    few_sizes = leads.limit(65).count() <= 64  # half a megabyte each, as a rule
    lead_schema = pa.schema([("part", pa.int64()), ("query_id", pa.int64()), ("score", pa.float64())])

    def seed(batches: Iterator[pa.RecordBatch]):
        def out():
            for x in batches:
                for part, size, kind, ids, v, lead_kind, lead_ids, lead_v in zip(*(c.to_pylist() for c in x.columns)):
                    q, b = _block(size, kind, ids, v, turn.value), _block(size, lead_kind, lead_ids, lead_v, turn.value)
                    yield from ((part, query, float(score)) for query, _, score in best(q, b, k, np.full(len(q.ids), -np.inf)))

        yield from flushed(out(), lead_schema)

    first = wanted.join(F.broadcast(leads) if few_sizes else leads, "size").select("part", *names, "lead.kind", "lead.ids", "lead.v").toDF("part", *names, "lead_kind", "lead_ids", "lead_v")
    first = first.mapInArrow(seed, "part long, query_id long, score double")
    top = first.groupBy("part", "query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))  # k scores each
    floors = top.where(F.size("s") >= k).groupBy("part").agg(F.collect_list(F.struct("query_id", F.get("s", F.lit(k - 1)).alias("floor"))).alias("floors"))  # QUERIES each
    grouped = written(wanted.join(floors, "part", "left").withColumnRenamed("part", "query_part"), "asked")

    def floor_of(ids: np.ndarray, floors) -> np.ndarray:
        known = {f["query_id"]: f["floor"] for f in floors or ()}
        return np.array([known.get(i, -np.inf) for i in ids.tolist()], np.float64)

    # which blocks a block of queries needs: the greatest length times the block's reaches a floor
    need_schema = pa.schema([("query_part", pa.int64()), ("size", pa.int32()), ("least", pa.float64())])

    def needs(batches: Iterator[pa.RecordBatch]):
        def out():
            for x in batches:
                for part, size, kind, ids, v, floors in zip(*(c.to_pylist() for c in x.columns)):
                    q = _block(size, kind, ids, v, np.eye(0))
                    floor = floor_of(q.ids, floors)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        least = np.where((floor > 0) & (q.length > 0), floor / q.length, -1.0).min()
                    yield part, size, least * (1 - _MARGIN) if least > 0 else -1.0

        yield from flushed(out(), need_schema)

    bounds = blocks.select("part", "size", "longest")
    needed = grouped.select("query_part", *names, "floors").mapInArrow(needs, "query_part long, size int, least double")
    pairs = written(needed.join(_small(bounds), "size").where("longest >= least").select("query_part", "part"), "block-pairs")
    tasks = pairs.repartition("part", "query_part").join(grouped, "query_part")
    tasks = tasks.join(blocks.select("part", F.col("kind").alias("b_kind"), F.col("ids").alias("b_ids"), F.col("v").alias("b_v")), "part").select(*names, "floors", "b_kind", "b_ids", "b_v")
    found_schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("beyond", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]):
        def out():
            for x in batches:
                for i in range(x.num_rows):
                    size, kind, ids, v, floors, b_kind, b_ids, b_v = (c[i].as_py() for c in x.columns)
                    q = _block(size, kind, ids, v, turn.value)
                    for query, vec_id, score in best(q, _block(size, b_kind, b_ids, b_v, turn.value), k, floor_of(q.ids, floors)):
                        fits = -LONG < score < LONG - 1
                        yield query, vec_id, min(max(score, -LONG), LONG - 1), None if fits else (score + (1 << 700)).to_bytes(96)

        yield from flushed(out(), found_schema)

    found = tasks.mapInArrow(run, "query_id long, vec_id long, score long, beyond binary")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("beyond").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
