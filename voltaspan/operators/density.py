"""Density clusters of points by key, however many points a key has.

A key of up to ``BLOCK`` points is clustered in one task. A larger one's points are sorted along a
Z-shaped curve and cut into blocks that lie close together, and the spanning tree grows by rounds of
Boruvka: every component takes its nearest foreign point. Points are compared within their block and
with blocks whose boxes are nearer than what their components have found so far, so no key's points
meet in one place. The tree of a key, three numbers a point, is condensed in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltaspan.functions import numeric
from voltaspan.operators.groups import together
from voltaspan.sources.shared import kept

BLOCK = 1024


def types(df: DataFrame, names: Sequence[str]) -> str:
    of = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"`{n}` {of[n]}" for n in names)


def _curve(x: np.ndarray, low: np.ndarray, high: np.ndarray, bits: int = 16) -> np.ndarray:
    """Places on a Z-shaped curve: the bits of all coordinates in turn."""
    span = np.where(high > low, high - low, 1.0)
    cells = np.clip((x - low) / span * (2**bits - 1), 0, 2**bits - 1).astype(np.int64)
    out = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, -1, -1):
        for c in cells.T:
            out = (out << 1) | ((c >> bit) & 1)
    return out


def blocked(points: DataFrame, keys: Sequence[str], dims: int, size: int) -> DataFrame:
    """Points (keys, id, x) with ``block``: runs of up to ``size`` along the curve, by key."""
    ends = points.groupBy(*keys).agg(*[f(F.col("x")[k]).alias(f"{name}{k}") for k in range(dims) for f, name in ((F.min, "low"), (F.max, "high"))])
    placed = points.join(ends, list(keys))
    names = [*keys, "id", "x"]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array(pdf["x"].tolist(), float).reshape(-1, dims)
            low, high = (np.column_stack([pdf[f"{name}{k}"] for k in range(dims)]) for name in ("low", "high"))
            yield pdf[names].assign(z=_curve(x, low, high))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, run, now, n = TaskContext.get().partitionId(), 0, None, 0
        for pdf in batches:
            blocks = []
            for key in pdf[list(keys)].itertuples(index=False, name=None):
                if key != now or n == size:
                    run, now, n = run + 1, key, 0
                n += 1
                blocks.append((part << 32) + run)
            yield pdf[names].assign(block=blocks)

    on_curve = placed.mapInPandas(place, types(points, names) + ", z long")
    parts = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-points.count() // (64 * size)))
    ordered = on_curve.repartitionByRange(parts, *keys, "z", "id").sortWithinPartitions(*keys, "z", "id")
    return ordered.mapInPandas(cut, types(points, names) + ", block long")


def _nearest_foreign(x, core, comp, ids, y, core_y, comp_y, ids_y) -> dict:
    """Of each component its least edge to a point of another: (distance, ends) and that component."""
    best: dict = {}
    for start in range(0, len(x), 256):
        of = slice(start, start + 256)
        reach = np.maximum(np.sqrt(((x[of, None] - y[None]) ** 2).sum(axis=2)), np.maximum(core[of, None], core_y[None]))
        reach[comp[of, None] == comp_y[None]] = np.inf
        least = reach.min(axis=1)
        for i in np.flatnonzero(np.isfinite(least)):
            ties = np.flatnonzero(reach[i] == least[i])  # all, so that ends decide alike wherever they are compared
            j = min(ties, key=lambda j: (min(ids[start + i], ids_y[j]), max(ids[start + i], ids_y[j])))
            a, b = int(ids[start + i]), int(ids_y[j])
            edge = (float(least[i]), min(a, b), max(a, b), int(comp_y[j]))
            mine = int(comp[start + i])
            if mine not in best or edge < best[mine]:
                best[mine] = edge
    return best


_EDGE = "comp long, distance double, a long, b long, other long"


def _arrays(row, dims: int):
    return np.array(row["x"], float).reshape(-1, dims), np.array(row["core"], float), np.array(row["comp"]), np.array(row["ids"])


def _round(points: DataFrame, keys: Sequence[str], dims: int) -> DataFrame:
    """The least outgoing edge of each component: keys, comp, distance, a, b, other."""
    at = lambda k: lambda s: s["x"][k]
    packed = kept(
        points.groupBy(*keys, "block").agg(F.sort_array(F.collect_list(F.struct("id", "x", "core", "comp"))).alias("s")).select(
            *keys, "block", F.col("s.id").alias("ids"), F.flatten("s.x").alias("x"), F.col("s.core").alias("core"), F.col("s.comp").alias("comp"),
            *[F.array(*[f(F.transform("s", at(k))) for k in range(dims)]).alias(name) for f, name in ((F.array_min, "low"), (F.array_max, "high"))],
            F.array_max("s.core").alias("most_core"), F.array_distinct("s.comp").alias("comps"),
        ),
        "blocks",
    )

    def edges(pairs: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for row in pdf.to_dict("records"):
                    one = _arrays(row, dims)
                    two = _arrays({c: row[f"{c}_2"] for c in ("x", "core", "comp", "ids")}, dims) if pairs else one
                    for a, b in ((one, two), (two, one))[: 1 + pairs]:
                        out += [(*(row[k] for k in keys), comp, *edge) for comp, edge in _nearest_foreign(*a, *b).items()]
                yield pd.DataFrame(out, columns=[*keys, "comp", "distance", "a", "b", "other"])

        return run

    schema = f"{types(points, keys)}, {_EDGE}"
    inner = kept(packed.where("size(comps) > 1").select(*keys, "ids", "x", "core", "comp").mapInPandas(edges(False), schema), "edges")
    # boxes of two blocks bound the distances between their points from below and above
    boxes = packed.select(*keys, "block", "low", "high", "most_core", F.size("comps").alias("n"), F.col("comps")[0].alias("one"))
    other = boxes.select(*keys, *[F.col(c).alias(f"{c}_2") for c in ("block", "low", "high", "most_core", "n", "one")])
    square = lambda f: sum((f(k) * f(k) for k in range(dims)), F.lit(0.0))
    gap = square(lambda k: F.greatest(F.lit(0.0), F.col("low")[k] - F.col("high_2")[k], F.col("low_2")[k] - F.col("high")[k]))
    reach = square(lambda k: F.greatest(F.col("high")[k] - F.col("low_2")[k], F.col("high_2")[k] - F.col("low")[k]))
    pairs = boxes.join(other, list(keys)).where("block != block_2 and not (n = 1 and n_2 = 1 and one = one_2)").select(
        *keys, "block", "block_2", F.sqrt(gap).alias("gap"), F.greatest(F.sqrt(reach), "most_core", "most_core_2").alias("reach"), "n", "one"
    )
    pairs = kept(pairs, "pairs")
    found = inner.groupBy(*keys, "comp").agg(F.min("distance").alias("bound")).unionByName(pairs.where("n = 1").groupBy(*keys, F.col("one").alias("comp")).agg(F.min("reach").alias("bound")))
    bound = found.groupBy(*keys, "comp").agg(F.min("bound").alias("bound"))
    of_block = packed.select(*keys, "block", F.explode("comps").alias("comp")).join(bound, [*keys, "comp"], "left").groupBy(*keys, "block").agg(F.max(F.coalesce("bound", F.lit(float("inf")))).alias("bound"))
    near = pairs.join(of_block, [*keys, "block"]).where("gap <= bound").select(*keys, F.least("block", "block_2").alias("block"), F.greatest("block", "block_2").alias("block_2")).distinct()
    sides = packed.select(*keys, "block", "ids", "x", "core", "comp")
    seconds = sides.select(*keys, F.col("block").alias("block_2"), *[F.col(c).alias(f"{c}_2") for c in ("ids", "x", "core", "comp")])
    across = near.join(sides, [*keys, "block"]).join(seconds, [*keys, "block_2"]).drop("block", "block_2").mapInPandas(edges(True), schema)
    least = F.min(F.struct("distance", "a", "b", "other"))
    return inner.unionByName(across).groupBy(*keys, "comp").agg(least.alias("e")).select(*keys, "comp", "e.*")


def _roots(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows keys, comp, root: components that edges join get one root. Each has one edge; where two
    take each other, the smaller is the root; pointers then jump to their pointer's."""
    back = edges.select(*keys, F.col("comp").alias("other"), F.col("other").alias("back"))
    now = kept(edges.join(back, [*keys, "other"], "left").select(*keys, "comp", F.when((F.col("back") == F.col("comp")) & (F.col("comp") < F.col("other")), F.col("comp")).otherwise(F.col("other")).alias("root")), "roots")
    while True:
        ahead = now.select(*keys, F.col("comp").alias("root"), F.col("root").alias("next"))
        later = kept(now.join(ahead, [*keys, "root"]).select(*keys, "comp", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "roots")
        now = later.drop("moved")
        if not later.where("moved").take(1):
            return now


def spanning_tree(points: DataFrame, keys: Sequence[str], dims: int, block: int = BLOCK) -> DataFrame:
    """Rows keys, distance, a, b: a minimum spanning tree of each key's points (keys, ``id``, ``x``,
    ``core``) by mutual reachability. Ids are unique in their key."""
    cores = points.select(*keys, "id", "core")
    now = kept(blocked(points.select(*keys, "id", "x"), keys, dims, block).join(cores, [*keys, "id"]).withColumn("comp", F.col("id")), "points")
    tree = None
    while True:
        found = kept(_round(now, keys, dims), "found")
        if not found.take(1):
            return tree if tree is not None else found.select(*keys, "distance", "a", "b")
        new = found.select(*keys, "distance", "a", "b").distinct()
        tree = new if tree is None else tree.unionByName(new)
        roots = _roots(found, keys)
        # a component without an edge has its key to itself
        now = kept(now.join(roots, [*keys, "comp"], "left").withColumn("comp", F.coalesce("root", "comp")).drop("root"), "points")


def density_clusters(rows: DataFrame, keys: Sequence[str], item: str, columns: Sequence[str], least: int = 5, epsilon: float = 0.0, block: int = BLOCK) -> DataFrame:
    """Rows keys, item, cluster of every row: clusters of varying density in a key, -1 for noise.

    Clusters have ``least`` points or more and part above the distance ``epsilon``. Rows with a column
    that is null or not finite are noise. A point's nearest neighbour alone counts for its density,
    so reachability is plain distance. Clusters are numbered by their first item.
    """
    keys, columns = list(keys), list(columns)
    fine = F.lit(True)
    for c in columns:
        value = F.col(c).cast("double")
        fine = fine & value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    of = rows.select(*keys, F.col(item).alias("id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"), fine.alias("fine"))
    points = kept(of.where("fine").select(*keys, "id", "x"), "points")
    sizes = points.groupBy(*keys).agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > block).select(*keys)
    schema = f"{types(points, [*keys, 'id'])}, cluster int"

    def small(columns: dict[str, np.ndarray], starts: np.ndarray):
        x = np.column_stack([columns[c] for c in axes])
        ends = np.append(starts[1:], len(x))
        found = [numeric.density_clusters(x[a:b], least, 1, epsilon) for a, b in zip(starts, ends)]
        return np.repeat(np.arange(len(starts)), ends - starts), {"id": columns["id"], "cluster": np.concatenate(found).astype(np.int32)}

    axes = [f"x{k}" for k in range(len(columns))]
    few = sizes.where(F.col("n") < 2 * least).select(*keys)  # too few to part: noise
    some = points.join(few, keys, "left_anti").join(large, keys, "left_anti").select(*keys, "id", *[F.col("x")[k].alias(c) for k, c in enumerate(axes)])
    found = points.join(few, keys, "left_semi").select(*keys, "id", F.lit(-1).alias("cluster"))
    if some.take(1):
        found = found.unionByName(together(some, keys, ["id"], small, f"{types(points, ['id'])}, cluster int"))
    if large.take(1):
        big = kept(points.join(large, keys, "left_semi").withColumn("core", F.lit(0.0)), "points")
        tree = spanning_tree(big, keys, len(columns), block)
        ends = big.select(*keys, "id").withColumns({"distance": F.lit(None).cast("double"), "b": F.lit(None).cast("long")})
        nodes = ends.unionByName(tree.select(*keys, F.col("a").alias("id"), "distance", "b"))

        def condensed(pdf: pd.DataFrame) -> pd.DataFrame:
            ids = np.sort(pdf.loc[pdf["distance"].isna(), "id"].to_numpy(np.int64))
            edge = pdf.dropna(subset=["distance"])
            ends = np.searchsorted(ids, edge[["id", "b"]].to_numpy(np.int64))
            label = numeric.condensed_clusters(len(ids), np.column_stack([edge["distance"], ends]), least, epsilon)
            return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "id": ids, "cluster": label})

        found = found.unionByName(nodes.groupBy(*keys).applyInPandas(condensed, schema))
    odd = of.where("not fine").select(*keys, "id", F.lit(-1).alias("cluster"))
    return found.unionByName(odd).select(*keys, F.col("id").alias(item), "cluster")
