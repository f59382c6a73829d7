"""Outliers by a forest of random splits: what few splits set apart is odd.

Every tree sees a small sample of the rows, drawn by hash, and is grown in a task of its own. The
forest then is one row of arrays, bounded by its parameters, and rows find their way down all trees
a batch at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from voltaspan.operators.models import complete
from voltaspan.sources.shared import kept

EULER = 0.5772156649015329


def usual_path(n: float) -> float:
    """Splits that an unsuccessful search in a random tree of n rows needs on average."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + EULER) - 2 * (n - 1) / n


def _grown(x: np.ndarray, depth: int, rng: np.random.Generator) -> list[tuple[int, float, float]]:
    """Feature (-1 at a leaf), split and path length of each node; the children of node i (from 1)
    are 2 i and 2 i + 1."""
    nodes = [(-1, 0.0, 0.0)] * 2 ** (depth + 1)
    open_nodes = [(1, 0, x)]
    while open_nodes:
        node, level, of = open_nodes.pop()
        low, high = (of.min(axis=0), of.max(axis=0)) if len(of) else (np.zeros(x.shape[1]),) * 2
        varied = np.flatnonzero(high > low)
        if level == depth or len(of) < 2 or not len(varied):
            nodes[node] = -1, 0.0, level + usual_path(len(of))
            continue
        feature = int(rng.choice(varied))
        split = float(rng.uniform(low[feature], high[feature]))
        split = split if split > low[feature] else float(high[feature])  # neither side is empty
        right = of[:, feature] >= split
        nodes[node] = feature, split, 0.0
        open_nodes += [(2 * node, level + 1, of[~right]), (2 * node + 1, level + 1, of[right])]
    return nodes


def isolation_forest(rows: DataFrame, item: str, features: Sequence[str], trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """One row: ``trees``, an array of trees, each an array of nodes (feature, split, path), and
    ``usual``, the path length that scores are measured by. Rows are known by ``item``, so the same
    rows give the same forest however they are dealt out. Rows that lack a feature teach nothing.
    """
    ready = rows.where(complete(features)).select(F.col(item).cast("string").alias("item"), F.array(*[F.col(c).cast("double") for c in features]).alias("x"))
    n = ready.count()
    size, share = min(sample, max(n, 1)), min(1.0, (2 * sample + 64) / max(n, 1))
    depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
    draw = lambda tree: F.pmod(F.xxhash64("item", tree, F.lit(seed)), F.lit(2**31)) / float(2**31)
    taken = ready.withColumn("tree", F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda tree: draw(tree) < share))).withColumn("draw", draw(F.col("tree")))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = np.array(pdf.sort_values(["draw", "item"])["x"].head(size).tolist(), float)
        feature, split, path = zip(*_grown(x, depth, np.random.default_rng([seed, tree])))
        return pd.DataFrame({"tree": [tree], "feature": [list(feature)], "split": [list(split)], "path": [list(path)]})

    grown = taken.groupBy("tree").applyInPandas(grow, "tree int, feature array<int>, split array<double>, path array<double>")
    forest = grown.agg(F.sort_array(F.collect_list(F.struct("tree", "feature", "split", "path"))).alias("trees"))  # of ``trees`` rows
    return forest.withColumns({"usual": F.lit(float(usual_path(size))), "depth": F.lit(depth)})


def mean_path(forest: Row) -> Callable[[Column], Column]:
    """Of an array of features the mean path length in a forest: all rows of a batch go down all its
    trees at once. The forest goes to the tasks as it is, bounded by its parameters."""
    feature, split, path = (np.array([tree[c] for tree in forest["trees"]]) for c in ("feature", "split", "path"))
    depth, of = forest["depth"], np.arange(len(feature))

    @F.pandas_udf("double")
    def mean(x: pd.Series) -> pd.Series:
        out = np.full(len(x), np.nan)
        there = np.flatnonzero(x.notna())
        for some in np.array_split(there, max(1, len(there) // 2000)):
            rows = np.array([x.iat[k] for k in some], float).reshape(len(some), -1)
            node = np.ones((len(some), len(of)), int)
            for _ in range(depth):
                at = feature[of, node]
                value = rows[np.arange(len(some))[:, None], np.maximum(at, 0)]
                right = (value >= split[of, node]) | np.isnan(value)  # not a number is above all numbers
                node = np.where(at < 0, node, 2 * node + right)
            out[some] = sum((path[k, node[:, k]] for k in of), np.zeros(len(some))) / len(of)
        return pd.Series(out)

    return mean


def outliers(rows: DataFrame, normal: DataFrame, item: str, features: Sequence[str], contamination: float | None = 0.006, trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """Rows with ``score`` and ``outlier``, by a forest of the normal rows. Outliers score more than
    all but a share (``contamination``) of the normal rows do; without one, more than a half. Rows
    that lack a feature have neither; without normal rows none is an outlier."""
    forest = kept(isolation_forest(normal, item, features, trees, sample, seed), "forest")
    grown = forest.first()
    x = F.array(*[F.col(c).cast("double") for c in features])
    there = complete(features) if grown["trees"] else F.lit(False)
    length = mean_path(grown)(F.when(there, x)) if grown["trees"] else F.lit(None).cast("double")

    def scored(df: DataFrame) -> DataFrame:
        found = df.withColumn("_length", length)
        score = F.pow(F.lit(2.0), -F.col("_length") / grown["usual"]) if grown["usual"] > 0 else F.lit(0.5)
        return found.withColumn("score", F.when(there, score)).drop("_length")

    if contamination is None:
        limit = 0.5
    else:
        found = scored(normal).agg(F.percentile_approx("score", 1 - contamination, 100_000)).first()[0]
        limit = float("inf") if found is None else found
    return scored(rows).withColumn("outlier", F.col("score") > limit)
