"""Connected components of an edge table, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltaspan.llm.common import released, written


def _stars(edges: DataFrame, small: bool) -> tuple[DataFrame, DataFrame]:
    """One round. Each node hands its least neighbour to its larger neighbours (large star) or to
    its smaller ones and itself (small star). Least ones come from a partial aggregation and a
    join that Spark can split, so no node's neighbours meet in one task."""
    if small:  # edges point from the larger to the smaller end
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    joined = both.join(least, "u")
    if small:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u != v").distinct(), least


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """Rows node, component (its least node) for all nodes of edges ``u, v`` (long).

    Every round is written to the shared folder, so a lost executor costs one round. Nulls are no
    nodes; an edge of a node with itself, and repeated edges, change nothing. ``rounds`` bounds
    the loop, which needs about the logarithm of the longest path; beyond it an error is raised.
    """
    edges = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u is not null and v is not null and u != v")
    state = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        row = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"), F.count_distinct("u").alias("nodes")).first()
        now = (row["n"], row["h"])
        roots = state.select(F.col("v").alias("u")).distinct().join(state.select("u").distinct(), "u", "left_semi").limit(1).count()
        if now == seen or row["n"] == 0 or (roots == 0 and row["nodes"] == row["n"]):
            leaves = state.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return leaves.unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = now
        large, of_large = _stars(state, small=False)
        small, of_small = _stars(large, small=True)
        before, state = state, written(small, "edges")
        released(before, of_large, of_small)
    raise RuntimeError(f"no end after {rounds} rounds")
