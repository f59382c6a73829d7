"""Joins in time and in order: look-back, nearest, as-of, intervals, neighbours, brackets.

Spark has no as-of or range join of its own. Here both sides meet on an equality: the time slice
(and its neighbours, for a tolerance), or the union of both sides in one window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltaspan.operators import scan


def nearest(left: DataFrame, right: DataFrame, keys: list[str], time: str, right_time: str, tolerance: int, right_id: str) -> DataFrame:
    """Left rows with the nearest right row by time, either way, within the tolerance; of equal
    distances the earlier, then the smaller id. Rows without one are left out; repeated left rows stay.

    Right rows go to the slices of width ``tolerance`` beside their own, so the join is on key and
    slice and a candidate is at most three slices of right rows away.
    """
    at = left.withColumns({"_slice": F.floor(F.col(time) / tolerance), "_row": F.monotonically_increasing_id()})
    near = right.withColumn("_slice", F.explode(F.array(*[F.floor(F.col(right_time) / tolerance) + d for d in (-1, 0, 1)])))
    met = at.join(near, [*keys, "_slice"]).where(F.abs(F.col(time) - F.col(right_time)) <= tolerance)
    best = F.min_by(F.struct(right_time, right_id), F.struct(F.abs(F.col(time) - F.col(right_time)), right_time, right_id))
    found = met.groupBy("_row", *left.columns).agg(best.alias("_best"))
    return found.select(*left.columns, F.col(f"_best.{right_time}").alias(right_time), F.col(f"_best.{right_id}").alias(right_id))


def held(left: DataFrame, right: DataFrame, keys: list[str], order: str, value: str, width: float | None = scan.SLICE) -> DataFrame:
    """Left rows with the last right value at or before their place in order; null before any. Both
    sides meet in slices of the order."""
    both = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_side", F.lit(1)).unionByName(
        right.select(*keys, order, F.col(value).alias("_v")).withColumn("_side", F.lit(0)), allowMissingColumns=True
    )
    return scan.scanned(both, keys, [order, "_side"], {value: scan.Carry("last", F.col("_v"))}, width).where("_side = 1").drop("_v", "_side")


def within(rows: DataFrame, stubs: DataFrame, keys: list[str], time: str, begin: str, end: str, slice_width: int) -> DataFrame:
    """Rows inside the intervals of stubs, with the stubs' columns. Stubs go to every slice of time
    that they touch, and rows to their own."""
    spread = stubs.withColumn("_slice", F.explode(F.sequence(F.floor(F.col(begin) / slice_width), F.floor(F.col(end) / slice_width))))
    return rows.withColumn("_slice", F.floor(F.col(time) / slice_width)).join(spread, [*keys, "_slice"]).where(F.col(time).between(F.col(begin), F.col(end))).drop("_slice")


def look_back(rows: DataFrame, keys: list[str], order: str, value: str, usable: str, steps: int = 4) -> DataFrame:
    """Adds ``prev_<value>``: the last value of the up to ``steps`` numbers before a row's own for
    which ``usable`` holds; missing numbers are passed over."""
    w = Window.partitionBy(*keys).orderBy(order).rangeBetween(-steps, -1)
    return rows.withColumn(f"prev_{value}", F.last(F.when(F.expr(usable), F.col(value)), ignorenulls=True).over(w))


def beside(left: DataFrame, right: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Right rows whose number is one off that of some left row; 0, the discards, is no neighbour."""
    sides = left.select(*keys, F.explode(F.array(F.col(number) - 1, F.col(number) + 1)).alias(number)).where(F.col(number) != 0).distinct()
    return right.join(sides, [*keys, number], "left_semi")


def bracketed(points: DataFrame, knots: DataFrame, keys: list[str], at: str, value: str, width: float | None = None) -> DataFrame:
    """Points with ``value`` interpolated between the knots before and after them, clamped at the
    ends. With a ``width`` they meet in slices of it; without one, points and knots of a key (those
    of a sweep) meet in one task."""
    both = points.withColumn("_knot", F.lit(None).cast("struct<k:double,v:double>")).withColumn("_side", F.lit(1)).unionByName(
        knots.select(*keys, F.col(at), F.struct(F.col(at).cast("double").alias("k"), F.col(value).cast("double").alias("v")).alias("_knot")).withColumn("_side", F.lit(0)), allowMissingColumns=True
    )
    # a knot at a point's own place lies on both of its sides
    found = scan.scanned(both, keys, [at, "_side"], {"_k0": scan.Carry("last", F.col("_knot"))}, width)
    found = scan.scanned(found.withColumn("_turn", -F.col("_side")), keys, [at, "_turn"], {"_k1": scan.Carry("next", F.col("_knot"))}, width)
    share = F.try_divide(F.col(at) - F.col("_k0.k"), F.col("_k1.k") - F.col("_k0.k"))
    blend = F.when(F.col("_k1.k") > F.col("_k0.k"), F.col("_k0.v") + share * (F.col("_k1.v") - F.col("_k0.v")))
    return found.where("_side = 1").withColumn(value, F.coalesce(blend, "_k0.v", "_k1.v")).drop("_knot", "_side", "_turn", "_k0", "_k1")
