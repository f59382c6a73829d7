"""Exact medians of keys of any size.

Equal values of a key are counted first, where they lie. Counts by range of values tell which range
holds the middle; only the values of that range are put in order. So neither a key's rows nor its
distinct values meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges for each doubling of a value: each is about 1 % wide.
RANGES = 64


def _range(value: Column) -> Column:
    """The number of a value's range, ascending with the value."""
    return F.floor(F.signum(value.cast("double")) * F.floor(F.log2(F.abs(value.cast("double")) + 1) * RANGES)).cast("long")


def medians(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows keys, ``n``, ``median`` (the mean of the middle two where there are two). Values are whole
    numbers or doubles; nulls aren't counted, and a key without a value has no row."""
    keys = list(keys)
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    ranged = counted.withColumn("_r", _range(F.col("_v")))
    by_range = ranged.groupBy(*keys, "_r").agg(F.sum("_n").alias("_n"))
    w, whole = Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    placed = by_range.withColumns({"_to": F.sum("_n").over(w), "n": F.sum("_n").over(whole)}).withColumn("_from", F.col("_to") - F.col("_n"))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)  # places of the middle, from 0
    middle = placed.where(((F.col("_from") <= low) & (low < F.col("_to"))) | ((F.col("_from") <= high) & (high < F.col("_to")))).select(*keys, "_r", "n", "_from")
    same = [F.col(f"_a.{k}").eqNullSafe(F.col(f"_b.{k}")) for k in keys]
    near = ranged.alias("_a").join(middle.alias("_b"), [*same, F.col("_a._r") == F.col("_b._r")]).select(*[F.col(f"_a.{k}").alias(k) for k in keys], "_v", "_n", "n", F.col("_b._r").alias("_r"), "_from")
    up = Window.partitionBy(*keys, "_r").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("_to", F.col("_from") + F.sum("_n").over(up)).withColumn("_at", F.col("_to") - F.col("_n"))
    of = lambda place: F.max(F.when((F.col("_at") <= place) & (place < F.col("_to")), F.col("_v").cast("double")))
    return near.groupBy(*keys).agg(F.first("n").alias("n"), ((of(low) + of(high)) / 2).alias("median"))
