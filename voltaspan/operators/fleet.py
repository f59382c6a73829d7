"""Fleet reports: check-ups, state of health, aging matrix, status of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def soh(capacity: Column, nominal: float) -> Column:
    """State of health in per cent, one decimal, halves away from zero by the double itself; null for
    a missing capacity."""
    return F.round(capacity / nominal * 100 * 10.0) / 10.0


def cell_table(checkups: DataFrame, name: str, order: list[str], firsts: list[str], capacity: str, ah: str) -> DataFrame:
    """One row per cell: its first conditions, number of check-ups, loss of capacity, throughput."""
    at = F.struct(*order)
    return checkups.groupBy(name).agg(
        *[F.min_by(c, at).alias(c) for c in firsts], F.count(capacity).alias("n_cu"), (F.max(capacity) - F.min(capacity)).alias("loss"), (F.max(ah) - F.min(ah)).alias("delta_ah")
    )


def aging_matrix(cells: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Cells by condition, nulls a group of their own: number, names, mean and spread of loss and
    throughput, and their ratio, null where the throughput is 0."""
    names = F.array_join(F.transform(F.sort_array(F.collect_list(name)), lambda x: x.cast("string")), "; ")  # bounded by a condition's cells
    out = cells.groupBy(*keys).agg(F.count("*").alias("n"), names.alias("names"), F.avg("loss").alias("loss_mean"), F.stddev_samp("loss").alias("loss_std"), F.avg("delta_ah").alias("ah_mean"), F.stddev_samp("delta_ah").alias("ah_std"))
    return out.withColumn("ratio", F.try_divide("loss_mean", F.nullif("ah_mean", F.lit(0.0))))


def recent_slope(rows: DataFrame, key: str, order: list[str], value: str, n: int = 5) -> DataFrame:
    """Per key the number of rows, the last value, and the least-squares slope of the last ``n``
    against 0, 1, ..; null with fewer than two."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order]))
    some = rows.withColumn("_back", back)
    recent = F.when(F.col("_back") <= n, F.col(value))
    step = F.when(F.col("_back") <= n, -F.col("_back").cast("double"))
    slope = F.when(F.count(recent) >= 2, F.regr_slope(recent, step))
    return some.groupBy(key).agg(F.count("*").alias("n_cu"), F.max(F.when(F.col("_back") == 1, F.col(value))).alias("latest"), slope.alias("slope"))


def status(last_seen: DataFrame, key: str, time: str, now: Column, days: int, finished: Column) -> DataFrame:
    """unfinished, running (seen within ``days``) or finished, and a rank for reports."""
    fresh = (now - F.col(time)) <= days * 86_400_000_000
    state = F.when(~finished & ~fresh, "unfinished").when(fresh, "running").otherwise("finished")
    return last_seen.withColumn("status", state).withColumn("rank", F.when(F.col("status") == "unfinished", 0).when(F.col("status") == "running", 1).otherwise(2))
