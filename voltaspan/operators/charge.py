"""Charge by integration of current over time: gap-masked, running, per file and per segment.

Samples have a key (the cell), a time in microseconds and a current. Rows of one cell may be any
number, so nothing here puts a whole cell into one task: ``with_previous`` looks back within time
slices and takes what lies before a slice from a table with one row per slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltaspan.operators.median import medians

#: Microseconds in a slice of time: 90 days.
SLICE = 90 * 86_400_000_000
HOUR = 3_600_000_000.0


def with_previous(df: DataFrame, keys: list[str], time: str, tie: str, columns: list[str], width: int = SLICE) -> DataFrame:
    """``df`` with ``prev_<c>`` for each column: its value in the row before by time, then ``tie``.

    Rows are dealt by key and slice of time, so a long series of one key is shared by many tasks.
    The first row of a slice takes what the last one of the slices before it has.
    """
    sliced = df.withColumn("_slice", F.floor(F.col(time) / F.lit(width)))
    order = Window.partitionBy(*keys, "_slice").orderBy(time, tie)
    last = F.max_by(F.struct(*columns), F.struct(time, tie))
    ends = sliced.groupBy(*keys, "_slice").agg(last.alias("_end"))
    before = ends.select(*keys, "_slice", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_slice")).alias("_before"))
    inner = sliced.withColumn("_prev", F.lag(F.struct(*columns)).over(order))
    joined = inner.join(before, [*keys, "_slice"])
    found = F.coalesce("_prev", "_before")
    return joined.select(*df.columns, "_slice", *[found[c].alias(f"prev_{c}") for c in columns])


def contributions(df: DataFrame, keys: list[str], time: str, tie: str, current: str, factor: float = 50.0, cut: float | None = None) -> DataFrame:
    """Adds ``contrib``, the Ah since the row before by the trapezoid over |current|: 0 in a key's
    first row, where a current is null, and across gaps. A gap is longer than ``cut``, or than
    ``factor`` times the median interval of the key, which needs two intervals and a positive one.
    """
    rows = with_previous(df, keys, time, tie, [time, current])
    rows = rows.withColumn("dt", F.col(time) - F.col(f"prev_{time}"))
    if cut is None:
        middle = medians(rows, keys, "dt").select(*keys, F.when((F.col("n") >= 2) & (F.col("median") > 0), factor * F.col("median")).alias("cut"))
        rows = rows.join(middle, keys, "left")
    else:
        rows = rows.withColumn("cut", F.lit(float(cut)))
    half = (F.abs(F.col(current)) + F.abs(F.col(f"prev_{current}"))) / 2 * F.col("dt") / F.lit(HOUR)
    return rows.withColumn("contrib", F.when(F.col("dt") > F.col("cut"), 0.0).otherwise(F.coalesce(F.nanvl(half, F.lit(0.0)), F.lit(0.0))))


def totals(contributed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: rows, cut, Ah."""
    return contributed.groupBy(*keys).agg(F.count("*").alias("n"), F.max("cut").alias("cut_us"), F.sum("contrib").alias("ah"))


def running(contributed: DataFrame, keys: list[str], time: str, tie: str, offset: Column | None = None) -> DataFrame:
    """Adds ``ah``, the sum of contributions up to each row, from ``offset``. The sum of the slices
    before comes from one row per slice."""
    by_slice = contributed.groupBy(*keys, "_slice").agg(F.sum("contrib").alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = by_slice.select(*keys, "_slice", F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)).alias("_earlier"))
    within = F.sum("contrib").over(Window.partitionBy(*keys, "_slice").orderBy(time, tie).rowsBetween(Window.unboundedPreceding, 0))
    start = F.lit(0.0) if offset is None else offset
    return contributed.withColumn("_within", within).join(before, [*keys, "_slice"]).withColumn("ah", start + F.col("_earlier") + F.col("_within")).drop("_within", "_earlier")


def watermark(rows: DataFrame, keys: list[str], time: str, tie: str, columns: list[str]) -> DataFrame:
    """The last state of a series: what an incremental build goes on from."""
    return rows.groupBy(*keys).agg(*[F.max_by(c, F.struct(time, tie)).alias(c) for c in columns], F.max(time).alias(f"last_{time}"))


def merged_files(df: DataFrame, key: str, file: str, time: str, tie: str, current: str, factor: float) -> DataFrame:
    """Each file integrated by itself, then rows of one time merged: its last current, the sum of
    its contributions. Parallel recordings so don't count the gaps between each other's samples."""
    once = df.groupBy(key, file, time).agg(F.max_by(F.struct(current, tie), tie).alias("_last"))
    once = once.select(key, file, time, F.col(f"_last.{current}").alias(current), F.col(f"_last.{tie}").alias(tie))
    parts = contributions(once, [key, file], time, tie, current, factor)
    return parts.groupBy(key, time).agg(F.max_by(current, tie).alias(current), F.max(tie).alias(tie), F.sum("contrib").alias("contrib"))


def concurrent(df: DataFrame, key: str, file: str, time: str, current: str, live: float = 0.01) -> DataFrame:
    """Files with current whose start lies before the end of the live file before them."""
    spans = df.groupBy(key, file).agg(F.min(time).alias("begin"), F.max(time).alias("finish"), F.max(F.abs(current)).alias("peak")).where(F.col("peak") > live)
    before = Window.partitionBy(key).orderBy("begin", file)
    return spans.withColumn("prev_finish", F.lag("finish").over(before)).where("begin < prev_finish")


def segment_capacity(df: DataFrame, keys: list[str], time: str, tie: str, current: str) -> DataFrame:
    """Ah of each segment by the trapezoid over |current| without a gap mask, and its seconds."""
    order = Window.partitionBy(*keys).orderBy(time, tie)
    dt = F.col(time) - F.lag(time).over(order)
    half = (F.abs(F.col(current)) + F.abs(F.lag(current).over(order))) / 2 * dt / F.lit(HOUR)
    rows = df.withColumn("_half", half)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.sum("_half"), F.lit(0.0)).alias("capacity"), ((F.max(time) - F.min(time)) / 1e6).alias("seconds"))
