"""Segmentation of a recording into runs, procedures and targets, by window functions.

Stages follow one another on the partition (cell, program), so one exchange serves them all. A
program is one test and bounds what a task holds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltaspan.operators import scan

PAUSES = ("PAU", "PAUO", "...")


@dataclass(frozen=True)
class Limits:
    """Minutes from which a pause ends a procedure, and rows that a procedure must have."""

    pause_minutes: float = 9.9
    min_rows: int = 20
    qocv: tuple[str, ...] = ("qOCV",)


def changed(column: str, order) -> Column:
    """Whether a value differs from the row before; a null is a boundary on either side."""
    before = F.lag(column).over(order)
    return F.coalesce(F.col(column) != before, F.lit(True))


def runs(df: DataFrame, keys: list[str], order_by: list[str], column: str, name: str = "run") -> DataFrame:
    """Adds the number of the run of equal values that a row is in, from 1."""
    order = Window.partitionBy(*keys).orderBy(*order_by)
    marked = df.withColumn("_new", changed(column, order).cast("int"))
    return marked.withColumn(name, F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def run_table(df: DataFrame, keys: list[str], order_by: list[str], column: str, time: str) -> DataFrame:
    """One row per run: its value, rows, first and last time, minutes. Runs are numbered over slices
    of the order's first column, so a key may have any number of rows."""
    new = lambda now, was: F.coalesce(now["v"] != was["v"], F.lit(True))
    return scan.numbered(df, keys, order_by, {"v": F.col(column)}, new, "run").groupBy(*keys, "run").agg(
        F.min_by(column, F.struct(*order_by)).alias("state"), F.count("*").alias("n"), F.min(time).alias("first_us"), F.max(time).alias("last_us"), ((F.max(time) - F.min(time)) / 60e6).alias("minutes")
    )


def program_index(df: DataFrame, key: str, column: str) -> DataFrame:
    """One row per program: its cell, itself, and ``bm``, its dense index within the cell, from 0."""
    return df.select(key, column).distinct().withColumn("bm", F.dense_rank().over(Window.partitionBy(key).orderBy(column)) - 1)


def programs(df: DataFrame, key: str, column: str) -> DataFrame:
    """Adds ``bm``, the index of the program within its cell. Programs are ranked in a table with
    one row each."""
    return df.join(program_index(df, key, column), [key, column])


def procedures(df: DataFrame, cell: str = "cell", bm: str = "bm", time: str = "us", tie: str = "seq", state: str = "state", procedure: str = "procedure", limits: Limits = Limits()) -> DataFrame:
    """Adds proc, target and pre_target to the samples of programs that are kept.

    Programs of one or two rows stay as AGING, others with fewer than ``min_rows`` rows or with
    pauses alone go. A procedure begins at a long pause, after one, where its name changes, and at
    each run of a quasi-OCV procedure. Of a long pause the first and last row stay, all other pause
    rows go to procedure 0, as do procedures that are too short. Targets are EIS, PAU and AGING,
    the later overriding the earlier, else -1.
    """
    keys = [cell, bm]
    whole, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(time, tie)
    pause = F.col(state).isin(*PAUSES)
    rows = df.withColumn("_n", F.count("*").over(whole)).withColumn("_all_pause", F.min(pause.cast("int")).over(whole) == 1)
    small = F.col("_n") <= 2
    rows = rows.where(small | (F.col("_n") >= limits.min_rows) & ~F.col("_all_pause"))
    rows = runs(rows, keys, [time, tie], state)
    of_run = Window.partitionBy(*keys, "run")
    rows = rows.withColumn("_minutes", (F.max(time).over(of_run) - F.min(time).over(of_run)) / 60e6)
    active = F.max(F.col(state).isin("CHA", "DCH").cast("int")).over(Window.partitionBy(*keys, procedure))
    eis = pause & F.coalesce(F.col(procedure).contains("_EIS_"), F.lit(False)) & (active == 0)
    rows = rows.withColumn("_state", F.when(eis, "EIS").otherwise(F.col(state)))
    pause = F.col("_state").isin(*PAUSES)
    new = F.coalesce(F.col("run") != F.lag("run").over(order), F.lit(True))
    long = pause & (F.col("_minutes") > limits.pause_minutes)
    after = new & F.coalesce(F.lag(long).over(order), F.lit(False))
    named = changed(procedure, order)
    qocv = F.lit(False)
    for token in limits.qocv:
        qocv = qocv | F.coalesce(F.col(procedure).contains(token), F.lit(False))
    rows = rows.withColumn("_long", long).withColumn("_edge", (long & new | after | named | qocv & new).cast("int"))
    rows = rows.withColumn("proc", F.sum("_edge").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first, last = F.row_number().over(of_run.orderBy(time, tie)), F.row_number().over(of_run.orderBy(F.col(time).desc(), F.col(tie).desc()))
    rows = rows.withColumn("_stub", (first == 1) | (last == 1))
    rows = rows.withColumn("proc", F.when(small | F.col("_state").isin(*PAUSES) & (~F.col("_long") | ~F.col("_stub")), 0).otherwise(F.col("proc")))
    of_proc = Window.partitionBy(*keys, "proc")
    only_pause, only_eis = F.min(F.col("_state").isin(*PAUSES).cast("int")).over(of_proc) == 1, F.min((F.col("_state") == "EIS").cast("int")).over(of_proc) == 1
    any_eis = F.max((F.col("_state") == "EIS").cast("int")).over(of_proc) == 1
    rows = rows.withColumn("pre_target", F.when(small, "AGING").when(only_pause, "PAU").when(only_eis, "EIS"))
    rows = rows.withColumn("_short", (F.count("*").over(of_proc) < limits.min_rows) & ~only_pause & ~any_eis & ~small)
    rows = rows.withColumn("proc", F.when(F.col("_short"), 0).otherwise(F.col("proc")))
    of_id = Window.partitionBy(*keys, "proc")
    had = lambda name: F.max((F.col("pre_target") == name).cast("int")).over(of_id) == 1
    null_name = F.max(F.col(procedure).isNull().cast("int")).over(of_id) == 1
    rows = rows.withColumn("target", F.when(had("AGING"), "AGING").when(had("PAU"), "PAU").when(had("EIS"), "EIS").when(null_name, "EIS").otherwise("-1"))
    return rows.select(*df.columns, "run", F.col("_state").alias("relabelled"), "proc", "pre_target", "target")


def segment_table(segmented: DataFrame, cell: str = "cell", bm: str = "bm", time: str = "us") -> DataFrame:
    """One row per procedure: rows, target, minutes."""
    return segmented.groupBy(cell, bm, "proc").agg(F.count("*").alias("n"), F.max("target").alias("target"), ((F.max(time) - F.min(time)) / 60e6).alias("minutes"))


def cycles(df: DataFrame, keys: list[str], time: str, tie: str, gap: float) -> DataFrame:
    """Adds ``cycle`` (from 1), a new one after each gap, and ``since``, the time in it."""
    new = lambda now, was: F.coalesce(now["t"] - was["t"] > gap, F.lit(True))
    begun = scan.numbered(df, keys, [time, tie], {"t": F.col(time)}, new, "cycle", {"_begin": F.col(time)})
    return begun.withColumn("since", F.col(time) - F.col("_begin")).drop("_begin")
