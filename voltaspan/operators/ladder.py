"""State-of-charge ladders: blocks of impedance segments and the charge steps between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltaspan.operators import scan


def plateaus(rows: DataFrame, keys: list[str], order: list[str], program: str, number: str, ah: str, gap: float, width: float = scan.SLICE) -> DataFrame:
    """Adds ``plateau`` (from 0): a new one where the program changes, the number jumps by more
    than one, or the charge by more than ``gap``."""
    def jump(now: Column, was: Column) -> Column:
        return F.coalesce((now["p"] != was["p"]) | (F.abs(now["n"] - was["n"]) > 1) | (F.abs(now["a"] - was["a"]) > gap), F.lit(False))

    return scan.numbered(rows, keys, order, {"p": F.col(program), "n": F.col(number), "a": F.col(ah)}, jump, "plateau", width=width)


def blocks(segments: DataFrame, keys: list[str], order: str, target: str, step: str, wanted: str = "EIS", passed: str = "PAU", width: float = 65_536) -> DataFrame:
    """Runs of ``wanted`` segments: first and last number, segments, the charge of the nearest
    segment before that is neither a pause nor wanted, and how many pauses lie before the block.
    Slices have ``width`` numbers."""
    hit = F.col(target) == wanted
    new = lambda now, was: (now["t"] == wanted) & F.coalesce(was["t"] != wanted, F.lit(True))
    carries = {"_step": scan.Carry("last", F.when(~F.col(target).isin(wanted, passed), F.col(step))), "_pauses": scan.Carry("sum", (F.col(target) == passed).cast("long"))}
    # a wanted segment is itself neither a step nor a pause
    rows = scan.numbered(segments, keys, [order], {"t": F.col(target)}, new, "block", carries=carries, width=width).where(hit)
    return rows.groupBy(*keys, "block").agg(
        F.min(order).alias("first_proc"), F.max(order).alias("last_proc"), F.count("*").alias("n"), F.min_by("_step", order).alias("step"), F.coalesce(F.min("_pauses"), F.lit(0)).alias("pauses_before")
    )


def block_soc(found: DataFrame, keys: list[str], capacity: float, anchor: float) -> DataFrame:
    """Adds ``soc``: the anchor and the summed steps after the first block, in per cent of the
    capacity; null with fewer than two blocks or a step that is missing."""
    w = Window.partitionBy(*keys).orderBy("block")
    whole = Window.partitionBy(*keys)
    first = F.row_number().over(w) == 1
    later = F.when(first, 0.0).otherwise(F.col("step"))
    rows = found.withColumn("_later", later)
    fine = (F.count("*").over(whole) >= 2) & (F.count("_later").over(whole) == F.count("*").over(whole))
    soc = anchor + 100 * F.sum("_later").over(w.rowsBetween(Window.unboundedPreceding, 0)) / capacity
    return rows.withColumn("soc", F.when(fine, soc)).drop("_later")
