"""A parameter that many grouped fits have in common.

Each fit has parameters of its own and shares one with its group: a series resistance that all
pulses of a check-up see. No group is brought together. Each round, every fit is made on its own
with the group's present value and gives two numbers: the slope of its least squared residual in
the shared value, and the curvature that is left once its own parameters have given way (the
Schur complement of its normal equations). Spark adds these up by group, which gives a Newton step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltaspan.operators.groups import dealt
from voltaspan.sources.shared import dropped, kept

#: Value of the group, residuals' derivative by it, own parameters' Jacobian: what a fit returns.
Reduced = tuple[np.ndarray, np.ndarray, np.ndarray]


def reduced(residual: np.ndarray, by_shared: np.ndarray, by_own: np.ndarray) -> tuple[float, float, float]:
    """Slope, curvature and squares of a fit whose own parameters are at their best."""
    left = by_shared
    if by_own.shape[1]:
        left = by_shared - by_own @ np.linalg.lstsq(by_own, by_shared, rcond=None)[0]
    return float(left @ residual), float(left @ left), float(residual @ residual)


def shared_value(items: DataFrame, group: Sequence[str], start: DataFrame, fit: Callable[[dict, float, list[float] | None], tuple[Reduced, list[float]]], state: str = "own", rounds: int = 12, share: float = 1e-7, low: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """The value of each group (columns group, ``value``), and the items with their own parameters
    at that value (``state``, an array; ``value``, ``squares``).

    ``items`` has one row per fit with all that it needs; ``start`` has group and ``value``.
    ``fit(row, value, own)`` fits its own parameters from those of the round before (None at
    first) and returns residual, its derivatives by the shared value and by its own parameters, and
    these. A step that raises a group's squares is halved. The rounds end when no group moves by
    more than ``share`` of its value; the values stay ``low`` or more. Groups without an item have
    no value; items of a group without a start are left out.
    """
    columns = items.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields), f"`{state}` array<double>", "value double", "slope double", "curve double", "squares double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                own = row.pop(state, None)
                of, own = fit(row, row["value"], None if own is None else list(own))
                out.append((*(row[c] for c in columns), list(own), row["value"], *reduced(*of)))
            yield pd.DataFrame(out, columns=[*columns, state, "value", "slope", "curve", "squares"])

    values = start.select(*group, F.col("value").cast("double").alias("value"), F.lit(None).cast("double").alias("step"), F.lit(None).cast("double").alias("was"))
    now = items.withColumn(state, F.lit(None).cast("array<double>"))
    for _ in range(rounds):
        at = now.select(*columns, state).join(values.select(*group, "value"), list(group))
        found = kept(dealt(at, columns).mapInPandas(run, schema), "coupled-items")
        sums = found.groupBy(*group).agg(F.sum("slope").alias("slope"), F.sum("curve").alias("curve"), F.sum("squares").alias("squares"))
        both = sums.join(values, list(group))
        worse = F.coalesce(F.col("squares") > F.col("was") * (1 + 1e-12), F.lit(False))
        newton = F.coalesce(-F.try_divide("slope", "curve"), F.lit(0.0))
        step = F.when(worse, -F.col("step") / 2).otherwise(F.greatest(newton, F.lit(low) - F.col("value")))
        # after a step back the squares are those of the place before, which the next round finds again
        moved = both.select(*group, (F.col("value") + step).alias("value"), F.when(worse, -step).otherwise(step).alias("step"), F.when(worse, F.col("was")).otherwise(F.col("squares")).alias("was"))
        before, now, values = now, found, kept(moved, "coupled-values")
        if "value" in before.columns:  # a round's table, which nothing reads any more
            dropped(before)
        most = values.agg(F.max(F.abs("step") / F.greatest(F.abs("value"), F.lit(1e-12)))).first()[0]
        if most is None or most <= share:
            break
    return now.select(*group, "value").distinct(), now.drop("slope", "curve")
