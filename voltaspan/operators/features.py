"""Features of segments: trimmed statistics, normalised values, look-back voltage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def segment_features(rows: DataFrame, keys: list[str], order: list[str], current: str, voltage: str, nominal: float, low: float, high: float) -> DataFrame:
    """One row per segment. Voltage statistics are over all rows, scaled to ``low`` .. ``high``;
    current statistics leave out the first two rows and the last, and are null where none is left.
    The extremes of the current are those of its size with the sign of its mean."""
    w = Window.partitionBy(*keys).orderBy(*order)
    n = F.count("*").over(Window.partitionBy(*keys))
    place = F.row_number().over(w)
    inner = F.when((place > 2) & (place < n), F.col(current))
    volts = (F.col(voltage) - low) / (high - low)
    ready = rows.select(*keys, "us", inner.alias("i"), volts.alias("v"))
    size = F.abs("i")
    sign = F.signum(F.avg("i"))
    stats = ready.groupBy(*keys).agg(
        F.avg("v").alias("voltage_mean"), F.stddev_samp("v").alias("voltage_std"), F.max("v").alias("voltage_max"), F.min("v").alias("voltage_min"), (F.max("v") - F.min("v")).alias("voltage_range"),
        (F.avg("i") / nominal).alias("current_mean"), (F.stddev_samp("i") / nominal).alias("current_std"), (sign * F.max(size) / nominal).alias("current_max"), (sign * F.min(size) / nominal).alias("current_min"),
        ((F.max(size) - F.min(size)) / nominal).alias("current_range"), ((F.max("us") - F.min("us")) / 60e6).alias("minutes"),
    )
    return stats.withColumns({"duration_log": F.log1p("minutes"), "abs_current_mean": F.abs("current_mean"), "norm_duration": F.abs("current_mean") * F.col("minutes") / 60})
