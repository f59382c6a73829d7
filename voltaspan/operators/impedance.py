"""Impedance spectra as tables: reduction, features without fits, roughness, agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reduced(rows: DataFrame, keys: list[str], frequency: str, magnitude: str, order: list[str], values: list[str]) -> DataFrame:
    """The last sample of each frequency, of rows with a positive frequency and magnitude."""
    fine = rows.where((F.col(frequency) > 0) & (F.col(magnitude) > 0))
    last = fine.groupBy(*keys, frequency).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_last"))
    return last.select(*keys, frequency, *[F.col(f"_last.{v}").alias(v) for v in values])


def fit_free(spectrum: DataFrame, keys: list[str], f: str, re: str, im: str) -> DataFrame:
    """From spectra by ascending frequency: the resistance and frequency where the imaginary part
    last changes sign (else where it is smallest), total and polarisation resistance, and the
    highest point of the arc."""
    w = Window.partitionBy(*keys).orderBy(f)
    nxt = F.lead(im).over(w)
    share = F.try_divide(im, F.col(im) - nxt)
    rows = spectrum.withColumn("_cross", F.col(im) * nxt < 0).withColumn("_re", F.col(re) + share * (F.lead(re).over(w) - F.col(re))).withColumn("_f", F.col(f) + share * (F.lead(f).over(w) - F.col(f)))
    crossing = F.when(F.col("_cross"), F.col(f))
    out = rows.groupBy(*keys).agg(
        F.max_by(F.when(F.col("_cross"), F.col("_re")), crossing).alias("_r"), F.max_by(F.when(F.col("_cross"), F.col("_f")), crossing).alias("_fc"), F.min_by(re, F.struct(F.abs(im), f)).alias("_r0"), F.min_by(f, F.struct(F.abs(im), f)).alias("_f0"),
        F.min_by(re, f).alias("r_tot"), F.min(im).alias("arc_peak"), F.min_by(f, F.struct(im, f)).alias("f_peak"), F.count("*").alias("n"),
    )
    return out.select(*keys, "n", F.coalesce("_r", "_r0").alias("r_cross"), F.coalesce("_fc", "_f0").alias("f_cross"), "r_tot", (F.col("r_tot") - F.coalesce("_r", "_r0")).alias("r_pol"), "arc_peak", "f_peak")


def roughness(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Mean step between neighbours over the median size, per group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    steps = rows.withColumn("_d", F.abs(F.col(value) - F.lag(value).over(w)))
    return steps.groupBy(*keys).agg(F.try_divide(F.avg("_d"), F.nullif(F.percentile(F.abs(value), F.lit(0.5)), F.lit(0.0))).alias("roughness"))
