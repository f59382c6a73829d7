"""What clusters of segments are: their means, and rules that tell capacity tests, pulses and slow
sweeps among them. Tables of clusters have one row per cluster of a cell; -1 is noise."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltaspan.operators import density
from voltaspan.operators.rules import near_any, power_rate_near, rate_near


@dataclass(frozen=True)
class Protocol:
    """Rates (of the nominal capacity) and seconds that a test protocol uses."""

    cap_rate: float = 0.5
    qocv_rate: float = 0.05
    pulse_seconds: float = 20.0
    pulse_tolerance: float = 3.0
    qocv_tolerance: float = 1.2


def cluster_means(segments: DataFrame, keys: Sequence[str], cluster: str, columns: Sequence[str]) -> DataFrame:
    """Size, mean and spread of every cluster."""
    stats = [f(c).alias(f"{c}{tail}") for c in columns for f, tail in ((F.avg, "_mean"), (F.stddev_samp, "_std"))]
    return segments.groupBy(*keys, cluster).agg(F.count("*").alias("n"), *stats)


def _nearest(rows: DataFrame, keys: Sequence[str], distance, name: str = "_near") -> DataFrame:
    """Marks, among the rows whose distance isn't null, the one of the least for each key."""
    w = Window.partitionBy(*keys).orderBy(distance.asc_nulls_last(), "cluster")
    return rows.withColumn(name, (F.row_number().over(w) == 1) & distance.isNotNull())


def capacity_first(means: DataFrame, keys: Sequence[str], rate: float) -> DataFrame:
    """Of a first layer (columns cluster, current_mean, current_std, voltage_min, minutes,
    abs_current): adds ``cap``, and ``again`` where a second layer is needed.

    Clusters of steady discharge at the rate, down to the lower end and for about the time that a
    whole capacity takes, are the capacity tests. Where a cell has none, the one of a lasting near
    that time whose current is nearest goes on to a second layer. A cell without either has neither.
    """
    whole = 60 / rate
    size = F.abs("current_mean")
    clean = (F.abs("current_std") < 0.001) & (size > 0.9 * rate) & (size < 1.1 * rate) & (F.col("current_mean") < 0) & (F.abs("voltage_min") < 0.005) & (F.col("minutes") > 0.8 * whole) & (F.col("minutes") < 1.2 * whole)
    rows = means.withColumn("_clean", F.coalesce(clean, F.lit(False)))
    loose = (F.col("cluster") >= 0) & (F.col("minutes") > 0.7 * whole) & (F.col("minutes") < 1.3 * whole)
    rows = _nearest(rows, keys, F.when(loose, F.abs(F.col("abs_current") - rate)))
    none = F.max(F.col("_clean").cast("int")).over(Window.partitionBy(*keys)) == 0
    again = none & F.col("_near")
    return rows.withColumns({"cap": F.col("_clean") | again, "again": again}).drop("_clean", "_near")


def capacity_second(means: DataFrame, keys: Sequence[str], rate: float, programs: int, buffer: int = 3) -> DataFrame:
    """Of a second layer (columns cluster, n, current_mean): adds ``cap``, for the cluster of
    discharge within 5 % of the rate that is nearest to it, and ``merged`` where that has more
    segments than there are programs, and some."""
    size = F.abs("current_mean")
    fits = (F.col("cluster") >= 0) & (F.col("current_mean") < 0) & (size > 0.95 * rate) & (size < 1.05 * rate)
    rows = _nearest(means, keys, F.when(fits, F.abs(size - rate)), "cap")
    return rows.withColumn("merged", F.col("cap") & (F.col("n") > programs + buffer))


def pulse_clusters(means: DataFrame, protocol: Protocol) -> DataFrame:
    """Adds ``pulse``: clusters that last but a few pulses' time."""
    limit = protocol.pulse_seconds / 60 * protocol.pulse_tolerance
    return means.withColumn("pulse", F.coalesce((F.col("cluster") >= 0) & (F.col("minutes") < limit), F.lit(False)))


def qocv_clusters(means: DataFrame, keys: Sequence[str], protocol: Protocol) -> DataFrame:
    """Adds ``qocv``: the cluster whose lasting is nearest to that of a slow sweep, and not far over it."""
    whole = 60 / protocol.qocv_rate
    fits = (F.col("cluster") >= 0) & (F.col("minutes") <= whole * protocol.qocv_tolerance)
    return _nearest(means, keys, F.when(fits, F.abs(F.col("minutes") - whole)), "qocv")


def labelled(segments: DataFrame, flags: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Segments with ``target`` by what their cluster is: CAP*, else PUL*, else QOCV*; -1 where none."""
    of = flags.select(*keys, "cluster", "cap", "pulse", "qocv")
    target = F.when(F.col("cap"), "CAP*").when(F.col("pulse"), "PUL*").when(F.col("qocv"), "QOCV*").otherwise("-1")
    return segments.join(of, [*keys, "cluster"], "left").withColumn("target", target).drop("cap", "pulse", "qocv")


def filtered(
    rows: DataFrame, cell: str = "cell", program: str = "bm", order: str = "proc", targets: Sequence[float] = (25.0,), rate: float = 0.5, power: bool = False, nominal_voltage: float = 3.6, pulse_in_program: bool = False, top: float = 0.95, steps: int = 4
) -> DataFrame:
    """Labels CAP* that don't stand the tests become -1: the temperature must be near a target, the
    rate near the capacity's, a pulse in the same program (where capacity tests and cycles may have
    merged), and the last segment with current before it, up to ``steps`` back, must have ended
    near the top."""
    w = Window.partitionBy(cell, program).orderBy(order).rangeBetween(-steps, -1)
    before = F.last(F.when(F.col("state") != "PAU", F.col("end_voltage")), ignorenulls=True).over(w)
    fine = near_any(F.col("temperature"), targets, 3.0) & (power_rate_near(F.abs("power"), rate, nominal_voltage) if power else rate_near(F.abs("current_mean"), rate))
    fine = fine & F.coalesce(before >= top, F.lit(True))
    if pulse_in_program:
        fine = fine & (F.max((F.col("target") == "PUL*").cast("int")).over(Window.partitionBy(cell, program)) == 1)
    return rows.withColumn("target", F.when((F.col("target") == "CAP*") & ~F.coalesce(fine, F.lit(False)), "-1").otherwise(F.col("target")))


@dataclass(frozen=True)
class Layer:
    """Least size of a cluster, and the distance below which clusters don't part."""

    least: int = 5
    epsilon: float = 0.0


def two_layers(
    segments: DataFrame, keys: Sequence[str], item: str, programs: int, protocol: Protocol, first: Layer = Layer(), second: Layer = Layer(), duration: str = "duration", buffer: int = 3
) -> DataFrame:
    """Segments (columns item, duration, minutes, current_mean, abs_current, current_std,
    voltage_min) with ``cluster``, ``cluster_id`` and ``target``, all of them.

    Clusters by duration and size of the current; where no cluster of a key is clearly its capacity
    tests, the segments of the likeliest one are clustered again, by current alone, and of those
    the nearest to the rate are the tests (``cap_layer_<k>``). Short clusters are pulses, the one
    that lasts like a slow sweep is that; what is none of these keeps its cluster's number.
    """
    keys = list(keys)
    rows = segments.join(density.density_clusters(segments, keys, item, [duration, "abs_current"], first.least, first.epsilon), [*keys, item])
    averages = ("current_mean", "abs_current", "current_std", "voltage_min", "minutes")
    means = rows.groupBy(*keys, "cluster").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in averages])
    flags = qocv_clusters(pulse_clusters(capacity_first(means, keys, protocol.cap_rate), protocol), keys, protocol)
    rows = rows.join(flags.select(*keys, "cluster", "cap", "again", "pulse", "qocv"), [*keys, "cluster"])
    likely = rows.where("again")
    inner = density.density_clusters(likely, keys, item, ["current_mean"], second.least, second.epsilon).withColumnRenamed("cluster", "_layer")
    within = likely.select(*keys, item, "current_mean").join(inner, [*keys, item])
    tests = capacity_second(within.groupBy(*keys, F.col("_layer").alias("cluster")).agg(F.count("*").alias("n"), F.avg("current_mean").alias("current_mean")), keys, protocol.cap_rate, programs, buffer)
    layered = inner.join(tests.select(*keys, F.col("cluster").alias("_layer"), F.col("cap").alias("_cap")), [*keys, "_layer"])
    rows = rows.join(layered, [*keys, item], "left")
    cap = F.when(F.col("again"), F.coalesce("_cap", F.lit(False))).otherwise(F.col("cap"))
    named = F.when(F.col("again"), F.concat(F.lit("cap_layer_"), F.col("_layer").cast("string"))).otherwise(F.col("cluster").cast("string"))
    target = F.when(cap, "CAP*").when(F.col("pulse"), "PUL*").when(F.col("qocv"), "QOCV*").otherwise(F.col("cluster").cast("string"))
    return rows.select(*segments.columns, "cluster", named.alias("cluster_id"), target.alias("target"))


def reunited(kept: DataFrame, dropped: DataFrame, target: str = "-1") -> DataFrame:
    """Segments that went through the layers, with those that were left out before, under a label of
    their own."""
    return kept.unionByName(dropped.withColumn("target", F.lit(target)), allowMissingColumns=True)
