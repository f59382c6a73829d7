"""The sample table that queries work on, from ``events``, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltaspan.sources.shared import shared_folder

__all__ = ["Query", "SAMPLES", "contributed", "mean_in_order", "rounded", "sampled", "samples", "shared_folder", "table"]

#: Gaps longer than so many median intervals carry no charge.
CUT = 3.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def rounded(x: Column | str, digits: int) -> Column:
    """To so many decimals, halves away from zero, by the double itself: Spark's own ``round`` goes
    by its shortest decimal form, which makes ties of numbers that are just under one."""
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x * 10.0**digits) / 10.0**digits


def mean_in_order(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, *others: Column) -> DataFrame:
    """A row per key with the mean of ``value``, its sum taken row by row in the given order, and other
    aggregates. Sums of parts hang on how files are split, and a mean that lies on a limit would fall on
    either side of it; rows that are equal in the order go by value, so any of them may come first. A
    key's rows pass through one task, sorted and spilled by Spark."""
    line = Window.partitionBy(*keys).orderBy(*order, value)
    placed = rows.withColumns({"_sum": F.sum(value).over(line.rowsBetween(Window.unboundedPreceding, 0)), "_place": F.row_number().over(line)})
    return placed.groupBy(*keys).agg(F.try_divide(F.max_by("_sum", "_place"), F.count(value)).alias(name), *others)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows cell, seq, us, value, kind, current, state, procedure, week."""
    return sampled(table(spark, sf_dir, "events"))


def sampled(events: DataFrame) -> DataFrame:
    """The same of a table or stream of events."""
    kind, value = F.col("event_type"), F.col("value")
    current = F.when(kind == "click", value).when(kind == "purchase", -value).otherwise(0.0)
    state = F.when(kind == "view", "PAU").when(kind == "error", "PAUO").when(kind == "click", "CHA").when(kind == "purchase", "DCH").otherwise("EIS")
    quarter = F.floor(F.get_json_object("props", "$.k").cast("int") / 25).cast("string")
    stamp = F.col("ts").cast("timestamp")
    return events.select(
        F.col("user_id").alias("cell"), F.col("event_id").alias("seq"), F.unix_micros(stamp).alias("us"), "value", kind.alias("kind"),
        current.alias("current"), state.alias("state"), F.concat(F.lit("P"), quarter).alias("procedure"), F.unix_micros(F.date_trunc("week", stamp)).alias("week"),
    )


SAMPLES = """s AS (SELECT user_id AS cell, event_id AS seq, epoch_us(ts) AS us, value, event_type AS kind,
 CASE event_type WHEN 'click' THEN value WHEN 'purchase' THEN -value ELSE 0.0 END AS current,
 CASE event_type WHEN 'view' THEN 'PAU' WHEN 'error' THEN 'PAUO' WHEN 'click' THEN 'CHA' WHEN 'purchase' THEN 'DCH' ELSE 'EIS' END AS state,
 'P' || CAST(CAST(floor(CAST(json_extract_string(props, '$.k') AS INT) / 25.0) AS INT) AS VARCHAR) AS procedure,
 epoch_us(CAST(date_trunc('week', ts) AS TIMESTAMP)) AS week FROM events)"""


def contributed(keys: str, source: str = "s", name: str = "c", factor: float = CUT) -> str:
    """SQL of ``operators.charge.contributions``: common tables up to ``name``."""
    return f"""{name}_d AS (SELECT *, us - lag(us) OVER w AS dt, lag(current) OVER w AS prev_current FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY us, seq)),
{name}_m AS (SELECT {keys}, CASE WHEN count(dt) >= 2 AND median(dt) > 0 THEN {factor} * median(dt) END AS cut FROM {name}_d GROUP BY {keys}),
{name} AS (SELECT d.*, m.cut, CASE WHEN d.dt > m.cut THEN 0.0 ELSE coalesce((abs(d.current) + abs(d.prev_current)) / 2 * d.dt / 3600000000.0, 0.0) END AS contrib FROM {name}_d d JOIN {name}_m m USING ({keys}))"""
