"""Raw cycler recordings made ready: types, times, power, states, implausible rows, charge.

The stages are lazy and each keeps all columns, so Spark runs them in the one scan of a recording.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from voltaspan.operators.rules import any_of

#: Names of the columns of raw recordings, and what they are called here.
RENAMED = {"Zeit": "Time", "Spannung": "Voltage", "Strom": "Current", "T1": "Temperature"}


def renamed(rows: DataFrame) -> DataFrame:
    return rows.withColumnsRenamed({k: v for k, v in RENAMED.items() if k in rows.columns})


def narrowed(rows: DataFrame) -> DataFrame:
    """All doubles in single precision."""
    return rows.withColumns({f.name: F.col(f"`{f.name}`").cast("float") for f in rows.schema.fields if isinstance(f.dataType, DoubleType)})


def in_utc(rows: DataFrame, time: str = "Time", zone: str = "UTC", pattern: str | None = None) -> DataFrame:
    """The time as a timestamp and ``Time_UTC``, the same as UTC has it when the clock of the
    recording runs in ``zone``. Text that is no time gives nulls."""
    kind = rows.schema[time].dataType.simpleString()
    parsed = F.col(time).cast("timestamp") if kind != "string" else F.try_to_timestamp(F.col(time), *([F.lit(pattern)] if pattern else []))
    return rows.withColumns({time: parsed, "Time_UTC": F.to_utc_timestamp(parsed, zone)})


def with_power(rows: DataFrame, voltage: str = "Voltage", current: str = "Current", placeholders: Sequence[str] = ()) -> DataFrame:
    """Adds ``Power``, and columns of nulls for those that later stages fill."""
    return rows.withColumns({"Power": F.col(current) * F.col(voltage)} | {c: F.lit(None).cast("string") for c in placeholders if c not in rows.columns})


def plain_state(state: Column) -> Column:
    """Pauses that carry two stars are pauses."""
    return F.when(state == "PAUO**", "PAUO").when(state == "PAU**", "PAU").otherwise(state)


def relabelled(rows: DataFrame, state: str = "State", charge: str = "AhAkku", floater: str = "Floater", eis: str = "EIS") -> DataFrame:
    """A row with a value in any column of the floater is FLOATER; then one with a value in any
    column of the impedance device and no charge count is EIS."""
    there = lambda mark: any_of(F.col(f"`{c}`").isNotNull() for c in rows.columns if mark in c)
    counted = F.col(charge).isNull() if charge in rows.columns else F.lit(True)
    return rows.withColumn(state, F.when(there(eis) & counted, "EIS").when(there(floater), "FLOATER").otherwise(F.col(state)))


def plausible(rows: DataFrame, highest: float, floater: str = "Floater", quantity: str = "Voltage", share: float = 1.05) -> DataFrame:
    """Without rows in which the floater's voltage is over ``share`` of the cell's highest; nulls stay."""
    over = any_of(F.coalesce(F.col(f"`{c}`") > share * highest, F.lit(False)) for c in rows.columns if floater in c and quantity in c)
    return rows.where(~over)


def countable(rows: DataFrame, current: str = "Current", columns: Sequence[str] = ()) -> DataFrame:
    """Recordings that lack the current (or another of ``columns``) stay, with nulls there: their
    rows count, and carry no charge."""
    return rows.withColumns({c: F.lit(None).cast("double") for c in (current, *columns) if c not in rows.columns})


def prepared(rows: DataFrame, highest: float, zone: str = "UTC", placeholders: Sequence[str] = ()) -> DataFrame:
    """A raw recording with all of this done, in the order in which it counts."""
    rows = countable(narrowed(renamed(rows)), columns=["Voltage"])
    rows = with_power(in_utc(rows, zone=zone), placeholders=placeholders)
    return plausible(relabelled(rows.withColumn("State", plain_state(F.col("State")))), highest)


def projected(rows: DataFrame, columns: Sequence[str], stubs: DataFrame | None = None) -> DataFrame:
    """The wanted columns that a recording has; where it lacks one of them, ``stubs`` instead, if
    there are any, and nulls for what they lack as well."""
    rows = renamed(rows)
    if stubs is not None and any(c not in rows.columns for c in columns):
        rows = renamed(stubs)
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns])


def with_charge(rows: DataFrame, charge: DataFrame, keys: Sequence[str], time: str = "Time") -> DataFrame:
    """Rows with the charge counted at their time, null where none was. One count per time is
    taken, the largest, so rows don't multiply."""
    once = charge.groupBy(*keys, time).agg(F.max("ah").alias("ah"))
    return rows.join(once, [*keys, time], "left")
