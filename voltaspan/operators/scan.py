"""Running values over long series, shared by many tasks.

A series of one key is cut into slices of its order. Each slice is scanned by itself; what it hands on
(its sum, its last value, its greatest) goes into a table with one row per slice, is scanned there,
and is added to the slices after it. So no task holds more than a slice, whatever the key. Key and
slice are one struct, which is never null: nulls in keys or order stay where a window has them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Microseconds in a slice of time: 90 days.
SLICE = 90 * 86_400_000_000


@dataclass(frozen=True)
class Carry:
    """A value of the rows up to each row, itself included: ``sum``, ``max``, ``min`` or ``last`` (not
    null) of a column; ``lag`` is the column in the row before, ``next`` the first that isn't null in
    the row or after it."""

    kind: str
    column: Column


def _ordered(order: Sequence[str]) -> list[Column]:
    return [F.col(c) for c in order]


def scanned(rows: DataFrame, keys: Sequence[str], order: Sequence[str], carries: dict[str, Carry], width: float | None = SLICE) -> DataFrame:
    """Rows with a column for each carry. Slices are ``width`` wide in the first column of the order;
    without a width a key is one slice. Rows that are equal in the order come as they come."""
    keys, order = list(keys), list(order)
    place = F.floor(F.col(order[0]) / F.lit(width)) if width else F.lit(0)
    at = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], place.alias("slice"))
    cut = rows.withColumns({"_at": at} | {f"_c_{name}": c.column for name, c in carries.items()})
    up = Window.partitionBy("_at").orderBy(*_ordered(order))
    so_far, ahead = up.rowsBetween(Window.unboundedPreceding, 0), up.rowsBetween(0, Window.unboundedFollowing)
    place_of = F.struct(*order)
    inner, ends, outer = {}, [], []
    slices = Window.partitionBy(*[F.col(f"_at.k{i}") for i in range(len(keys))]).orderBy("_at.slice")
    before, after = slices.rowsBetween(Window.unboundedPreceding, -1), slices.rowsBetween(1, Window.unboundedFollowing)
    for name, carry in carries.items():
        c = F.col(f"_c_{name}")
        known = F.when(c.isNotNull(), place_of)
        if carry.kind == "lag":
            inner[name] = F.lag(F.struct(c.alias("v"))).over(up)
            ends.append(F.max_by(F.struct(c.alias("v")), place_of).alias(f"_e_{name}"))
            outer.append(F.lag(f"_e_{name}").over(slices).alias(f"_b_{name}"))
        elif carry.kind == "last":
            inner[name] = F.last(c, ignorenulls=True).over(so_far)
            ends.append(F.max_by(c, known).alias(f"_e_{name}"))
            outer.append(F.last(f"_e_{name}", ignorenulls=True).over(before).alias(f"_b_{name}"))
        elif carry.kind == "next":
            inner[name] = F.first(c, ignorenulls=True).over(ahead)
            ends.append(F.min_by(c, known).alias(f"_e_{name}"))
            outer.append(F.first(f"_e_{name}", ignorenulls=True).over(after).alias(f"_b_{name}"))
        else:
            f = {"sum": F.sum, "max": F.max, "min": F.min}[carry.kind]
            inner[name] = f(c).over(so_far)
            ends.append(f(c).alias(f"_e_{name}"))
            outer.append(f(f"_e_{name}").over(before).alias(f"_b_{name}"))
    plain = [c for c in rows.columns if c not in carries]
    if width is None:
        out = cut.withColumns(inner)
        return out.select(*plain, *[(F.col(f"{n}.v") if c.kind == "lag" else F.col(n)).alias(n) for n, c in carries.items()])
    table = cut.groupBy("_at").agg(*ends).select("_at", *outer)
    both = cut.withColumns({f"_i_{n}": c for n, c in inner.items()}).join(table, "_at")

    def met(name: str, kind: str) -> Column:
        i, b = F.col(f"_i_{name}"), F.col(f"_b_{name}")
        if kind == "sum":
            return F.when(i.isNull(), b).otherwise(i + F.coalesce(b, F.lit(0)))
        return F.coalesce(i, b)["v"] if kind == "lag" else {"max": F.greatest, "min": F.least}.get(kind, F.coalesce)(i, b)

    return both.select(*plain, *[met(n, c.kind).alias(n) for n, c in carries.items()])


def numbered(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], looks_at: dict[str, Column], new: Callable[[Column, Column], Column], name: str, begins: dict[str, Column] | None = None, carries: dict[str, Carry] | None = None, width: float = SLICE
) -> DataFrame:
    """Adds ``name``, how many rows up to each one are new; for ``begins`` the value of the last new
    row; and carries, all in one pass.

    ``new`` says whether a row is, from what ``looks_at`` names of it and of the row before (structs;
    in a key's first row that is null). Within a slice it is known at once; for a slice's first row
    it follows from the table of slices.
    """
    keys, order, begins, carries = list(keys), list(order), begins or {}, carries or {}
    at = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.floor(F.col(order[0]) / F.lit(width)).alias("slice"))
    up, place = Window.partitionBy("_at").orderBy(*_ordered(order)), F.struct(*order)
    so_far = up.rowsBetween(Window.unboundedPreceding, 0)
    now = F.struct(*[c.alias(n) for n, c in looks_at.items()])
    cut = rows.withColumns({"_at": at, "_now": now} | {f"_g_{n}": c for n, c in begins.items()} | {f"_c_{n}": c.column for n, c in carries.items()})
    cut = cut.withColumn("_was", F.lag("_now").over(up))
    cut = cut.withColumn("_flag", F.when(F.col("_was").isNotNull(), F.coalesce(new(F.col("_now"), F.col("_was")).cast("long"), F.lit(0))).otherwise(0))
    flagged = F.when(F.col("_flag") == 1, place)
    ends = [F.min_by("_now", place).alias("_first"), F.max_by("_now", place).alias("_last"), F.sum("_flag").alias("_changes")]
    ends += [e for n in begins for e in (F.max_by(f"_g_{n}", flagged).alias(f"_e_{n}"), F.min_by(f"_g_{n}", place).alias(f"_f_{n}"))]
    inner = {f"_i_{name}": F.sum("_flag").over(so_far)} | {f"_i_{n}": F.last(F.when(F.col("_flag") == 1, F.col(f"_g_{n}")), ignorenulls=True).over(so_far) for n in begins}
    for n, carry in carries.items():
        c = F.col(f"_c_{n}")
        ends.append((F.max_by(c, F.when(c.isNotNull(), place)) if carry.kind == "last" else F.sum(c)).alias(f"_e_{n}"))
        inner[f"_i_{n}"] = F.last(c, ignorenulls=True).over(so_far) if carry.kind == "last" else F.sum(c).over(so_far)
    slices = Window.partitionBy(*[F.col(f"_at.k{i}") for i in range(len(keys))]).orderBy("_at.slice")
    before = slices.rowsBetween(Window.unboundedPreceding, -1)
    table = cut.groupBy("_at").agg(*ends).withColumn("_prev", F.lag("_last").over(slices))
    table = table.withColumn("_edge", F.coalesce(new(F.col("_first"), F.col("_prev")).cast("long"), F.lit(0)))
    of_edge = {n: F.when(F.col("_edge") == 1, F.col(f"_f_{n}")) for n in begins}
    found = [(F.coalesce(F.sum(F.col("_changes") + F.col("_edge")).over(before), F.lit(0)) + F.col("_edge")).alias(f"_b_{name}")]
    found += [F.coalesce(of_edge[n], F.last(F.coalesce(F.col(f"_e_{n}"), of_edge[n]), ignorenulls=True).over(before)).alias(f"_b_{n}") for n in begins]
    found += [(F.last(f"_e_{n}", ignorenulls=True) if c.kind == "last" else F.sum(f"_e_{n}")).over(before).alias(f"_b_{n}") for n, c in carries.items()]
    both = cut.withColumns(inner).join(table.select("_at", *found), "_at")
    summed = lambda n: F.coalesce(F.col(f"_i_{n}") + F.col(f"_b_{n}"), f"_i_{n}", f"_b_{n}")
    held = lambda n: F.coalesce(f"_i_{n}", f"_b_{n}")
    out = {name: summed(name)} | {n: held(n) for n in begins} | {n: held(n) if c.kind == "last" else summed(n) for n, c in carries.items()}
    return both.select(*[c for c in rows.columns if c not in out], *[c.alias(n) for n, c in out.items()])
