"""Row rules as native columns: predicates, masks, labels, parsers of names and tokens.

Each function gives a Column (or a condition) of its own and takes its thresholds as parameters,
so that the rule stays inside the plan of whatever frame it is used in. Nulls: a condition on a
null is false, a label of a null is the default, unless a function says otherwise.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Labels that a classifier is taught as they are, and what later stages call them.
KNOWN_LABELS = ("CAP", "PUL", "PUL*RES", "qOCV_DCH", "qOCV_CHA", "-1")
TAGGED = {"CAP": "CAP*", "PUL": "PUL*", "qOCV_DCH": "QOCV*", "qOCV_CHA": "QOCV*", "PREP_CHA": "PREP_CHA", "SOC_ADJUST": "SOC_ADJUST", "-1": "-1"}


def any_of(conditions: Iterable[Column]) -> Column:
    return functools.reduce(operator.or_, conditions, F.lit(False))


def contains_any(text: Column, fragments: str | Sequence[str] | None) -> Column:
    """Whether a text has one of the fragments in it; None means no condition at all."""
    if fragments is None:
        return F.lit(True)
    wanted = [fragments] if isinstance(fragments, str) else fragments
    return F.coalesce(any_of(text.contains(w) for w in wanted), F.lit(False))


def chosen_cell(name: Column, kind: str, fragments: str | Sequence[str] | None = None, banned: str = "eis") -> Column:
    """Cells of a kind with one of the fragments in their name; impedance recordings aren't cells."""
    return name.contains(kind) & ~F.lower(name).contains(banned) & contains_any(name, fragments)


def scaled_voltage(v: Column, low: float, high: float) -> Column:
    return (v - low) / (high - low)


def scaled_current(i: Column, nominal: float) -> Column:
    return i / nominal


def scaled_power(p: Column, nominal_voltage: float, nominal: float) -> Column:
    return p / (nominal_voltage * nominal)


def true_range(own: Column, before: Column, current: Column, low: float, high: float) -> Column:
    """The voltage range of a segment counted from where the one before it ended: up to ``high``
    for charging, down to ``low`` else; its own range where nothing is before it."""
    return F.when(before.isNotNull() & (current > 0), high - before).when(before.isNotNull(), before - low).otherwise(own)


def near_any(value: Column, targets: Sequence[float], tolerance: float) -> Column:
    """Whether the size of a value is within the tolerance of a target, the ends left out. The sign
    doesn't count: -25 degrees is near 25."""
    return any_of((F.abs(value) > t - tolerance) & (F.abs(value) < t + tolerance) for t in targets)


def rate_near(current: Column, rate: float, share: float = 0.05) -> Column:
    """Whether a current is the rate, give or take a share of it, the ends left out."""
    return (current / rate > 1 - share) & (current / rate < 1 + share)


def power_rate_near(power: Column, rate: float, nominal_voltage: float, share: float = 0.05) -> Column:
    """The same for constant power."""
    return rate_near(power / nominal_voltage, rate, share)


def equivalent_cycles(ah: Column, capacity: float, halves: bool = True) -> Column:
    """Throughput in full cycles: charge and discharge make one, or, in the older count, each."""
    return ah / capacity / (2 if halves else 1)


def with_neighbours(rows: DataFrame, number: str, offsets: Sequence[int] = (1,)) -> DataFrame:
    """Adds the ids ``<bm>_<proc>`` of a row and of the numbers beside it."""
    return rows.withColumns({"id": F.concat_ws("_", F.col("bm").cast("string"), F.col(number).cast("string"))} | {("next" if d == 1 else f"id{d:+d}"): F.concat_ws("_", F.col("bm").cast("string"), (F.col(number) + d).cast("string")) for d in offsets})


def id_parts(identity: Column) -> tuple[Column, Column]:
    """Program and procedure of an id, parted at its last underscore; null where it has no such form."""
    parts = [F.nullif(F.regexp_extract(identity, r"^(.*)_([^_]*)$", i), F.lit("")).try_cast("int") for i in (1, 2)]
    both = parts[0].isNotNull() & parts[1].isNotNull()
    return F.when(both, parts[0]), F.when(both, parts[1])


def current_state(current: Column, rest: float = 0.05) -> Column:
    return F.when(F.abs(current) < rest, "rest").when(current > 0, "cha").otherwise("dch")


def state_prefix(state: Column) -> Column:
    """DCH and CHA without what follows them."""
    return F.when(state.startswith("DCH"), "DCH").when(state.startswith("CHA"), "CHA").otherwise(state)


def state_and_current(state: Column, current: Column) -> Column:
    """The label of a step: its state and its current to one decimal."""
    return F.concat(state_prefix(state), F.lit("/"), F.call_function("format_number", current, F.lit("0.0")))


def amplitude_in(amplitude: Column, wanted: Sequence[float], tolerance: float = 0.05) -> Column:
    """Whether the size of an amplitude is near one of a list, by a share of it; an empty list takes
    all, and not-a-number is never near."""
    if not wanted:
        return F.lit(True)
    return F.coalesce(any_of(F.abs(F.abs(amplitude) - w) <= tolerance * w for w in wanted) & ~F.isnan(amplitude.cast("double")), F.lit(False))


def status_class(soh: Column, red: float = 60.0, amber: float = 70.0) -> Column:
    """How a report marks a row."""
    return F.when(soh.isNull(), "").when(soh < red, "red").when(soh < amber, "amber").otherwise("ok")


def degree_tag(temperature: Column) -> Column:
    """A temperature in a file's name, in whole degrees (halves to the even one), or NA."""
    known = temperature.isNotNull() & ~F.isnan(temperature)
    return F.concat(F.when(known, F.call_function("format_number", temperature, F.lit("0"))).otherwise("NA"), F.lit("degreeC"))


def place_among(value: Column, edges: Sequence[float]) -> Column:
    """The number, from 1, of the interval between edges that a value is in; beyond the ends the
    first or the last."""
    inner = edges[1:-1]
    return functools.reduce(lambda c, k: c.when(value < inner[k], k + 1), range(1, len(inner)), F.when(value < inner[0], 1)).otherwise(len(inner) + 1)


def capacity_reference(soh: Column, nominal: float) -> Column:
    """The capacity that a state of health stands for; the nominal one without any."""
    return F.when(soh > 0, nominal * soh / 100).otherwise(F.lit(nominal))


# Which mark a plot gives a C-rate.
RATE_SYMBOLS = {"0.5": "circle", "05c": "circle", "0.5c": "circle", "c/2": "circle", "1.0": "square", "1": "square", "1c": "square"}


def rate_symbol(rate: Column, default: str = "diamond") -> Column:
    """The mark of a C-rate, by its text without blanks and in lower case."""
    pairs = F.create_map(*[F.lit(x) for kv in RATE_SYMBOLS.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, F.lower(F.trim(rate.cast("string")))), F.lit(default))


def name_field(name: Column, number: int, separator: str = "=") -> Column:
    """A field of a name, counted from 1; null where the name has fewer."""
    return F.try_element_at(F.split(name, separator), F.lit(number))


def coalesced(*columns: Column) -> Column:
    return F.coalesce(*columns)


def leftover_label(label: Column, current: Column, voltage_high: Column, voltage_low: Column, known: Sequence[str] = KNOWN_LABELS, least: float = 0.1, top: float = 0.95, bottom: float = 0.05) -> Column:
    """Labels of segments that no rule named: known ones stay; of the others those with current
    that stop short of the end are adjustments of the state of charge, and those that charge to
    the top are preparation; the rest is -1."""
    live = F.abs(current) >= least
    adjust = live & ((current > 0) & (voltage_high <= top) | (current < 0) & (voltage_low > bottom))
    return F.when(label.isin(*known), label).when(adjust, "SOC_ADJUST").when(live & (current > 0) & (voltage_high > top), "PREP_CHA").otherwise("-1")


def c_rate_tag(rate: Column) -> Column:
    """A C-rate in a label: 2c, c3 (a third), cNA; halves go to the even number."""
    whole = lambda x: F.bround(x).cast("int").cast("string")
    return F.when(rate.isNull() | F.isnan(rate) | (rate <= 0) | (rate == float("inf")), "cNA").when(rate >= 0.95, F.concat(whole(rate), F.lit("c"))).otherwise(F.concat(F.lit("c"), whole(1 / rate)))


def _finite(*columns: Column) -> Column:
    return functools.reduce(operator.and_, (c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) for c in columns))


def _in_band(rate: Column, wanted: float | None, tolerance: float) -> Column:
    return F.lit(False) if not wanted else rate.between(wanted * (1 - tolerance), wanted * (1 + tolerance))


def _slow(rate: Column, wanted: float | None, tolerance: float) -> Column:
    return F.lit(False) if not wanted else rate <= wanted * (1 + tolerance)


def canonical_label(
    label: Column, spanned: Column, current: Column, rate: Column, cap_rate: float | None = None, qocv_rate: float | None = None, full: float = 0.9, cap_tolerance: float = 0.05, qocv_tolerance: float = 0.2
) -> Column:
    """Free labels of segments as those that the pipeline acts on, from what was measured: the share
    of the window that a segment spans, the sign of its current, its C-rate. Pulses are ``pulse``.
    Of sweeps those that span ``full`` are ``qocv`` when slow, ``cap`` when they discharge at the
    capacity's rate, else named by direction and rate; shorter ones are partial. Other labels, and
    sweeps that lack a figure, stay as they are (trimmed)."""
    plain = F.trim(label)
    low = F.lower(plain)
    sweep = low.startswith("full_") | low.startswith("partial_") | low.startswith("mixed_") | low.contains("qocv")
    charges, whole, tag = current > 0, spanned >= full, c_rate_tag(rate)
    return (
        F.when(low.contains("pulse"), "pulse")
        .when(~sweep | ~_finite(spanned, current, rate), plain)
        .when(whole & _slow(rate, qocv_rate, qocv_tolerance), "qocv")
        .when(whole & ~charges & _in_band(rate, cap_rate, cap_tolerance), "cap")
        .when(whole, F.concat(F.when(charges, "full_charge_").otherwise("full_discharge_"), tag))
        .otherwise(F.concat(F.when(charges, "partial_cha_").otherwise("partial_dch_"), tag))
    )


def tagged_class(label: Column) -> Column:
    """A classifier's label as later stages call it."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in TAGGED.items() for x in kv]), label)


def tagged_label(label: Column, rate: Column, cap_rate: float | None = None, qocv_rate: float | None = None, cap_tolerance: float = 0.05, qocv_tolerance: float = 0.2) -> Column:
    """A free label as later stages call it; full sweeps by their measured C-rate. Others stay."""
    low, size = F.lower(label), F.abs(rate)
    swept = low.contains("full_discharge") | low.contains("full_charge")
    return (
        F.when(low.contains("pulse"), "PUL*").when(low.contains("qocv"), "QOCV*").when(low == "cap", "CAP*")
        .when(swept & F.coalesce(_slow(size, qocv_rate, qocv_tolerance), F.lit(False)), "QOCV*")
        .when(low.contains("full_discharge") & F.coalesce(_in_band(size, cap_rate, cap_tolerance), F.lit(False)), "CAP*")
        .otherwise(label)
    )


def qocv_target(mean: Column, spread: Column, wanted: float, tolerance: float, widest: float) -> Column:
    """A slow sweep: a mean current near the wanted one and steady; else -1."""
    fits = (F.abs(F.abs(mean) - wanted) <= tolerance) & (spread < widest)
    return F.when(fits, F.when(mean > 0, "qOCV_CHA").otherwise("qOCV_DCH")).otherwise("-1")


def aging_conditions(procedures: Column, marker: str = "jri_Aging", word: str = "Aging") -> dict[str, Column]:
    """Conditions in the last aging procedure of a list, if one of them has the marker: parts of its
    name that end with what they mean (80DOD, 50SOC, 25grad), and the C-rate last."""
    name = F.when(F.exists(procedures, lambda p: p.contains(marker)), F.try_element_at(F.filter(procedures, lambda p: p.contains(word)), F.lit(-1)))
    parts = F.split(name, "_")
    before = lambda mark: F.element_at(F.split(F.get(F.filter(parts, lambda p: p.contains(mark)), F.lit(0)), mark), 1).try_cast("int")
    return {"DOD": before("DOD"), "SOC": before("SOC"), "Temperature": before("grad"), "C_Rate": F.element_at(parts, -1)}


def cycling_conditions(procedures: Column, marker: str = "Cyc") -> dict[str, Column]:
    """Conditions by place in the first procedure with the marker: the C-rate fourth, the
    temperature fifth, then ``mean<SOC>dod<DOD>``. What isn't a whole number is null."""
    parts = F.split(F.get(F.filter(procedures, lambda p: p.contains(marker)), F.lit(0)), "_")
    whole = lambda text: F.when(text.rlike("^[0-9]+$"), text).try_cast("int")
    field = F.get(parts, F.lit(5))
    ends = F.split(F.when(field.contains("dod"), field), "dod", 2)
    return {"DOD": whole(F.get(ends, F.lit(1))), "SOC": whole(F.replace(F.get(ends, F.lit(0)), F.lit("mean"), F.lit(""))), "C_Rate": F.get(parts, F.lit(3)), "Temperature": whole(F.get(parts, F.lit(4)))}


def first_of(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key, the first in order. Spark keeps the first of each task before it moves any."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def followed_by(rows: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, wanted: Sequence[Sequence[str]]) -> DataFrame:
    """Rows from which on, themselves first, a column goes through the wanted values, each given by
    its choices."""
    w = Window.partitionBy(*keys).orderBy(*order)
    hit = functools.reduce(operator.and_, (F.lead(column, k).over(w).isin(*choices) for k, choices in enumerate(wanted)))
    return rows.withColumn("_hit", hit).where("_hit").drop("_hit")


def descending_soc(place: Column, step: float, start: float = 100.0) -> Column:
    """A ladder of states of charge by counting steps down (or, with a negative step, up)."""
    return F.least(F.greatest(start - step * place, F.lit(0)), F.lit(100))


def required(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The frame, if it has the columns; an error that names those it lacks."""
    lacking = [c for c in columns if c not in frame.columns]
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return frame
