"""Current pulses: which segments are good ones, resistances without a model, and circuit fits.

Selection and model-free resistances are aggregations and windows. Fits see one pulse at a time, a
few hundred samples with the rest after it. Rows of pulses have ``t``, seconds from the start of the
pulse, ``v`` and ``i``; a table of pulses has ``t_p``, its length, ``i_p``, its current, and
``v_pre``, the voltage before it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltaspan.functions import kernels
from voltaspan.operators.groups import padded, together
from voltaspan.operators.rules import amplitude_in, state_prefix

REST, SPREAD = 0.05, 0.05


def segments(rows: DataFrame, keys: Sequence[str], order: Sequence[str], state: str = "state") -> DataFrame:
    """Adds ``segment``, the number of the run of one state (its prefix) within the keys."""
    w = Window.partitionBy(*keys).orderBy(*order)
    plain = state_prefix(F.col(state))
    marked = rows.withColumn("_state", plain)
    new = F.coalesce(F.col("_state") != F.lag("_state").over(w), F.lit(True)).cast("int")
    return marked.withColumn("_new", new).withColumn("segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new", "_state")


def selected(rows: DataFrame, keys: Sequence[str], order: Sequence[str], current: str, state: str, target: str | None = None, minutes: str | None = None, after: float = 0.0, amplitudes: Sequence[float] = (), tolerance: float = 0.05) -> DataFrame:
    """One row per segment that is a good pulse: keys, segment, ``amplitude``, ``n``.

    It charges or discharges; its current is above rest and steady (a leading zero aside) and, with
    a list of amplitudes, near one of them; it begins ``after`` minutes into its cycle or later; and
    it has a row labelled PUL if any of its group has.
    """
    w = Window.partitionBy(*keys, "segment").orderBy(*order)
    size = F.abs(current)
    lead = (F.row_number().over(w) == 1) & (F.col(current) == 0) & (F.count("*").over(Window.partitionBy(*keys, "segment")) > 1)
    live = segments(rows, keys, order, state).where(state_prefix(F.col(state)).isin("CHA", "DCH")).withColumn("_i", F.when(~lead, F.col(current)))
    marked = F.max(F.coalesce(F.col(target) == "PUL", F.lit(False)).cast("int")) if target else F.max(F.lit(1))
    found = live.groupBy(*keys, "segment").agg(
        F.count("*").alias("n"), F.median(F.abs("_i")).alias("middle"), F.stddev_samp("_i").alias("spread"), F.median(F.when(size > REST, size)).alias("amplitude"), F.min(minutes or F.lit(0.0)).alias("begin"), marked.alias("pul")
    )
    labelled = F.max("pul").over(Window.partitionBy(*keys)) == 1
    steady = (F.col("middle") >= REST) & ~F.coalesce(F.col("spread") > SPREAD * F.col("middle"), F.lit(False))
    good = steady & amplitude_in(F.col("amplitude"), amplitudes, tolerance) & (F.col("begin") >= after)
    return found.withColumn("_labelled", labelled).where(good & (~F.col("_labelled") | (F.col("pul") == 1))).select(*keys, "segment", "amplitude", "n")


def _over_step(at: Column, after: float, v: Column, i: Column, v_ref: Column, i_ref: Column) -> Column:
    """|dU / dI| from a reference to the first sample ``after`` seconds past a change of current."""
    first = F.min_by(F.struct(v.alias("v"), i.alias("i")), F.when(F.col("t") >= at + after, F.col("t")))
    step = i_ref - first["i"]
    return F.when(F.abs(step) >= 1e-6, F.abs((v_ref - first["v"]) / step))


def model_free(rows: DataFrame, pulses: DataFrame, keys: Sequence[str], after: float = 0.5, knee: float = 0.005) -> DataFrame:
    """Resistances of each pulse without a model: over ``after`` seconds from its start and from its
    end, from the knee of the onset (where the voltage slows to under ``knee`` times the current a
    second, within two seconds), and from the jump at its end to the first sample of the rest."""
    of = rows.join(pulses.select(*keys, "t_p", "i_p", "v_pre"), list(keys))
    w = Window.partitionBy(*keys).orderBy("t")
    slope = F.abs((F.col("v") - F.lag("v").over(w)) / (F.col("t") - F.lag("t").over(w)))
    of = of.withColumn("_slope", slope)
    t, v, i = F.col("t"), F.col("v"), F.col("i")
    t_p, i_p, v_pre = F.first("t_p"), F.first("i_p"), F.first("v_pre")
    early = (t > 0) & (t <= F.least(F.lit(2.0), F.col("t_p")))
    settled = F.min_by("v", F.when(early & (F.col("_slope") < knee * F.abs("i_p")), t))
    last_early, first = F.max_by("v", F.when(early, t)), F.min_by("v", F.when(t >= 0, t))
    end = F.max_by(F.struct("v", "i"), F.when((t <= F.col("t_p")) & (t >= 0), t))
    rest = F.min_by("v", F.when(t > F.col("t_p"), t))
    sums = of.groupBy(*keys).agg(
        t_p.alias("t_p"), i_p.alias("i_p"),
        _over_step(F.lit(0.0), after, v, i, v_pre, F.lit(0.0)).alias("r_dc_onset"),
        F.abs((F.coalesce(settled, last_early, first) - v_pre) / i_p).alias("r_onset"),
        F.abs((rest - end["v"]) / i_p).alias("r_termination"),
        end.alias("_end"),
        F.min_by(F.struct("v", "i"), F.when(t >= F.col("t_p") + after, t)).alias("_after"),
    )
    step = F.col("_end.i") - F.col("_after.i")
    return sums.withColumn("r_dc_termination", F.when(F.abs(step) >= 1e-6, F.abs((F.col("_end.v") - F.col("_after.v")) / step))).drop("_end", "_after")


def charge_ramp(rows: DataFrame, keys: Sequence[str], time: str, current: str, start: str, end: str) -> DataFrame:
    """Adds ``ocv``: from ``start`` to ``end`` in proportion to the charge that has flowed."""
    w = Window.partitionBy(*keys).orderBy(time)
    dq = F.coalesce((F.abs(current) + F.abs(F.lag(current).over(w))) / 2 * (F.col(time) - F.lag(time).over(w)), F.lit(0.0))
    q = F.sum("_dq").over(w.rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum("_dq").over(Window.partitionBy(*keys))
    share = F.coalesce(F.try_divide(q, whole), F.lit(0.0))
    return rows.withColumn("_dq", dq).withColumn("ocv", F.col(start) + (F.col(end) - F.col(start)) * share).drop("_dq")


FAST, SLOW = (0.2, 60.0), (20.0, 6000.0)


#: So many pulses are fitted at once, and more of short ones: as many as have so many samples together.
STACK, SAMPLES = 256, 32_768


def _fitted(mask: np.ndarray, y: np.ndarray, parts: Callable, ranges: Sequence[tuple[float, float]], signed: Sequence[bool], **options) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Constants, coefficients and root mean square of many fits, over the samples in ``mask`` alone."""
    design = lambda of, *at: [c * mask[of] for c in parts(of, *at)]
    return kernels.searched_each(design, np.where(mask, y, 0.0), mask.sum(axis=1), np.tile(np.array(ranges, float), (len(y), 1, 1)), signed, **options)


def _some(which: np.ndarray, names: Sequence[str], one: Callable) -> dict[str, np.ndarray]:
    """What ``one`` gives for some rows, not-a-number for the others."""
    at, out = np.flatnonzero(which), {c: np.full(len(which), np.nan) for c in names}
    if len(at):
        for c, x in one(at).items():
            out[c][at] = x
    return out


def _each_once(kind: Callable, t: np.ndarray, i_p: np.ndarray, t_p: np.ndarray, of: np.ndarray, tau: np.ndarray) -> np.ndarray:
    """An element's rows for pulses ``of`` and their constants. A grid has a pair many times, with other
    constants of the other elements: it is made once."""
    _, first, back = np.unique(of + 1j * tau[:, 0], return_index=True, return_inverse=True)
    if len(first) == len(of):
        return kind(t[of], i_p[of], t_p[of], tau)
    one = of[first]
    return kind(t[one], i_p[one], t_p[one], tau[first])[back]


def _joint(t: np.ndarray, v: np.ndarray, inside: np.ndarray, p: dict, diffusion: bool) -> dict:
    """Two RC elements (and finite diffusion) over pulse and rest, the ohmic part given, the voltage
    at rest moving with the charge."""
    inside = inside & (t >= 0)
    t_p, i_p, t = p["t_p"], p["i_p"], np.where(inside, t, 0.0)
    share = np.clip(t / t_p, 0, 1)
    y = v - p["v_pre"] * (1 - share) - np.where(t <= t_p, i_p * p["r0"], 0)
    kinds = [kernels.rc_pulse] * 2 + [kernels.warburg_pulse] * diffusion
    parts = lambda of, *tau: [share[of], *(_each_once(k, t, i_p, t_p, of, x) for k, x in zip(kinds, tau))]
    ranges = [FAST, SLOW] + [(1.0, 6000.0)] * diffusion
    tau, x, rms = _fitted(inside, y, parts, ranges, [True] + [False] * (2 + diffusion), points=5 if diffusion else 7)
    bad = (x[:, 1] <= 0) | (x[:, 2] <= 0) | (tau[:, 1] < 1.05 * tau[:, 0]) | (tau[:, 1] > 0.98 * SLOW[1])
    out = {"ocv_post": x[:, 0], "r1": x[:, 1], "tau1": tau[:, 0], "r2": x[:, 2], "tau2": tau[:, 1], "rms": rms, "degenerate": bad}
    return out | ({"r_w": x[:, 3], "tau_w": tau[:, 2]} if diffusion else {})


def _termination(t: np.ndarray, v: np.ndarray, inside: np.ndarray, p: dict, window: float = 60.0) -> np.ndarray:
    """The ohmic step at the end of a pulse, the rest carried back to the instant of its end."""
    t_p, during = p["t_p"], inside & (t <= p["t_p"])
    rest = inside & (t > t_p) & (t - t_p <= window)

    def one(at):
        # one by one: the amplitudes have no bounds, and where they can't be told apart their sum, carried
        # back, hangs on the last digit of every step
        steps = []
        for g in at:
            x = t[g, rest[g]] - t_p[g]
            _, c, _ = kernels.searched(lambda a, b: kernels.beside(np.ones_like(x), np.exp(-x / a), np.exp(-x / b)), v[g, rest[g]], [FAST, SLOW], [True] * 3, together=True)
            steps.append(abs((v[g, during[g]][-1] - c.sum()) / p["i_p"][g, 0]))
        return {"r": np.array(steps)}

    return _some((rest.sum(axis=1) >= 8) & during.any(axis=1), ["r"], one)["r"]


def _onset(t: np.ndarray, v: np.ndarray, inside: np.ndarray, p: dict, window: float = 20.0) -> np.ndarray:
    """The ohmic step at the start of a pulse, its rise carried back; not above ``cap`` (by 2 %)."""
    rise = inside & (t > 0) & (t <= np.minimum(p["t_p"], window))
    cap = p.get("cap", np.full((len(t), 1), np.nan))[:, 0]

    def one(at):
        x, i_p = np.where(rise, t, 0.0)[at], p["i_p"][at]
        most = np.column_stack([np.where(np.isfinite(cap) & (cap > 0), np.minimum(0.2, cap * 1.02), 0.2), np.ones(len(cap)), np.ones(len(cap))])[at]
        parts = lambda of, a, b: [i_p[of] * np.ones_like(x[of]), i_p[of] * (1 - np.exp(-x[of] / a)), i_p[of] * (1 - np.exp(-x[of] / b))]
        return {"r": _fitted(rise[at], (v - p["v_pre"])[at], parts, [FAST, SLOW], [False] * 3, most=most)[1][:, 0]}

    return _some(rise.sum(axis=1) >= 8, ["r"], one)["r"]


_STAGED = ["r1_fast", "tau1_fast", "r2_slow", "tau2_slow", "staged_rms"]


def _staged(t: np.ndarray, v: np.ndarray, inside: np.ndarray, p: dict, cut: float = 5.0) -> dict:
    """The slow element from the rest, once the fast one is gone; the fast one from what the rise
    has besides."""
    rest, rise = inside & (t - p["t_p"] >= cut), inside & (t > 0) & (t <= p["t_p"])

    def one(at):
        t_, v_, rest_, rise_, of_ = t[at], v[at], rest[at], rise[at], inside[at]
        t_p, i_p, v_pre, r0 = (p[c][at] for c in ("t_p", "i_p", "v_pre", "r0"))
        x = np.where(rest_, t_ - t_p, 0.0)
        slow, c, _ = _fitted(rest_, v_, lambda of, b: [np.ones_like(x[of]), np.exp(-x[of] / b)], [SLOW], [True] * 2, ordered=1, points=25)
        grown = 1 - np.exp(-t_p / slow)
        with np.errstate(divide="ignore", invalid="ignore"):
            r2, post = c[:, 1:] / (i_p * grown), c[:, :1]
        ok = (grown >= 1e-6)[:, 0]
        r2[~ok] = 0.0
        model = v_pre + (post - v_pre) * np.clip(t_ / t_p, 0, 1) + np.where(t_ <= t_p, i_p * r0, 0) + r2 * kernels.rc_pulse(t_, i_p, t_p, slow)
        since = np.where(rise_, t_, 0.0)
        fast, c, _ = _fitted(rise_, v_ - model, lambda of, a: [kernels.rc_pulse(since[of], i_p[of], t_p[of], a)], [FAST], [False], ordered=1, points=25)
        r = np.where(of_, model + c * kernels.rc_pulse(t_, i_p, t_p, fast) - v_, 0.0)
        rms = np.sqrt((r**2).sum(axis=1) / of_.sum(axis=1))
        ok &= (fast <= slow)[:, 0]
        return dict(zip(_STAGED, (np.where(ok, x, np.nan) for x in (c[:, 0], fast[:, 0], r2[:, 0], slow[:, 0], rms))))

    return _some((rest.sum(axis=1) >= 8) & (rise.sum(axis=1) >= 8) & np.isfinite(p["r0"][:, 0]), _STAGED, one)


def _grouped(rows: DataFrame, pulses: DataFrame, keys: Sequence[str], names: Sequence[str], stack: Callable, flags: Sequence[str] = ()) -> DataFrame:
    """One row per pulse: keys and what ``stack`` makes of the samples (t, v, which of them are there) and
    rows of many pulses, of like lengths, at once."""
    columns = [c for c in pulses.columns if c not in keys]
    joined = rows.select(*keys, F.col("t").cast("double").alias("t"), F.col("v").cast("double").alias("v")).join(pulses.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]), list(keys))

    def many(values: dict[str, np.ndarray], starts: np.ndarray):
        ends = np.append(starts[1:], len(values["t"]))
        size = ends - starts
        of = np.flatnonzero(size >= 8)
        of = of[np.argsort(size[of], kind="stable")]
        found = {n: [np.empty(0, bool if n in flags else float)] for n in names}
        stacked = max(STACK, SAMPLES // max(int(size[of].max(initial=1)), 1))
        for few in np.array_split(of, -(-len(of) // stacked) or 1):
            if len(few):
                t, v = (padded(values[c], starts[few], ends[few]) for c in ("t", "v"))
                one = stack(t, v, np.arange(t.shape[1]) < size[few, None], {c: values[c][starts[few]].astype(float)[:, None] for c in columns})
                for n in names:
                    found[n].append(one[n])
        return of, {n: np.concatenate(x) for n, x in found.items()}

    known = joined.where("t is not null and v is not null and not isnan(t) and not isnan(v)")
    return together(known, keys, ["t"], many, ", ".join(f"{n} {'boolean' if n in flags else 'double'}" for n in names))


def extrapolated(rows: DataFrame, pulses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ohmic resistance at the end and at the start of each pulse, carried back to the instant;
    ``cap``, where the pulses have it, bounds the one at the start."""
    def stack(t, v, inside, p):
        return {"r0_termination": _termination(t, v, inside, p), "r0_onset": _onset(t, v, inside, p)}

    return _grouped(rows, pulses, keys, ["r0_termination", "r0_onset"], stack)


def joint(rows: DataFrame, pulses: DataFrame, keys: Sequence[str], diffusion: bool = False) -> DataFrame:
    """Two RC elements, with ``diffusion`` finite diffusion too, fitted to each pulse and the rest
    after it at once; ``r0`` is given. A fit without one of its elements is degenerate."""
    names = ["ocv_post", "r1", "tau1", "r2", "tau2", *(["r_w", "tau_w"] * diffusion), "rms", "degenerate"]
    return _grouped(rows, pulses, keys, names, lambda *of: _joint(*of, diffusion), ["degenerate"])


def staged(rows: DataFrame, pulses: DataFrame, keys: Sequence[str], cut: float = 5.0) -> DataFrame:
    """The slow element from the rest, ``cut`` seconds in, then the fast one from the rise; ``r0`` is given."""
    return _grouped(rows, pulses, keys, _STAGED, lambda *of: _staged(*of, cut))


def rests(rows: DataFrame, keys: Sequence[str], order: Sequence[str], state: str, time: str, current: str, voltage: str, least: int = 10) -> DataFrame:
    """Samples of rests that follow a step with current: keys, ``segment`` of the rest, t from its
    start, v; and of the step before, its last voltage ``v_last`` and current ``i_p``. Rests of
    fewer than ``least`` samples are left out. One row per segment is all that looks back."""
    of = segments(rows, keys, order, state)
    ends = of.groupBy(*keys, "segment").agg(F.first(state_prefix(F.col(state))).alias("_is"), F.count("*").alias("_n"), F.min(time).alias("_t0"), F.max_by(F.struct(voltage, current), F.struct(*order)).alias("_last"))
    w = Window.partitionBy(*keys).orderBy("segment")
    ends = ends.withColumns({"_was": F.lag("_is").over(w), "_before": F.lag("_last").over(w)})
    chosen = ends.where(F.col("_is").startswith("PAU") & F.col("_was").isin("CHA", "DCH") & (F.col("_n") >= least))
    chosen = chosen.select(*keys, "segment", "_t0", F.col(f"_before.{voltage}").alias("v_last"), F.col(f"_before.{current}").alias("i_p"))
    return of.join(chosen, [*keys, "segment"]).select(*keys, "segment", ((F.col(time) - F.col("_t0")) / 1e6).alias("t"), F.col(voltage).alias("v"), "v_last", "i_p")


def relaxed(found: DataFrame, keys: Sequence[str], reference: DataFrame | None = None, share: float = 0.1, bounded: bool = False) -> DataFrame:
    """Two exponentials fitted to each rest, the ohmic step before it (``r0``, from the last voltage
    under current to the rest carried back), resistances of both elements, and the share of variance
    explained. With a ``reference`` (keys, r0) tells whether both agree within ``share``. With
    ``bounded`` amplitudes have the sign that the current gives them."""
    names = ["ocv", "r0", "r1", "tau1", "r2", "tau2", "rms", "r_squared", "railed"]
    keys = [*keys, "segment"]

    def stack(t, v, inside, p):
        i, n, ranges = p["i_p"], inside.sum(axis=1), [FAST, SLOW]
        sign = np.where(np.sign(i) == 0, 1.0, np.sign(i))
        parts = lambda of, a, b: [np.ones_like(t[of]), sign[of] * np.exp(-t[of] / a), sign[of] * np.exp(-t[of] / b)]
        tau, c, rms = _fitted(inside, v, parts, ranges, [True, not bounded, not bounded])
        middle = np.where(inside, v, 0.0).sum(axis=1, keepdims=True) / n[:, None]
        spread = np.sqrt(np.where(inside, (v - middle) ** 2, 0.0).sum(axis=1) / n)
        with np.errstate(divide="ignore", invalid="ignore"):
            r = [np.abs(x / i[:, 0]) for x in (p["v_last"][:, 0] - c[:, 0] - sign[:, 0] * (c[:, 1] + c[:, 2]), c[:, 1], c[:, 2])]
            explained = np.where(spread > 0, 1 - (rms / spread) ** 2, np.nan)
        railed = np.any([(x < 1.02 * low) | (x > 0.98 * high) for x, (low, high) in zip(tau.T, ranges)], axis=0)
        return dict(zip(names, (c[:, 0], r[0], r[1], tau[:, 0], r[2], tau[:, 1], rms, explained, railed)))

    pulses = found.select(*keys, "v_last", "i_p").distinct()
    fits = _grouped(found, pulses, keys, names, stack, ["railed"])
    if reference is None:
        return fits
    of = reference.select(*[F.col(c) for c in reference.columns if c != "r0"], F.col("r0").alias("_r0"))
    both = fits.join(of, [c for c in of.columns if c != "_r0"], "left")
    return both.withColumn("consistent", F.abs(F.col("r0") - F.col("_r0")) <= share * F.abs("_r0")).drop("_r0")


def kind_of(current: Column, amplitude: Column, large: float) -> Column:
    """What a table of pulses calls one: its direction, and whether it is a large one."""
    return F.concat(F.when(current > 0, "cha").otherwise("dch"), F.when(amplitude >= large, "_large").otherwise("_small"))


def by_health(fits: DataFrame, health: DataFrame, keys: Sequence[str], columns: Sequence[str], kind: Column) -> DataFrame:
    """Fits beside the state of health of their check-up: one row per check-up and kind of pulse,
    with the median of each column and the number of pulses."""
    rows = fits.join(health, list(keys), "left").withColumn("pulse_type", kind)
    return rows.groupBy(*keys, "soh", "pulse_type").agg(F.count("*").alias("n"), *[F.median(c).alias(c) for c in columns])


def left_out(fits: DataFrame, keys: Sequence[str], item: str, columns: Sequence[str]) -> DataFrame:
    """For each fit the medians of the other fits of its group (``<column>_others``), by rank: of a
    sorted group without one of its members the middle is one of three values around it."""
    whole = Window.partitionBy(*keys)
    rows = fits.withColumn("_n", F.count("*").over(whole))
    for c in columns:
        rows = rows.withColumn("_rank", F.row_number().over(whole.orderBy(c, item)))
        for k, name in ((0, "_a"), (1, "_b"), (2, "_c")):  # the values at (n - 1) / 2 and the two after it, counted from 1
            at = F.floor((F.col("_n") - 1) / 2) + k
            rows = rows.withColumn(name, F.max(F.when(F.col("_rank") == at, F.col(c))).over(whole))
        m = F.floor((F.col("_n") - 1) / 2)
        odd = F.col("_n") % 2 == 1  # then an even number of others is left
        low, high = F.when(F.col("_rank") <= m, F.col("_b")).otherwise(F.col("_a")), F.when(F.col("_rank") <= m + 1, F.col("_c")).otherwise(F.col("_b"))
        one = F.when(F.col("_rank") <= m + 1, F.col("_c")).otherwise(F.col("_b"))
        rows = rows.withColumn(f"{c}_others", F.when(F.col("_n") > 1, F.when(odd, (low + high) / 2).otherwise(one))).drop("_rank", "_a", "_b", "_c")
    return rows.drop("_n")
