"""Fits of impedance spectra, many of them at a time, and the table that brings them together."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltaspan.functions import kernels, numeric
from voltaspan.operators import impedance
from voltaspan.operators.groups import dealt, padded, together
from voltaspan.sources.shared import kept

ALPHA, PHI = (0.6, 1.0), (0.2, 0.9)
#: Seconds at which diffusion is held, and how far below (as a factor) the slowest arc may be.
DIFFUSION, CLEAR = 5.0, 10**-0.7


#: So many points of a grid, over all spectra that are fitted at once: about 130 spectra with three
#: constants. Few stay long in the last steps, so many share what a call costs.
STACK = 16_000


def _stacked(spectra: DataFrame, key: str, columns: Sequence[str], least: int, names: Sequence[str], stack: Callable, types: dict[str, str] | None = None, grid: int = 50) -> DataFrame:
    """One row per spectrum of ``least`` points or more: its key and what ``stack`` makes of many of them, of
    like lengths, at once: angular frequencies, impedances, which of them are there, frequencies, other columns."""
    f, re, im, *others = columns
    types = types or {}
    x = lambda c: F.col(c).cast("double")
    known = spectra.select(key, *[x(c).alias(c) for c in columns])
    for c in (f, re, im):
        known = known.where(F.col(c).isNotNull() & ~F.isnan(c))

    def many(values: dict[str, np.ndarray], starts: np.ndarray):
        ends = np.append(starts[1:], len(values[f]))
        size = ends - starts
        of = np.flatnonzero(size >= least)
        of = of[np.argsort(size[of], kind="stable")]
        found = {n: [] for n in names}
        for few in np.array_split(of, -(-len(of) * grid // STACK) or 1):
            if len(few):
                a, b, c = (padded(values[k], starts[few], ends[few]) for k in (f, re, im))
                inside = np.arange(a.shape[1]) < size[few, None]
                one = stack(np.where(inside, 2 * np.pi * a, 1.0), b + 1j * c, inside, a, {k: values[k][starts[few]].astype(float) for k in others})
                for n in names:
                    found[n].append(one[n])
        return of, {n: np.concatenate(v) if v else np.empty(0, object if types.get(n) == "string" else float) for n, v in found.items()}

    return together(known, [key], [f], many, ", ".join(f"{n} {types.get(n, 'double')}" for n in names))


def _flat(columns: np.ndarray) -> np.ndarray:
    return np.concatenate([columns.real, columns.imag], axis=-1)


def _fitted(w: np.ndarray, z: np.ndarray, inside: np.ndarray, parts: Callable, ranges: np.ndarray, signed: Sequence[bool], ordered: int, points: int, rounds: int):
    """Fits of complex columns to many spectra: constants, coefficients, root mean squares."""
    mask = np.concatenate([inside, inside], axis=1)
    design = lambda of, *at: [np.where(mask[of], _flat(c), 0.0) for c in parts(of, *at)]
    return kernels.searched_each(design, np.where(mask, _flat(z), 0.0), mask.sum(axis=1), ranges, signed, ordered, points, rounds, inside=mask)


def _ranges(*pairs) -> np.ndarray:
    """Ranges (spectrum, constant, end) from ends that are numbers or one for each spectrum."""
    ends = np.broadcast_arrays(*[x for pair in pairs for x in pair])
    return np.stack(ends, axis=-1).reshape(len(ends[0]), len(pairs), 2)


def _ends(w: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time constants that the frequencies of each spectrum can tell."""
    return 1 / np.where(inside, w, -np.inf).max(axis=1) / 3, 3 / np.where(inside, w, np.inf).min(axis=1)


def series_resistance(spectra: DataFrame, key: str, f: str = "f", re: str = "re", im: str = "im", f_min: float = 100.0, least: int = 10) -> DataFrame:
    """Series resistance from the high end of each spectrum alone, where an arc and an inductance
    are all there is beside it: ``r0_hf``, its deviation, ``l_hf``, ``r1_hf``, ``tau1_hf``,
    ``alpha1_hf``, ``hf_rms``, ``hf_n``. Nulls where fewer than ``least`` points are there."""
    names = ["r0_hf", "r0_hf_sigma", "l_hf", "r1_hf", "tau1_hf", "alpha1_hf", "hf_rms", "hf_n"]

    def fitted(w, z, inside):
        low, high = _ends(w, inside)
        parts = lambda of, tau, alpha: [np.ones_like(w[of]) + 0j, 1j * w[of], kernels.zarc(w[of], tau, alpha)]
        at, x, rms = _fitted(w, z, inside, parts, _ranges((low, high), ALPHA), [False] * 3, 0, 7, 3)
        sigma = []
        for w_, (tau, alpha), c, r in zip((a[b] for a, b in zip(w, inside)), at, x, rms):
            arc = kernels.zarc(w_, tau, alpha)
            steps = [(kernels.zarc(w_, tau * 1.001, alpha) - arc) * c[2] / 0.001, (kernels.zarc(w_, tau, alpha * 0.999) - arc) * c[2] / -0.001]
            jac = np.column_stack([np.ones_like(w_) + 0j, 1j * w_, arc, *steps])
            jac = np.vstack([jac.real, jac.imag])
            spread = np.linalg.pinv(jac.T @ jac) * r**2 * len(jac) / max(len(jac) - 5, 1)
            sigma.append(np.sqrt(max(spread[0, 0], 0)))
        return x[:, 0], np.array(sigma), x[:, 1], x[:, 2], at[:, 0], at[:, 1], rms

    def stack(w, z, inside, f_, _):
        high = inside & (f_ >= f_min)
        n = high.sum(axis=1)
        found = {c: np.full(len(w), np.nan) for c in names[:-1]} | {"hf_n": n.astype("int32")}
        of = np.flatnonzero(n >= least)
        if len(of):
            for c, x in zip(names, fitted(w[of], z[of], high[of])):
                found[c][of] = x
        return found

    return _stacked(spectra, key, [f, re, im], 1, names, stack, {"hf_n": "int"})


def arcs(spectra: DataFrame, key: str, f: str = "f", re: str = "re", im: str = "im", n: int = 1, pinned: str | None = None, diffusion: bool = True, depressed: bool = True, least: int = 8) -> DataFrame:
    """``n`` arcs, an inductance and diffusion of free slope fitted to each spectrum: r0, l, r<k>,
    tau<k>, alpha<k>, r_d, phi_d, rms, and ``reason``, what of it stands at the end of its range
    (empty: nothing). ``pinned`` is a column with the series resistance; without ``depressed`` arcs
    are RC elements."""
    points = 5 if n == 1 else 4
    shape = [x for k in range(1, n + 1) for x in (f"r{k}", f"tau{k}", f"alpha{k}")]
    names = ["r0", "l", *shape, *(["r_d", "phi_d"] * diffusion), "rms", "reason"]

    def stack(w, z, inside, _, others):
        fixed = others[pinned] if pinned else np.full(len(w), np.nan)
        held = np.isfinite(fixed)
        low, high = _ends(w, inside)
        high = np.maximum(np.minimum(high, DIFFUSION * CLEAR), 2 * low) if diffusion else high
        ranges = _ranges(*[(low, high)] * n, *[ALPHA if depressed else (1.0, 1.0)] * n, *[PHI] * diffusion)

        def parts(of, *at):
            columns = [np.where(held[of, None], 0.0, np.ones_like(w[of])) + 0j, 1j * w[of], *(kernels.zarc(w[of], t, a) for t, a in zip(at[:n], at[n : 2 * n]))]
            return columns + ([kernels.diffusion(w[of], DIFFUSION, at[-1])] if diffusion else [])

        at, x, rms = _fitted(w, z - np.where(held, fixed, 0.0)[:, None], inside, parts, ranges, [False] * (2 + n + diffusion), n, points, 3)
        out = {"r0": np.where(held, fixed, x[:, 0]), "l": x[:, 1], "rms": rms} | ({"r_d": x[:, -1], "phi_d": at[:, -1]} if diffusion else {})
        said = []
        for k in range(n):
            out |= {f"r{k + 1}": x[:, 2 + k], f"tau{k + 1}": at[:, k], f"alpha{k + 1}": at[:, n + k]}
            said += [(f"r{k + 1}", x[:, 2 + k] <= 0), (f"tau{k + 1}", (at[:, k] < low * 1.02) | (at[:, k] > high * 0.98)), (f"alpha{k + 1}", depressed & (at[:, n + k] < ALPHA[0] * 1.01))]
        if n > 1:
            said.append(("tau", at[:, 1] < 1.05 * at[:, 0]))
        return out | {"reason": np.array([";".join(name for name, true in said if true[g]) for g in range(len(w))], object)}

    return _stacked(spectra, key, [f, re, im, *([pinned] if pinned else [])], least, names, stack, {"reason": "string"}, points ** (n * (1 + depressed) + diffusion))


def screened(spectra: DataFrame, key: str, f: str = "f", re: str = "re", im: str = "im", least: int = 12) -> DataFrame:
    """The points of each spectrum with their residual against what a linear, causal, stable system
    can have (``kk_resid``) and whether they are out of line; spectra of fewer points pass."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(f)
        residual, out = np.full(len(pdf), np.nan), np.zeros(len(pdf), bool)
        if len(pdf) >= least:
            residual, out = numeric.screened_kk(pdf[f].to_numpy(float), pdf[re].to_numpy(float) + 1j * pdf[im].to_numpy(float))
        return pdf.assign(kk_resid=residual, kk_outlier=out)

    fields = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in spectra.select(key, f, re, im).schema.fields)
    return dealt(spectra.select(key, f, re, im), [key]).groupBy(key).applyInPandas(run, f"{fields}, kk_resid double, kk_outlier boolean")


def spectrum_table(spectra: DataFrame, key: str, f: str = "f", re: str = "re", im: str = "im", n: int = 1, f_min: float = 100.0, least: int = 4) -> DataFrame:
    """One row per spectrum: points out of line, what can be read without a fit, the series
    resistance of the high end, and the arcs with that held. Points out of line are left out of all
    of it, unless fewer than ``least`` would be left."""
    points = kept(screened(spectra, key, f, re, im), "screened")  # read five times, as the high end is twice
    whole = Window.partitionBy(key)
    left = F.count(F.when(~F.col("kk_outlier"), 1)).over(whole)
    clean = points.withColumn("_kept", left).where(~F.col("kk_outlier") | (F.col("_kept") < least)).drop("_kept")
    totals = points.groupBy(key).agg(F.count("*").alias("kk_n"), F.sum(F.col("kk_outlier").cast("int")).alias("kk_out"), F.max("kk_resid").alias("kk_worst"))
    features = impedance.fit_free(clean, [key], f, re, im)
    high = kept(series_resistance(clean, key, f, re, im, f_min), "high-end")
    fitted = arcs(clean.join(high.select(key, "r0_hf"), key), key, f, re, im, n, pinned="r0_hf")
    return totals.join(features, key, "left").join(high, key, "left").join(fitted, key, "left")


def relaxation_peaks(spectra: DataFrame, key: str, f: str = "f", re: str = "re", im: str = "im", weights: Sequence[float] | None = None, least: int = 6) -> DataFrame:
    """Peaks of the distribution of relaxation times: key, tau, height, width (in decades), the
    penalty. With ``weights`` the penalty is that at the corner of the curve over them."""
    names = ["tau", "height", "width", "penalty"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(f)
        if len(pdf) < least:
            return pd.DataFrame(columns=[key, *names])
        freq, z = pdf[f].to_numpy(float), pdf[re].to_numpy(float) + 1j * pdf[im].to_numpy(float)
        weight = numeric.corner(freq, z, np.array(weights)) if weights else 1e-3
        tau, g, _, _ = numeric.relaxation_times(freq, z, weight)
        at = numeric.peaks(g)
        width = numeric.widths(g, at) * (np.log10(tau[1]) - np.log10(tau[0]))
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(at), "tau": tau[at], "height": g[at], "width": width, "penalty": weight})

    kind = spectra.schema[key].dataType.simpleString()
    return dealt(spectra.select(key, f, re, im), [key]).groupBy(key).applyInPandas(run, f"{key} {kind}, tau double, height double, width double, penalty double")


def labelled_peaks(peaks: DataFrame, states: DataFrame, key: str, edges: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Peaks with the state of charge of their spectrum and the name of the range of times that they
    are in; those beyond the edges take the first or the last."""
    place = F.lit(names[-1])
    for edge, name in reversed(list(zip(edges, names))):
        place = F.when(F.col("tau") < edge, name).otherwise(place)
    return peaks.join(states, key, "left").withColumn("process", place)


def branch_vote(peaks: DataFrame, keys: Sequence[str], spectrum: str, low: float, high: float, share: float = 0.25) -> DataFrame:
    """How many arcs to fit to all spectra of a group: the mean, over those with any, of how many
    peaks are in the box of times and not under a share of the tallest there; one or two."""
    box = peaks.where(F.col("tau").between(low, high))
    tallest = box.groupBy(*keys, spectrum).agg(F.max("height").alias("_top"))
    count = box.join(tallest, [*keys, spectrum]).where(F.col("height") >= share * F.col("_top")).groupBy(*keys, spectrum).agg(F.count("*").alias("_n"))
    return count.groupBy(*keys).agg(F.least(F.greatest(F.bround(F.avg("_n")), F.lit(1.0)), F.lit(2.0)).cast("int").alias("branches"))


def reasons(fits: DataFrame, column: str = "reason") -> DataFrame:
    """How often each set of reasons is there."""
    return fits.groupBy(column).agg(F.count("*").alias("n"))


def decade_table(elements: DataFrame, keys: Sequence[str], tau: Column, r: str, edges: Sequence[float]) -> DataFrame:
    """Of elements (tau, resistance) the sum in each decade of times, and over all (``r_pulse``), up
    to a second (``r_fast``) and beyond (``r_slow``)."""
    from voltaspan.operators.rules import place_among

    rows = elements.withColumns({"_tau": tau, "decade": place_among(tau, edges)})
    per = rows.groupBy(*keys, "decade").agg(F.sum(r).alias("r"), F.max(r).alias("largest"))
    whole = rows.groupBy(*keys).agg(F.sum(r).alias("r_pulse"), F.coalesce(F.sum(F.when(F.col("_tau") <= 1, F.col(r))), F.lit(0.0)).alias("r_fast"), F.coalesce(F.sum(F.when(F.col("_tau") > 1, F.col(r))), F.lit(0.0)).alias("r_slow"))
    return per.join(whole, list(keys))
