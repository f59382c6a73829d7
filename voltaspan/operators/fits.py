"""Fits of one small group at a time, as grouped maps: spectra and relaxations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltaspan.functions import numeric
from voltaspan.operators.groups import curves, dealt, padded, together

#: So many groups are fitted at once.
STACK = 512


def drt(spectra: DataFrame, key: str, f: str, re: str, im: str, least: int = 6) -> DataFrame:
    """Per spectrum of ``least`` points or more: series resistance, polarisation, number of peaks,
    time of the highest, residual. Spectra are reduced to one row per frequency before."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(f)
        if len(pdf) < least:
            return pd.DataFrame(columns=["key", "r_s", "r_pol", "n_peaks", "tau_peak", "rms"])
        freq, z = pdf[f].to_numpy(float), pdf[re].to_numpy(float) + 1j * pdf[im].to_numpy(float)
        tau, g, r_s, inductance = numeric.relaxation_times(freq, z)
        w = 2 * np.pi * freq[:, None]
        fit = r_s + 1j * w[:, 0] * inductance + (g / (1 + 1j * w * tau)).sum(axis=1)
        found = numeric.peaks(g)
        top = tau[found[np.argmax(g[found])]] if len(found) else np.nan
        return pd.DataFrame([(pdf[key].iloc[0], r_s, g.sum(), len(found), top, np.sqrt(np.mean(np.abs(z - fit) ** 2)))], columns=["key", "r_s", "r_pol", "n_peaks", "tau_peak", "rms"])

    return dealt(spectra.select(key, f, re, im), [key]).groupBy(key).applyInPandas(run, "key long, r_s double, r_pol double, n_peaks int, tau_peak double, rms double")


def kk_screen(spectra: DataFrame, key: str, f: str, re: str, im: str, least: int = 12) -> DataFrame:
    """Spectra with the relative residual of each point and whether it is an outlier; spectra of
    fewer points pass unscreened."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(f)
        if len(pdf) < least:
            residual, out = np.full(len(pdf), np.nan), np.zeros(len(pdf), bool)
        else:
            residual = numeric.linear_kk(pdf[f].to_numpy(float), pdf[re].to_numpy(float) + 1j * pdf[im].to_numpy(float))
            out = numeric.outliers(residual)
        return pd.DataFrame({"key": pdf[key], "f": pdf[f].astype(float), "kk_resid": residual, "kk_outlier": out})

    return dealt(spectra.select(key, f, re, im), [key]).groupBy(key).applyInPandas(run, "key long, f double, kk_resid double, kk_outlier boolean")


def relaxations(rows: DataFrame, keys: list[str], time: str, value: str, least: int = 6) -> DataFrame:
    """Two exponentials fitted to each group of ``least`` rows or more with a time and a value; seconds
    from its start."""
    names = ["v0", "a1", "tau1", "a2", "tau2"]

    def many(columns: dict[str, np.ndarray], starts: np.ndarray):
        t, v = columns[time], columns[value].astype(float)
        ends = np.append(starts[1:], len(t))
        of = np.flatnonzero(ends - starts >= least)
        of = of[np.argsort((ends - starts)[of], kind="stable")]
        found = [(np.empty((0, 5)), np.empty(0))]
        for few in np.array_split(of, -(-len(of) // STACK) or 1):  # of like lengths
            if len(few):
                n = ends[few] - starts[few]
                since = (t - np.repeat(t[starts], ends - starts)) / 1e6
                found.append(numeric.two_rc_each(padded(since, starts[few], ends[few]), padded(v, starts[few], ends[few]), n))
        p, rms = (np.concatenate(x) for x in zip(*found))
        return of, {**{c: p[:, k] for k, c in enumerate(names)}, "rms": rms, "degenerate": p[:, 4] < 1.05 * p[:, 2]}

    known = rows.select(*keys, time, F.col(value).cast("double").alias(value)).where(F.col(time).isNotNull() & F.col(value).isNotNull() & ~F.isnan(value))
    return together(known, keys, [time], many, ", ".join([*(f"{c} double" for c in [*names, "rms"]), "degenerate boolean"]))


def differential(rows: DataFrame, keys: list[str], order: str, voltage: str, charge: str, window: int = 51) -> DataFrame:
    """dV/dQ of a sweep after smoothing, at its own points."""

    def one(v: np.ndarray, q: np.ndarray):
        if len(q) < 5 or not q[-1] > q[0]:
            return None
        grid = np.linspace(q[0], q[-1], len(q))
        return {"q": grid, "dvdq": numeric.smoothed(np.interp(grid, q, v), window, 3, 1, grid[1] - grid[0])}

    of = rows.select(*keys, order, *[F.col(c).cast("double").alias(c) for c in (voltage, charge)])
    return curves(of, keys, [order], [voltage, charge], one, ["q", "dvdq"])
