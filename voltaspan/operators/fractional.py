"""Pulses as chains of fractional elements (depressed arcs), found one after another.

At the end of a rest only the slowest process still shows. It is fitted there and taken off; the
window opens backwards by a step in the logarithm of time, and the next element is fitted to what is
left, as long as what is left stands out. So the data decide how many elements there are. Then the
series resistance, one for all pulses of a group, is fitted over pulses and rests with each pulse's
fastest element, and last all elements of a pulse are refined at once over its rest.

Rows and tables of pulses are those of ``operators.pulses``; rows need the current ``i`` too.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltaspan.functions import kernels
from voltaspan.functions.numeric import levenberg_marquardt
from voltaspan.operators.coupled import shared_value
from voltaspan.operators.groups import dealt
from voltaspan.sources.shared import kept

# Fixed values of the method: shares of the rest's fall that open the first window and that call for
# an element, with their floors in volts and in noise; sections; ranges of an element.
FIRST_SHARE, FIRST_LEAST, FIRST_NOISE = 1 / 20, 2e-4, 5.0
NEXT_SHARE, NEXT_LEAST, NEXT_NOISE = 1 / 200, 1e-4, 3.0
SECTIONS, LEAST_OHM, LEAST_NOISE = 8, 2e-4, 5e-5
TAU, ALPHA = (0.05, 2e4), (0.30, 0.999)
PARAMETERS = 3


def noise(v: np.ndarray, tail: int = 200) -> float:
    """Of the last samples: what second differences leave of a slow curve."""
    if len(v) < 8:
        return LEAST_NOISE
    return float(max(np.std(np.diff(v[-tail:], 2)) / np.sqrt(6), LEAST_NOISE))


def _smooth(x: np.ndarray, width: int = 15) -> np.ndarray:
    """Medians around each sample; the ends are mirrored."""
    if len(x) < width:
        return np.full(len(x), np.median(x)) if len(x) else x
    half = width // 2
    return np.median(np.lib.stride_tricks.sliding_window_view(np.pad(x, half, mode="reflect"), width), axis=1)


def ramp(t: np.ndarray, i: np.ndarray, before: float, after: float) -> np.ndarray:
    """The voltage at rest, moving with the charge that has flowed."""
    flowed = np.concatenate([[0.0], np.cumsum(np.abs(i[1:] + i[:-1]) / 2 * np.diff(t))])
    return before + (after - before) * (flowed / flowed[-1] if flowed[-1] > 0 else 0.0)


def _response(t, i_p, t_p, tau, alpha):
    """Of an element of one ohm; alpha 0 stands for finite diffusion."""
    return kernels.warburg_pulse(t, i_p, t_p, tau) if alpha == 0 else kernels.fractional_pulse(t, i_p, t_p, tau, alpha)


def overvoltage(t: np.ndarray, i_p: float, t_p: float, elements: Sequence[tuple[float, float, float]]) -> np.ndarray:
    """Of elements (ohm, constant, exponent) together."""
    return sum((r * _response(t, i_p, t_p, tau, alpha) for r, tau, alpha in elements), np.zeros(len(t)))


def binned(x: np.ndarray, y: np.ndarray, per_decade: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means of times and values over narrow steps of the logarithm, and roots of how many they are
    of: late samples are many, and a rest keeps its shape in a few hundred of these."""
    at = np.floor(np.log10(np.maximum(x, 1e-9)) * per_decade)
    _, of, n = np.unique(at, return_inverse=True, return_counts=True)
    return np.bincount(of, x) / n, np.bincount(of, y) / n, np.sqrt(n)


class Rest:
    """The rest after a pulse in narrow steps: ``x`` since the pulse began, ``y`` over the voltage at
    its end, ``w`` weights."""

    def __init__(self, t: np.ndarray, v: np.ndarray, t_p: float, i_p: float, post: float | None = None):
        rest = t > t_p
        self.t_p, self.i_p, self.n = t_p, i_p, int(rest.sum())
        self.post = post if post is not None else float(np.median(v[rest][-15:])) if self.n else float(v[-1])
        self.sigma = noise(v[rest])
        since, self.y, self.w = binned(t[rest] - t_p, v[rest] - self.post)
        self.x = since + t_p
        self.known: dict = {}

    def column(self, tau: float, alpha: float) -> np.ndarray:
        if (tau, alpha) not in self.known:
            if len(self.known) > 4096:
                self.known.clear()
            self.known[tau, alpha] = _response(self.x, self.i_p, self.t_p, tau, alpha)
        return self.known[tau, alpha]

    @property
    def limits(self) -> tuple[float, float]:
        """What opens the first window, and what calls for one more element."""
        fall = abs(self.y[0]) if self.n else 0.0
        return max(FIRST_LEAST, FIRST_NOISE * self.sigma, FIRST_SHARE * fall), max(NEXT_LEAST, NEXT_NOISE * self.sigma, NEXT_SHARE * fall)

    def solved(self, shapes: Sequence[tuple[float, float]]) -> tuple[np.ndarray, np.ndarray]:
        """Resistances of elements (constant, exponent), then how far the rest's end is off from
        where it would settle, up or down, by no more than calls for an element; and weighted
        residuals."""
        one = np.ones(len(self.x))
        a = self.w[:, None] * np.column_stack([*(self.column(*s) for s in shapes), one, -one])
        most = np.array([np.inf] * len(shapes) + [self.limits[1]] * 2)
        c, _ = kernels.solved(a, self.w * self.y, np.zeros(a.shape[1], bool), most)
        return c, a @ c - self.w * self.y

    def squares(self, elements: Sequence[tuple[float, float, float]]) -> float:
        """Of the residuals of elements at their best resistances."""
        r = self.solved([e[1:] for e in elements])[1]
        return float(r @ r)


def decomposed(rest: Rest, diffusion: bool = False) -> list[tuple[float, float, float]]:
    """Elements from the slowest to the fastest, fitted to the rest alone. With ``diffusion`` the
    slowest one is finite diffusion. A rest of under 20 samples has none."""
    if rest.n < 20:
        return []
    elements, left, sigma, (first, call) = [], rest.y, rest.sigma, rest.limits
    small = np.flatnonzero(_smooth(np.abs(left)) < first)
    opens = max(int(small[0]) - 1, 0) if len(small) else 0
    since = rest.x - rest.t_p
    starts = np.unique(np.searchsorted(since, np.geomspace(since[opens], since[0], SECTIONS)))[::-1]
    for start in starts:
        if len(left) - start < 8 or abs(np.median(left[start : start + 3])) < (call if elements or start != starts[0] else sigma):
            continue
        slowest, of = diffusion and not elements, slice(start, None)
        fastest = elements[-1][1] if elements else TAU[1]
        if fastest <= TAU[0] * 1.01:
            break
        w = rest.w[of]
        (tau, *alpha), (r,), _ = kernels.searched(lambda tau, *alpha: (w * rest.column(tau, *(alpha or [0.0]))[of])[:, None], w * left[of], [(TAU[0], fastest)] + ([] if slowest else [ALPHA]), [False], ordered=1)
        element = (float(r), float(tau), float(alpha[0]) if alpha else 0.0)
        after = left - r * rest.column(*element[1:])
        gain = np.sum((w * left[of]) ** 2) - np.sum((w * after[of]) ** 2)
        if r >= LEAST_OHM and gain > PARAMETERS * np.log(rest.n) * sigma**2:  # more than its parameters find in noise
            elements.append(element)
            left = after
    return elements


def refined(rest: Rest, elements: list, steps: int = 30) -> tuple[list, float]:
    """All elements of a pulse at once over its rest, resistances solved for at every step, and how
    far the rest's end is off. Constants move only if that lessens the residual."""
    if not elements or not rest.n:
        return elements, 0.0
    free = [k for k, e in enumerate(elements) if e[2]]

    def shapes(p):
        alpha = np.zeros(len(elements))
        alpha[free] = p[len(elements) :]
        return list(zip(np.exp(p[: len(elements)]).tolist(), alpha.tolist()))

    low = np.array([np.log(TAU[0])] * len(elements) + [ALPHA[0]] * len(free))
    high = np.array([np.log(TAU[1])] * len(elements) + [ALPHA[1]] * len(free))
    start = np.array([np.log(e[1]) for e in elements] + [elements[k][2] for k in free])
    scale = max(float(np.abs(rest.w * rest.y).max()), 1e-12)
    p, _ = levenberg_marquardt(lambda p: rest.solved(shapes(p))[1] / scale, start, low, high, steps)
    c, _ = rest.solved(shapes(p))
    found = sorted(((float(r), *e) for r, e in zip(c, shapes(p))), key=lambda e: -e[1])
    return found, float(c[-2] - c[-1])


def chosen(rest: Rest, elements: list) -> tuple[list, float]:
    """As many elements as stand out of the noise, and no more.

    One more is tried at times through the rest; and of two neighbours one is made, or one goes. All
    are refined each time. The best of these stays if the residual falls by more (rises by no more)
    than the parameters won (saved) would find in noise.
    """
    worth = PARAMETERS * np.log(max(rest.n, 2)) * rest.sigma**2
    now = refined(rest, elements)[0]
    best = lambda sets: min((refined(rest, e)[0] for e in sets), key=rest.squares)
    while elements and len(now) < SECTIONS:
        times = np.geomspace(max(rest.x[0] - rest.t_p, TAU[0]), rest.x[-1] - rest.t_p, 5)
        more = best([sorted([*now, (0.0, float(tau), 0.9)], key=lambda e: -e[1]) for tau in times])
        if rest.squares(now) - rest.squares(more) <= worth:
            break
        now = more
    while len(now) > 1:
        fewer = [now[:k] + now[k + 1 :] for k in range(len(now)) if now[k][2]]
        for k, (a, b) in enumerate(zip(now, now[1:])):
            if b[2] and a[2]:
                share = a[0] / max(a[0] + b[0], 1e-300)
                fewer.append([*now[:k], (a[0] + b[0], float(a[1] ** share * b[1] ** (1 - share)), max(min(a[2], b[2]) - 0.1, ALPHA[0])), *now[k + 2 :]])
        less = best(fewer)
        if rest.squares(less) - rest.squares(now) > worth:
            break
        now = less
    return refined(rest, [e for e in now if e[0] >= LEAST_OHM])


def with_resistance(row: dict, value: float, own: list[float] | None):
    """One pulse and its rest at a given series resistance: the fastest element is fitted anew, from
    where it was. Residual, and its derivatives by the resistance and by the element."""
    t, v, i = (np.array(row[c], float) for c in ("t", "v", "i"))
    elements = list(zip(row["r"], row["tau"], row["alpha"]))
    base = ramp(t, i, row["v_pre"], row["ocv_post"]) + overvoltage(t, row["i_p"], row["t_p"], elements[:-1])
    y = v - base - i * value
    if not elements:
        return (-y, i, np.empty((len(t), 0))), []
    r, tau, alpha = elements[-1] if own is None else own
    fixed = alpha == 0  # finite diffusion has no exponent
    at = np.array([np.log(tau)] if fixed else [np.log(tau), alpha])
    low, high = np.array([np.log(TAU[0]), ALPHA[0]])[: len(at)], np.array([np.log(TAU[1]), ALPHA[1]])[: len(at)]
    unit = lambda p: _response(t, row["i_p"], row["t_p"], np.exp(p[0]), 0.0 if fixed else p[1])
    scale = max(float(np.abs(y).max()), 1e-12)

    def residual(p):
        a = unit(p)[:, None]
        return (a @ kernels.solved(a, y, np.zeros(1, bool))[0] - y) / scale

    p, _ = levenberg_marquardt(residual, at, low, high, 40)
    a = unit(p)
    r = float(kernels.solved(a[:, None], y, np.zeros(1, bool))[0][0])
    by_own = [a] if r > 0 else []
    for k in range(len(p)):
        if r > 0 and low[k] < p[k] < high[k]:  # what stands at its bound gives no way
            h = 1e-5
            ahead, back = p.copy(), p.copy()
            ahead[k], back[k] = min(p[k] + h, high[k]), max(p[k] - h, low[k])
            by_own.append(r * (unit(ahead) - unit(back)) / (ahead[k] - back[k]))
    own = [r, float(np.exp(p[0])), 0.0 if fixed else float(p[1])]
    return (r * a - y, i, np.column_stack(by_own) if by_own else np.empty((len(t), 0))), own


def _types(df: DataFrame, names: Sequence[str]) -> str:
    of = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"`{n}` {of[n]}" for n in names)


def _packed(rows: DataFrame, pulses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per pulse, its samples as arrays in order; samples without time, voltage or current
    are left out."""
    whole = rows.where("t is not null and v is not null and i is not null and t >= 0").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*(F.col(c).cast("double").alias(c) for c in "tvi")))).alias("s"))
    return whole.select(*keys, *(F.col(f"s.{c}").alias(c) for c in "tvi")).join(pulses.select(*keys, *(F.col(c).cast("double").alias(c) for c in ("t_p", "i_p", "v_pre"))), list(keys))


def prepared(rows: DataFrame, pulses: DataFrame, keys: Sequence[str], diffusion: bool = False) -> DataFrame:
    """One row per pulse with its samples (t, v, i), ``ocv_post``, ``noise`` and the elements found
    one after another: ``r``, ``tau``, ``alpha``, the slowest first. Pulses of under 8 samples, without
    current, length or voltage before are left out."""
    names = [*keys, "t", "v", "i", "t_p", "i_p", "v_pre"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                t, v, i = (np.array(row[c], float) for c in "tvi")
                rest = Rest(t, v, row["t_p"], row["i_p"])
                elements, off = chosen(rest, decomposed(rest, diffusion))
                out.append((*(row[n] for n in names), rest.post + off, rest.sigma, *([list(x) for x in zip(*elements)] or [[], [], []])))
            yield pd.DataFrame(out, columns=[*names, "ocv_post", "noise", "r", "tau", "alpha"])

    of = _packed(rows, pulses, keys).where("size(t) >= 8 and t_p > 0 and i_p != 0 and v_pre is not null").select(names)
    return dealt(of, keys).mapInPandas(run, _types(of, names) + ", ocv_post double, noise double, r array<double>, tau array<double>, alpha array<double>")


def series_resistance(found: DataFrame, group: Sequence[str], rounds: int = 12) -> tuple[DataFrame, DataFrame]:
    """One series resistance for all prepared pulses of a group (group, ``value``), and the pulses
    with their fastest element (``own``) at it. The mean of the steps at the start of the currents
    is where the search begins."""
    step = F.try_divide(F.col("v")[1] - F.col("v_pre"), F.col("i_p"))
    start = found.groupBy(*group).agg(F.coalesce(F.greatest(F.avg(step), F.lit(0.0)), F.lit(0.0)).alias("value"))
    return shared_value(found, group, start, with_resistance, rounds=rounds)


_NAMES = ("r_s", "ocv_post", "noise", "rms_sequential", "rms", "r_total")


def chain(rows: DataFrame, pulses: DataFrame, keys: Sequence[str], group: Sequence[str], diffusion: bool = False) -> DataFrame:
    """The whole of it: keys, ``r_s`` (one for each group), ``ocv_post``, ``noise``, residuals of the
    rest before and after all elements are refined at once, ``r_total``, and the elements' ``r``,
    ``tau``, ``alpha``, the slowest first (alpha 0: finite diffusion). ``group`` is some of the keys."""
    _, at = series_resistance(kept(prepared(rows, pulses, keys, diffusion), "prepared"), group)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                t, v = np.array(row["t"], float), np.array(row["v"], float)
                elements = list(zip(row["r"], row["tau"], row["alpha"]))
                if elements:
                    elements[-1] = tuple(row["own"])
                rest = Rest(t, v, row["t_p"], row["i_p"], row["ocv_post"])
                last, off = refined(rest, elements)
                after = t > row["t_p"]
                rms = [
                    float(np.sqrt(np.mean((v[after] - post - overvoltage(t[after], row["i_p"], row["t_p"], e)) ** 2))) if rest.n else np.nan
                    for e, post in ((elements, rest.post), (last, rest.post + off))
                ]
                elements, post = (last, rest.post + off) if rms[1] < rms[0] else (elements, rest.post)
                numbers = (row["value"], post, row["noise"], rms[0], min(rms), row["value"] + sum(e[0] for e in elements))
                out.append((*(row[k] for k in keys), *numbers, *([list(x) for x in zip(*elements)] or [[], [], []])))
            yield pd.DataFrame(out, columns=[*keys, *_NAMES, "r", "tau", "alpha"])

    return dealt(at, keys).mapInPandas(run, _types(at, keys) + ", " + ", ".join(f"{n} double" for n in _NAMES) + ", r array<double>, tau array<double>, alpha array<double>")


def exploded(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row per element: keys, ``element`` (from 1, the slowest), r, tau, alpha."""
    at: Column = F.arrays_zip("r", "tau", "alpha")
    return found.select(*keys, F.posexplode(at).alias("k", "e")).select(*keys, (F.col("k") + 1).alias("element"), "e.r", "e.tau", "e.alpha")
