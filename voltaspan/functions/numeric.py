"""Numerical kernels for one small group at a time: least squares, smoothing, clustering.

Groups are single spectra, pulses or the segments of one cell; Spark deals them out.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np


def levenberg_marquardt(residual: Callable[[np.ndarray], np.ndarray], start: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int = 100) -> tuple[np.ndarray, float]:
    """Parameters within bounds of least squared residuals, and the root mean square."""
    p = np.clip(start.astype(float), low, high)
    r, damping = residual(p), 1e-3
    for _ in range(steps):
        scale = np.maximum(np.abs(p), 1e-6)
        jac = np.empty((len(r), len(p)))
        for k in range(len(p)):
            h = 1e-6 * scale[k] * (1 if p[k] + 1e-6 * scale[k] <= high[k] else -1)
            q = p.copy()
            q[k] += h
            jac[:, k] = (residual(q) - r) / h
        gradient, curve = jac.T @ r, jac.T @ jac
        for _ in range(12):
            step = np.linalg.lstsq(curve + damping * np.diag(np.diag(curve) + 1e-12), -gradient, rcond=None)[0]
            q = np.clip(p + step, low, high)
            s = residual(q)
            if s @ s < r @ r:
                break
            damping *= 4
        else:
            break
        done = (r @ r - s @ s) <= 1e-12 * (r @ r)
        p, r, damping = q, s, max(damping / 5, 1e-12)
        if done:
            break
    return p, float(np.sqrt(np.mean(r**2)))


def _steps(curve: np.ndarray, gradient: np.ndarray) -> np.ndarray:
    """Solutions of many small symmetric systems, those of least norm where one has no single solution."""
    n = curve.shape[1]
    a, x, trace = curve.copy(), gradient.copy(), np.trace(curve, axis1=1, axis2=2)
    low = np.full(len(a), np.inf)
    with np.errstate(divide="ignore", invalid="ignore"):
        for k in range(n):
            low = np.minimum(low, a[:, k, k])
            for i in range(k + 1, n):
                f = a[:, i, k] / a[:, k, k]
                a[:, i, k:] -= f[:, None] * a[:, k, k:]
                x[:, i] -= f * x[:, k]
        for k in range(n - 1, -1, -1):
            x[:, k] = (x[:, k] - np.einsum("pn,pn->p", a[:, k, k + 1 :], x[:, k + 1 :])) / a[:, k, k]
    weak = np.flatnonzero(~(low > 1e-12 * trace) | ~np.isfinite(x).all(axis=1))
    if len(weak):
        size, axes = np.linalg.eigh(curve[weak])
        with np.errstate(divide="ignore"):
            parts = np.where(np.abs(size) > n * np.finfo(float).eps * np.abs(size).max(axis=1, keepdims=True), 1 / size, 0.0)
        x[weak] = np.einsum("pij,pj->pi", axes, parts * np.einsum("pji,pj->pi", axes, gradient[weak]))
    return x


def levenberg_marquardt_each(residual: Callable[[np.ndarray, np.ndarray], np.ndarray], start: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int = 100) -> np.ndarray:
    """``levenberg_marquardt`` of many groups at once, a row of parameters each: every group takes the
    steps that it would take alone. ``residual`` takes parameters and the numbers of their groups."""
    p = np.clip(start.astype(float), low, high)
    going = np.arange(len(p))
    r, damping = residual(p, going), np.full(len(p), 1e-3)
    sums = np.einsum("gm,gm->g", r, r)
    n = p.shape[1]
    for _ in range(steps):
        if not len(going):
            break
        now, here = p[going], r[going]
        h = 1e-6 * np.maximum(np.abs(now), 1e-6)
        h = np.where(now + h <= high[going], h, -h)
        jac = np.empty((n, *here.shape))
        for k in range(n):
            q = now.copy()
            q[:, k] += h[:, k]
            jac[k] = (residual(q, going) - here) / h[:, k : k + 1]
        gradient, curve = np.einsum("kgm,gm->gk", jac, here), np.einsum("kgm,lgm->gkl", jac, jac)
        size = np.einsum("gkk->gk", curve) + 1e-12
        left, taken, done = np.arange(len(going)), np.zeros(len(going), bool), np.zeros(len(going), bool)
        for _ in range(12):
            of = going[left]
            damped = curve[left].copy()
            damped[:, range(n), range(n)] += damping[of, None] * size[left]
            q = np.clip(p[of] + _steps(damped, -gradient[left]), low[of], high[of])
            s = residual(q, of)
            total = np.einsum("gm,gm->g", s, s)
            fine = total < sums[of]
            won = of[fine]
            taken[left[fine]] = True
            done[left[fine]] = sums[won] - total[fine] <= 1e-12 * sums[won]
            p[won], r[won], sums[won], damping[won] = q[fine], s[fine], total[fine], np.maximum(damping[won] / 5, 1e-12)
            damping[of[~fine]] *= 4
            left = left[~fine]
            if not len(left):
                break
        going = going[taken & ~done]
    return p


def nonnegative(a: np.ndarray, b: np.ndarray, steps: int = 300) -> np.ndarray:
    """x >= 0 of least ``|a x - b|``, by active sets."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    w = a.T @ b
    for _ in range(steps):
        if free.all() or w[~free].max(initial=-1) <= 1e-10 * max(1.0, np.abs(b).max()):
            break
        free[np.argmax(np.where(free, -np.inf, w))] = True
        while True:
            s = np.zeros(n)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if s[free].min(initial=1) > 0:
                break
            bad = free & (s <= 0)
            t = np.min(x[bad] / np.maximum(x[bad] - s[bad], 1e-300))
            x += t * (s - x)
            free &= x > 1e-12
        x = s
        w = a.T @ (b - a @ x)
    return x


@functools.lru_cache(64)
def _local(half: int, order: int) -> np.ndarray:
    return np.linalg.pinv(np.vander(np.arange(-half, half + 1), order + 1, increasing=True))


def smoothed(y: np.ndarray, window: int = 51, order: int = 3, derivative: int = 0, step: float = 1.0) -> np.ndarray:
    """Local polynomial smoothing; the ends take the polynomial of the first and last window."""
    window = min(window, len(y) - 1 + len(y) % 2)
    if window <= order:
        return y.astype(float) if not derivative else np.gradient(y, step)
    half = window // 2
    at = np.arange(-half, half + 1)
    basis = _local(half, order)
    factor = [1, 1, 2, 6][derivative] / step**derivative
    out = np.convolve(y, basis[derivative][::-1], "valid") * factor
    ends = []
    for part, where in ((y[:window], at[:half]), (y[-window:], at[half + 1 :])):
        c = basis @ part
        for _ in range(derivative):
            c = c[1:] * np.arange(1, len(c))
        ends.append(np.vander(where, len(c), increasing=True) @ c / step**derivative)
    return np.concatenate([ends[0], out, ends[1]])


def relaxation_times(f: np.ndarray, z: np.ndarray, weight: float = 1e-3, per_decade: int = 10) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Distribution of relaxation times of a spectrum: times, non-negative weights by a Tikhonov
    penalty, series resistance, inductance."""
    tau = np.logspace(np.log10(1 / (2 * np.pi * f.max())) - 0.5, np.log10(1 / (2 * np.pi * f.min())) + 0.5, max(4, int(per_decade * np.log10(f.max() / f.min()) + per_decade)))
    w = 2 * np.pi * f[:, None]
    kernel = 1 / (1 + 1j * w * tau)
    a = np.vstack([np.hstack([kernel.real, np.ones((len(f), 1)), np.zeros((len(f), 1))]), np.hstack([kernel.imag, np.zeros((len(f), 1)), w])])
    penalty = np.hstack([np.sqrt(weight) * np.eye(len(tau)), np.zeros((len(tau), 2))])
    x = nonnegative(np.vstack([a, penalty]), np.concatenate([z.real, z.imag, np.zeros(len(tau))]))
    return tau, x[:-2], float(x[-2]), float(x[-1])


def peaks(x: np.ndarray, least: float = 0.05) -> np.ndarray:
    """Places of local maxima of at least a share of the highest."""
    padded = np.concatenate([[-np.inf], x, [-np.inf]])
    return np.flatnonzero((padded[1:-1] > padded[:-2]) & (padded[1:-1] >= padded[2:]) & (x >= least * x.max(initial=0)) & (x > 0))


def linear_kk(f: np.ndarray, z: np.ndarray, per_decade: float = 5.0) -> np.ndarray:
    """Relative residual of each point against a sum of RC elements with fixed times: what a
    linear, stable and causal system can't have."""
    m = max(3, int(min(per_decade * np.log10(f.max() / f.min()), len(f) / 2)))
    tau = np.logspace(np.log10(1 / (2 * np.pi * f.max())) - 1, np.log10(1 / (2 * np.pi * f.min())) + 1, m)
    w = 2 * np.pi * f[:, None]
    kernel = np.hstack([np.ones((len(f), 1)), 1 / (1 + 1j * w * tau), 1j * w, 1 / (1j * w)])
    size = np.abs(z)
    size = np.where(size > 0, size, 1)
    a = np.vstack([kernel.real / size[:, None], kernel.imag / size[:, None]])
    x = np.linalg.lstsq(a, np.concatenate([z.real / size, z.imag / size]), rcond=None)[0]
    return np.abs(z - kernel @ x) / size


def screened_kk(f: np.ndarray, z: np.ndarray, rounds: int = 3, share: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Residuals, and points out of line: after each round the worst are left out of the next fit,
    ``share`` of all points at most."""
    out, residual = np.zeros(len(f), bool), np.full(len(f), np.nan)
    for _ in range(rounds):
        kept = ~out
        residual[kept] = linear_kk(f[kept], z[kept])
        left = int(share * len(f)) - int(out.sum())
        found = np.flatnonzero(kept)[outliers(residual[kept], 1.0)]
        found = found[np.argsort(-residual[found], kind="stable")][: max(left, 0)]
        if not len(found):
            break
        out[found] = True
    return residual, out


def corner(f: np.ndarray, z: np.ndarray, weights: np.ndarray) -> float:
    """The penalty at the corner of the curve of residual against size, both in logarithms: where it
    turns the most."""
    points = []
    for weight in weights:
        tau, g, r_s, inductance = relaxation_times(f, z, weight)
        w = 2 * np.pi * f[:, None]
        fit = r_s + 1j * w[:, 0] * inductance + (g / (1 + 1j * w * tau)).sum(axis=1)
        points.append((np.log(np.linalg.norm(z - fit) + 1e-300), np.log(np.linalg.norm(g) + 1e-300)))
    x, y = np.array(points).T
    dx, dy = np.gradient(x), np.gradient(y)
    bend = np.abs(dx * np.gradient(dy) - dy * np.gradient(dx)) / np.maximum(dx**2 + dy**2, 1e-30) ** 1.5
    return float(weights[1 + np.argmax(bend[1:-1])]) if len(weights) > 2 else float(weights[0])


def widths(x: np.ndarray, at: np.ndarray, share: float = 0.5) -> np.ndarray:
    """Width of each peak, in points, at a share of its height over its base: the higher of the
    lowest points between it and higher ground on either side."""
    out = np.zeros(len(at))
    for n, k in enumerate(at):
        bases = []
        for step in (-1, 1):
            low, j = x[k], k
            while 0 <= j + step < len(x) and x[j + step] <= x[k]:
                j += step
                low = min(low, x[j])
            bases.append(low)
        level, ends = x[k] - (x[k] - max(bases)) * share, []
        if level >= x[k]:  # at an end of the range: it stands over nothing
            continue
        for step in (-1, 1):
            j = k
            while 0 <= j + step < len(x) and x[j] > level:
                j += step
            inner = j - step
            ends.append(j if x[j] > level or x[inner] == x[j] else j - step * (level - x[j]) / (x[inner] - x[j]))
        out[n] = ends[1] - ends[0]
    return out


def outliers(residual: np.ndarray, share: float = 0.1) -> np.ndarray:
    """Points above 1 % and above the median by five scaled median deviations; a share at most."""
    middle = np.median(residual)
    limit = max(0.01, middle + 5 * 1.4826 * np.median(np.abs(residual - middle)))
    worst = np.argsort(-residual)[: int(share * len(residual))]
    out = np.zeros(len(residual), bool)
    out[worst] = residual[worst] > limit
    return out


def two_rc(t: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, float]:
    """v0, a1, tau1, a2, tau2 of ``v0 + a1 exp(-t/tau1) + a2 exp(-t/tau2)``, tau1 <= tau2, and the
    root mean square; of four starts the best."""
    span, size = max(t.max() - t.min(), 1e-9), max(np.ptp(v), 1e-9)
    low = np.array([v.min() - 10 * size, -10 * size, span / 1e4, -10 * size, span / 1e4])
    high = np.array([v.max() + 10 * size, 10 * size, 10 * span, 10 * size, 10 * span])
    model = lambda p: p[0] + p[1] * np.exp(-t / p[2]) + p[3] * np.exp(-t / p[4])
    fits = [levenberg_marquardt(lambda p: model(p) - v, np.array([v[-1], (v[0] - v[-1]) / 2, a * span, (v[0] - v[-1]) / 2, b * span]), low, high) for a, b in ((0.02, 0.3), (0.05, 0.5), (0.1, 1.0), (0.01, 0.1))]
    p, rms = min(fits, key=lambda x: x[1])
    return (p if p[2] <= p[4] else p[[0, 3, 4, 1, 2]]), rms


def two_rc_each(t: np.ndarray, v: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``two_rc`` of many groups at once: rows of times and values, of which the first ``n`` count."""
    inside = np.arange(t.shape[1]) < n[:, None]
    ends = lambda x: (np.where(inside, x, np.inf).min(axis=1), np.where(inside, x, -np.inf).max(axis=1))
    (t0, t1), (v0, v1) = ends(t), ends(v)
    span, size = np.maximum(t1 - t0, 1e-9), np.maximum(v1 - v0, 1e-9)
    first, last = v[:, 0], v[np.arange(len(v)), n - 1]
    low = np.column_stack([v0 - 10 * size, -10 * size, span / 1e4, -10 * size, span / 1e4])
    high = np.column_stack([v1 + 10 * size, 10 * size, 10 * span, 10 * size, 10 * span])

    starts = ((0.02, 0.3), (0.05, 0.5), (0.1, 1.0), (0.01, 0.1))
    many = len(t)

    def residual(p, at):
        of = at % many
        x = p[:, 0:1] + p[:, 1:2] * np.exp(-t[of] / p[:, 2:3]) + p[:, 3:4] * np.exp(-t[of] / p[:, 4:5]) - v[of]
        return np.where(inside[of], x, 0.0)

    every = np.concatenate([np.column_stack([last, (first - last) / 2, a * span, (first - last) / 2, b * span]) for a, b in starts])
    p = levenberg_marquardt_each(residual, every, np.tile(low, (len(starts), 1)), np.tile(high, (len(starts), 1)))
    rms = np.sqrt((residual(p, np.arange(len(p))) ** 2).sum(axis=1) / np.tile(n, len(starts))).reshape(len(starts), many)
    which = rms.argmin(axis=0)
    best, least = p.reshape(len(starts), many, 5)[which, np.arange(many)], rms[which, np.arange(many)]
    return np.where((best[:, 2] <= best[:, 4])[:, None], best, best[:, [0, 3, 4, 1, 2]]), least


def spanning_edges(x: np.ndarray, core: np.ndarray | None = None) -> np.ndarray:
    """Rows distance, a, b of a minimum spanning tree of points by mutual reachability (the greatest
    of a pair's distance and both core distances). Holds one row of distances at a time."""
    n = len(x)
    core = np.zeros(n) if core is None else core
    inside, near, parent = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int)
    at, edges = 0, np.empty((max(n - 1, 0), 3))
    for k in range(n - 1):
        inside[at] = True
        reach = np.maximum(np.sqrt(((x - x[at]) ** 2).sum(axis=1)), np.maximum(core, core[at]))
        closer = ~inside & (reach < near)
        near[closer], parent[closer] = reach[closer], at
        at = int(np.argmin(np.where(inside, np.inf, near)))
        edges[k] = near[at], parent[at], at
    return edges


def core_distances(x: np.ndarray, neighbours: int) -> np.ndarray:
    """Distance of each point to its so-manieth neighbour. One neighbour changes no reachability, as
    a pair's distance is never less."""
    if neighbours < 2 or not len(x):
        return np.zeros(len(x))
    return np.array([np.partition(np.sqrt(((x - p) ** 2).sum(axis=1)), min(neighbours, len(x) - 1))[min(neighbours, len(x) - 1)] for p in x])


def condensed_clusters(n: int, edges: np.ndarray, least: int = 5, epsilon: float = 0.0) -> np.ndarray:
    """Clusters from the edges of a spanning tree of ``n`` points, -1 for noise. The tree is condensed
    by size; of its branches those of greatest persistence are taken, and those that part below the
    distance ``epsilon`` go up to the branch that parts above it."""
    if n < 2 * least:
        return np.full(n, -1)
    edges = edges[np.lexsort((edges[:, 2], edges[:, 1], edges[:, 0]))]
    root, size = np.arange(2 * n - 1), np.ones(2 * n - 1, np.int64)
    up = np.full(2 * n - 1, -1)  # the merge that a component went into
    of: dict[int, int] = {}  # cluster of a component that is large enough
    clusters: list[dict] = []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for k, (distance, a, b) in enumerate(edges.tolist()):
        a, b, new = top(int(a)), top(int(b)), n + k
        rate = 1 / max(distance, 1e-12)
        for c in (a, b):  # what a cluster persists is its size over the rates it spans
            if c in of:
                one = clusters[of[c]]
                one["score"] += size[c] * (one["rate"] - rate)
                one["rate"] = rate
        root[a] = root[b] = up[a] = up[b] = new
        size[new] = size[a] + size[b]
        kids = [of[c] for c in (a, b) if c in of]
        if len(kids) == 1:
            of[new] = kids[0]
            clusters[kids[0]]["top"] = new
        elif kids or size[new] >= least:
            for kid in kids:
                clusters[kid]["parts"], clusters[kid]["up"] = distance, len(clusters)
            of[new] = len(clusters)
            clusters.append({"top": new, "rate": rate, "score": 0.0, "kids": kids, "parts": np.inf, "up": None})

    whole = of.get(2 * n - 2)
    if whole is None:
        return np.full(n, -1)
    best: list[tuple[float, list[int]]] = []
    for one in clusters:  # kids come before what they merge into
        below = sum(best[c][0] for c in one["kids"])
        keep = not one["kids"] or one["score"] >= below
        best.append((one["score"], [len(best)]) if keep else (below, [c for kid in one["kids"] for c in best[kid][1]]))
    kids = clusters[whole]["kids"]
    taken = [c for kid in kids for c in best[kid][1]] if kids else [whole]
    lifted = set()
    for k in taken:
        while clusters[k]["parts"] < epsilon and clusters[k]["up"] not in (None, whole):
            k = clusters[k]["up"]
        lifted.add(k)
    mark = np.full(2 * n - 1, -1)
    for k in lifted:
        mark[clusters[k]["top"]] = k
    for i in range(2 * n - 2, -1, -1):  # from the last merge down
        if mark[i] < 0 and up[i] >= 0:
            mark[i] = mark[up[i]]
    found = mark[:n]
    first = {k: i for i, k in reversed(list(enumerate(found.tolist()))) if k >= 0}
    labels = {k: i for i, k in enumerate(sorted(first, key=first.get))}
    return np.array([labels.get(k, -1) for k in found.tolist()])


def density_clusters(x: np.ndarray, least: int = 5, neighbours: int = 1, epsilon: float = 0.0) -> np.ndarray:
    """Clusters of varying density, -1 for noise: the tree of mutual reachability, condensed by size,
    of whose branches those of greatest persistence are taken."""
    return condensed_clusters(len(x), spanning_edges(x, core_distances(x, neighbours)), least, epsilon)
