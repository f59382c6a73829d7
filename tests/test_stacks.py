"""Many groups fitted at once against each of them alone, and groups that come in pieces."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltaspan.functions import kernels, numeric
from voltaspan.operators import fits, pulses, spectra
from voltaspan.operators.groups import padded, together


def _made(rng, n):
    t = np.sort(rng.uniform(0, 1000, n))
    t[0] = 0
    return t, 3 + rng.uniform(0.5, 2) * np.exp(-t / rng.uniform(5, 40)) + rng.uniform(0.5, 2) * np.exp(-t / rng.uniform(200, 600)) + rng.normal(0, 1e-3, n)


def test_relaxations_at_once_are_those_one_by_one():
    rng = np.random.default_rng(5)
    groups = [_made(rng, n) for n in (20, 25, 31, 40, 40, 22)]
    ends = np.cumsum([len(t) for t, _ in groups])
    starts = ends - [len(t) for t, _ in groups]
    t, v = (padded(np.concatenate(x), starts, ends) for x in zip(*groups))
    p, rms = numeric.two_rc_each(t, v, ends - starts)
    for k, (a, b) in enumerate(groups):
        one, least = numeric.two_rc(a, b)
        assert abs(rms[k] - least) < 1e-6 * least and np.allclose(p[k], one, rtol=1e-3)


def test_relaxations_of_a_table_are_fitted_in_few_calls(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(None if k == 7 else k, 1, int(a * 1e6), float(b)) for k in range(40) for a, b in zip(*_made(rng, 24))]
    rows += [(3, 1, None, 1.0), (3, 1, 5, None), (99, 1, 0, 1.0)]
    df = spark.createDataFrame(rows, "cell long, week long, us long, v double")
    found = {r.cell: r for r in fits.relaxations(df, ["cell", "week"], "us", "v").collect()}
    assert len(found) == 40 and 99 not in found
    for k in (0, 3, None):
        of = sorted((us / 1e6, v) for c, _, us, v in rows if c == k and us is not None and v is not None)
        one, least = numeric.two_rc(*np.array(of).T)
        assert abs(found[k].rms - least) < 1e-6 * least and abs(found[k].tau2 - one[4]) < 1e-3 * one[4]
    monkeypatch.setattr(numeric, "two_rc", None)  # nothing is fitted alone
    assert fits.relaxations(df, ["cell", "week"], "us", "v").count() == 40


def test_groups_in_pieces_come_together(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(300).select((F.col("id") % 11).alias("k"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("j"), "id")

        def many(columns, starts):
            ends = np.append(starts[1:], len(columns["id"]))
            return np.arange(len(starts)), {"n": ends - starts, "first": columns["id"][starts], "last": columns["id"][ends - 1]}

        found = together(df, ["k", "j"], ["id"], many, "n long, first long, last long")
        wanted = df.groupBy("k", "j").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))
        assert found.exceptAll(wanted).count() == wanted.exceptAll(found).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_curves_of_many_groups_come_from_few_calls(spark, monkeypatch):
    from voltaspan.operators import groups, sweeps

    rng = np.random.default_rng(8)
    rows = [(k, float(v), float(q)) for k in range(60) for v, q in zip(rng.integers(0, 30, 40), rng.uniform(0, 5, 40))] + [(7, None, 1.0), (7, 3.0, float("nan")), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "cell long, v double, q double")
    found = sweeps.differential_capacity(df, ["cell"], "v", "q", 1.0, 0.5, 5).toPandas()
    for k in (0, 7, 59):
        v, q = np.array(sorted((v, q) for c, v, q in rows if c == k and v is not None and q == q)).T
        v, at = np.unique(v, return_index=True)
        grid = np.arange(v[0] + 0.5, v[-1] - 0.5, 1.0)
        on = numeric.smoothed(np.interp(grid, v, q[at]), 5)
        assert np.allclose(found[found.cell == k].sort_values("v")["dqdv"], np.gradient(on, 1.0))
    assert found.cell.nunique() == 60 and not found.cell.isna().any()
    assert sweeps.curves is groups.curves and fits.curves is groups.curves  # no group has a call of its own


def test_ends_take_the_polynomial_of_their_window():
    x = np.linspace(0, 2, 30)
    for derivative, want in ((0, x**3 - x), (1, 3 * x**2 - 1), (2, 6 * x)):
        assert np.allclose(numeric.smoothed(x**3 - x, 11, 3, derivative, x[1]), want)


@pytest.mark.parametrize("signed,most", [([True, True, True], None), ([False, False, False], [0.4, 1.5, 1.0])])
def test_searches_at_once_are_those_one_by_one(signed, most):
    rng = np.random.default_rng(9)
    groups = [_made(rng, n) for n in (14, 20, 20, 33, 9)]
    ends = np.cumsum([len(t) for t, _ in groups])
    starts = ends - [len(t) for t, _ in groups]
    t, v = (padded(np.concatenate(x), starts, ends) for x in zip(*groups))
    inside, ranges = np.arange(t.shape[1]) < (ends - starts)[:, None], [(0.2, 60.0), (20.0, 6000.0)]
    design = lambda of, a, b: [c * inside[of] for c in (np.ones_like(t[of]), np.exp(-t[of] / a), np.exp(-t[of] / b))]
    high = None if most is None else np.tile(most, (len(t), 1))
    at, x, rms = kernels.searched_each(design, v, ends - starts, np.tile(np.array(ranges), (len(t), 1, 1)), signed, most=high)
    for k, (a, b) in enumerate(groups):
        one = kernels.searched(lambda p, q: kernels.beside(np.ones_like(a), np.exp(-a / p), np.exp(-a / q)), b, ranges, signed, most=None if most is None else np.array(most), together=True)
        assert abs(rms[k] - one[2]) < 1e-6 * one[2] and np.allclose(x[k], one[1], rtol=1e-3, atol=1e-6) and np.allclose(at[k], one[0], rtol=1e-3)


def test_columns_that_depend_are_solved_alone():
    y = np.array([[1.0, 2, 3, 0], [1, 1, 2, 4]])
    columns = [np.ones((2, 4)), np.array([[1.0, 1, 1, 1], [0, 1, 2, 3]]), np.zeros((2, 4))]
    x, r = kernels.solved_each(columns, y, np.array([True] * 3), np.full((2, 3), np.inf))
    for k in range(2):
        one, rms = kernels.solved(np.column_stack([c[k] for c in columns]), y[k], np.array([True] * 3))
        assert np.allclose(x[k], one) and abs(np.sqrt(np.mean(r[k] ** 2)) - rms) < 1e-12


def test_what_cannot_be_fitted_is_null(spark):
    rows = spark.createDataFrame([(1, float(k), 3.0 + k) for k in range(9)], "id long, t double, v double")
    table = spark.createDataFrame([(1, 20.0, 2.0, 3.0, 0.01)], "id long, t_p double, i_p double, v_pre double, r0 double")
    assert pulses.extrapolated(rows, table, ["id"]).first().r0_termination is None
    assert pulses.staged(rows, table, ["id"]).first().asDict() == {"id": 1} | dict.fromkeys(pulses._STAGED)


def _spectra(many, rng):
    w = 2 * np.pi * np.arange(1, 31.0)
    return w, np.array([0.01 + rng.uniform(0.01, 0.03) * kernels.zarc(w, rng.uniform(0.005, 0.05), 1.0) + rng.normal(0, 1e-4, 30) + 1j * rng.normal(0, 1e-4, 30) for _ in range(many)])


def test_elements_that_vanish_come_out_as_one_by_one():
    w, z = _spectra(12, np.random.default_rng(4))  # one arc each, so a second has often nothing
    flat = lambda c: np.concatenate([c.real, c.imag], axis=-1)
    columns = lambda of, a, b: [flat(c) + 0 * a for c in (np.ones_like(w) + 0j, 1j * w, kernels.zarc(w, a, 1.0), kernels.zarc(w, b, 1.0))]
    ranges, signed = [(0.002, 0.4), (0.002, 0.4)], [False] * 4
    at, x, rms = kernels.searched_each(columns, flat(z), np.full(12, 60), np.tile(np.array(ranges), (12, 1, 1)), signed, 2, 4, 3, inside=np.ones((12, 60), bool))
    for k in range(12):
        one = kernels.searched(lambda a, b: np.stack(np.broadcast_arrays(*columns(0, a, b)), axis=-1), flat(z[k]), ranges, signed, 2, 4, 3, together=True)
        assert abs(rms[k] - one[2]) < 1e-6 * one[2] and np.allclose(x[k], one[1], rtol=1e-3, atol=1e-5)


@pytest.mark.parametrize("fit", [lambda s: spectra.arcs(s, "eis", n=2, diffusion=False, depressed=False), lambda s: spectra.arcs(s, "eis"), lambda s: spectra.series_resistance(s, "eis", f_min=5.0)])
def test_spectra_of_a_task_are_fitted_in_one_call(spark, monkeypatch, fit):
    w, z = _spectra(40, np.random.default_rng(5))
    tasks, calls = [], []
    monkeypatch.setattr(spectra, "together", lambda rows, keys, order, many, schema: tasks.append(many))
    fit(spark.createDataFrame([(1, 1.0, 1.0, 1.0)], "eis long, f double, re double, im double"))
    each = kernels.searched_each
    monkeypatch.setattr(kernels, "searched", None)
    monkeypatch.setattr(kernels, "searched_each", lambda *a, **k: calls.append(0) or each(*a, **k))
    of, found = tasks[0]({"f": np.tile(w / 2 / np.pi, 40), "re": z.real.ravel(), "im": z.imag.ravel()}, np.arange(40) * 30)
    assert len(calls) == 1 and len(of) == 40 and all(len(x) == 40 for x in found.values())


def test_grids_with_elements_that_depend_are_solved_together(monkeypatch):
    """Of pulses that are noise elements vanish or depend on each other at most points of a grid."""
    rng, many = np.random.default_rng(9), 48
    t = np.sort(rng.uniform(0, 160, (many, 16)), axis=1)
    t[:, 0] = 0
    p = {"t_p": t[:, -1:] / 2, "i_p": rng.uniform(20, 90, (many, 1)), "v_pre": rng.uniform(5, 90, (many, 1)), "r0": np.full((many, 1), 0.01)}
    v, inside = rng.exponential(50, t.shape), np.ones(t.shape, bool)
    alone, rows, solved, warburg = [], [], kernels.solved, kernels.warburg_pulse
    monkeypatch.setattr(kernels, "solved", lambda *a: alone.append(0) or solved(*a))
    monkeypatch.setattr(kernels, "warburg_pulse", lambda t, *a: rows.append(len(t)) or warburg(t, *a))
    whole = pulses._joint(t, v, inside, p, True)
    assert len(alone) < 8 * many and sum(rows[:3]) == 3 * 5 * many  # five constants a pulse and grid
    monkeypatch.setattr(kernels, "BLOCK", 1)
    apart = pulses._joint(t, v, inside, p, True)
    assert all(np.array_equal(whole[c], apart[c]) for c in whole)
    for k in range(many):
        share, i_p, t_p = np.clip(t[k] / p["t_p"][k], 0, 1), *(p[c][k] for c in ("i_p", "t_p"))
        y = v[k] - p["v_pre"][k] * (1 - share) - np.where(t[k] <= t_p, i_p * 0.01, 0)
        design = lambda a, b, w: np.column_stack([share, kernels.rc_pulse(t[k], i_p, t_p, a), kernels.rc_pulse(t[k], i_p, t_p, b), warburg(t[k], i_p, t_p, w)])  # noqa: B023, E731
        *_, rms = kernels.searched(design, y, [pulses.FAST, pulses.SLOW, (1.0, 6000.0)], [True, False, False, False], points=5)
        assert whole["rms"][k] == pytest.approx(rms, rel=1e-3)


def test_finite_diffusion_is_a_series_of_elements():
    t = np.linspace(0, 100, 301)
    for length, tau in ((20.0, 300.0), (0.5, 1.0), (99.0, 6000.0)):
        series = np.zeros(len(t))
        for k in range(1, 21):
            odd = (2 * k - 1) ** 2 * np.pi**2
            series = series + 8 / odd * kernels.rc_pulse(t, -3.0, length, 4 * tau / odd)
        assert np.array_equal(kernels.warburg_pulse(t, -3.0, length, tau), series)
