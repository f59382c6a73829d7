"""The fractional chain and fits that share a parameter, against circuits whose values are known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltaspan.functions import kernels, numeric
from voltaspan.operators import coupled, fractional

SLOW, MIDDLE, FAST = (0.009, 900.0, 0.0), (0.006, 60.0, 0.75), (0.0035, 3.0, 0.85)
R_S, T_P = 0.018, 20.0


def made_pulse(i_p, elements, noise=5e-5, seed=0, r_s=R_S, until=1800.0):
    t = np.concatenate([np.arange(0, T_P, 0.2), np.arange(T_P, until, 0.8)])
    i = np.where(t <= T_P, i_p, 0.0)
    v = fractional.ramp(t, i, 3.700, 3.688) + i * r_s + fractional.overvoltage(t, i_p, T_P, elements)
    return t, v + noise * np.random.default_rng(seed).standard_normal(len(t)), i


def close(found, truth):
    assert len(found) == len(truth)
    for (r, tau, alpha), (true_r, true_tau, true_alpha) in zip(found, truth):
        assert r == pytest.approx(true_r, rel=0.05) and tau == pytest.approx(true_tau, rel=0.15) and alpha == pytest.approx(true_alpha, abs=0.03)


@pytest.mark.parametrize("truth,diffusion", [([SLOW, MIDDLE, FAST], True), ([MIDDLE, FAST], False), ([(0.006, 60.0, 0.75)], False)])
def test_elements_and_their_number_come_out(truth, diffusion):
    for seed in range(2):
        t, v, _ = made_pulse(-15.0, truth, seed=seed)
        rest = fractional.Rest(t, v, T_P, -15.0)
        found, off = fractional.chosen(rest, fractional.decomposed(rest, diffusion))
        close(found, truth)
        assert rest.post + off == pytest.approx(3.688, abs=5e-5)


def test_a_flat_rest_has_no_element():
    rng = np.random.default_rng(1)
    t = np.arange(0, 200, 0.5)
    v = 3.7 + 1e-4 * rng.standard_normal(len(t))
    rest = fractional.Rest(t, v, T_P, 2.0)
    assert fractional.decomposed(rest) == [] and fractional.chosen(rest, []) == ([], 0.0)
    assert rest.sigma == pytest.approx(1e-4, rel=0.2)


def test_fractional_response():
    t = np.linspace(0.1, 500, 900)
    assert np.abs(kernels.fractional_pulse(t, 2.0, T_P, 30.0, 0.9999) - kernels.rc_pulse(t, 2.0, T_P, 30.0)).max() < 1e-3
    few, many = kernels.relaxation(t[:300], 30.0, 0.6), kernels.relaxation(t, 30.0, 0.6)[:300]
    assert np.abs(few - many).max() < 1e-3 and (np.diff(many) < 0).all()


def test_an_element_that_is_over_before_the_window_is_none():
    t = np.linspace(56.3, 120.0, 40)
    over = kernels.fractional_pulse(t, -15.0, T_P, 0.05, 0.999)
    y = -1e-3 * np.exp((56.3 - t) / 20)
    assert 0 < np.abs(over).max() < 1e-308
    x, rms = kernels.solved(over[:, None], y, np.zeros(1, bool))
    assert x == [0.0] and rms == pytest.approx(np.sqrt(np.mean(y**2)))
    (tau, alpha), (r,), rms = kernels.searched(lambda tau, alpha: kernels.fractional_pulse(t, -15.0, T_P, tau, alpha)[:, None], y, [(0.05, 20.0), (0.3, 0.999)], [False], ordered=1)
    assert np.isfinite([tau, alpha, r, rms]).all()


@pytest.fixture(scope="module")
def cells(spark):
    rows, pulses = [], []
    for cell, r_s in ((1, 0.018), (2, 0.025)):
        for pulse, i_p in enumerate((-15.0, 10.0, -6.0)):
            t, v, i = made_pulse(i_p, [MIDDLE, FAST], seed=10 * cell + pulse, r_s=r_s, until=900.0)
            rows += [(cell, pulse, float(a), float(b), float(c)) for a, b, c in zip(t, v, i)]
            pulses.append((cell, pulse, T_P, i_p, 3.7))
    rows += [(3, 0, 0.0, 3.7, 1.0), (3, 0, 1.0, None, 1.0)]
    pulses += [(3, 0, 1.0, 1.0, 3.7), (4, 0, 1.0, 1.0, 3.7)]
    return spark.createDataFrame(rows, "cell long, pulse long, t double, v double, i double").repartition(4), spark.createDataFrame(pulses, "cell long, pulse long, t_p double, i_p double, v_pre double")


def test_chain(cells):
    found = fractional.chain(*cells, ["cell", "pulse"], ["cell"])
    rows = found.collect()
    assert sorted((r.cell, r.pulse) for r in rows) == [(c, p) for c in (1, 2) for p in range(3)]
    assert {r.cell: round(r.r_s, 9) for r in rows}.keys() == {1, 2} and len({(r.cell, r.r_s) for r in rows}) == 2
    for r in rows:
        assert r.r_s == pytest.approx({1: 0.018, 2: 0.025}[r.cell], rel=0.02)
        assert r.rms <= r.rms_sequential and r.rms < 1e-4
        if r.pulse == 0:
            close(list(zip(r.r, r.tau, r.alpha)), [MIDDLE, FAST])
    assert fractional.exploded(found, ["cell", "pulse"]).count() == sum(len(r.r) for r in rows)


def test_a_pulse_whose_windows_lose_an_element_keeps_its_group(spark):
    """Its first windows begin when the fastest element that is tried there is long over."""
    rows, pulses = [], []
    for pulse, truth in enumerate(([(0.006, 60.0, 0.75)], [MIDDLE, FAST])):
        rows += [(1, pulse, float(a), float(b), float(c)) for a, b, c in zip(*made_pulse(-15.0, truth, seed=0))]
        pulses.append((1, pulse, T_P, -15.0, 3.7))
    of = spark.createDataFrame(rows, "cell long, pulse long, t double, v double, i double"), spark.createDataFrame(pulses, "cell long, pulse long, t_p double, i_p double, v_pre double")
    found = fractional.prepared(*of, ["cell", "pulse"])
    values, at = fractional.series_resistance(found, ["cell"], rounds=3)
    assert values.first()["value"] == pytest.approx(R_S, rel=0.02)
    assert {r["pulse"]: len(r["r"]) for r in at.collect()} == {0: 1, 1: 2}


def test_shared_value_equals_one_dense_fit(spark):
    """Three exponentials with a slope of their own, one offset for all of a group."""
    rng, t = np.random.default_rng(3), np.linspace(0, 5, 60)
    rows, ys = [], {}
    for group in (1, 2):
        for k in range(3):
            y = 0.5 * group + (1 + k) * np.exp(-t / (0.5 + k)) * (1 + 0.2 * group) + 0.05 * rng.standard_normal(len(t))
            ys[group, k] = y
            rows.append((group, k, y.tolist()))

    def fit(row, value, own):
        y = np.array(row["y"]) - value
        model = lambda p: p[0] * np.exp(-t / p[1])
        p, _ = numeric.levenberg_marquardt(lambda p: model(p) - y, np.array(own or [1.0, 1.0]), np.array([0.0, 0.05]), np.array([50.0, 50.0]), 200)
        e = np.exp(-t / p[1])
        return (model(p) - y, np.ones(len(t)), np.column_stack([e, p[0] * e * t / p[1] ** 2])), p.tolist()

    items = spark.createDataFrame(rows, "g long, k long, y array<double>").repartition(3)
    values, at = coupled.shared_value(items, ["g"], spark.createDataFrame([(1, 0.0), (2, 3.0)], "g long, value double"), fit, rounds=40)
    for group, value in ((r.g, r.value) for r in values.collect()):
        def dense(p):
            return np.concatenate([p[0] + p[1 + 2 * k] * np.exp(-t / p[2 + 2 * k]) - ys[group, k] for k in range(3)])

        p, _ = numeric.levenberg_marquardt(dense, np.array([0.2, *[1.0, 1.0] * 3]), np.array([0.0, *[0.0, 0.05] * 3]), np.full(7, 50.0), 400)
        assert value == pytest.approx(p[0], rel=1e-4)
        own = {r.k: r.own for r in at.where(F.col("g") == group).collect()}
        assert np.concatenate([own[k] for k in range(3)]) == pytest.approx(p[1:], rel=1e-3)
