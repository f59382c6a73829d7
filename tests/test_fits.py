"""Fits against circuits whose values are known."""

import numpy as np
import pytest

from voltaspan.functions import kernels, numeric
from voltaspan.operators import pulses, spectra, sweeps

TRUE = {"r0": 0.012, "r1": 0.008, "tau1": 4.0, "r2": 0.015, "tau2": 180.0}


def pulse(i_p=2.0, t_p=20.0, v_pre=3.6, drop=0.01, noise=1e-6, seed=0):
    t = np.concatenate([np.arange(0, t_p + 0.01, 0.25), t_p + np.arange(0.8, 600, 1.6)])
    post = v_pre + np.sign(i_p) * drop
    v = v_pre + (post - v_pre) * np.clip(t / t_p, 0, 1) + np.where(t <= t_p, i_p * TRUE["r0"], 0)
    v = v + TRUE["r1"] * kernels.rc_pulse(t, i_p, t_p, TRUE["tau1"]) + TRUE["r2"] * kernels.rc_pulse(t, i_p, t_p, TRUE["tau2"])
    return t, v + noise * np.random.default_rng(seed).standard_normal(len(t)), np.where(t <= t_p, i_p, 0.0)


@pytest.fixture(scope="module")
def made(spark):
    rows, table = [], []
    for k, i_p in enumerate((2.0, -2.0, 5.0)):
        t, v, i = pulse(i_p, seed=k)
        rows += [(k, float(a), float(b), float(c)) for a, b, c in zip(t, v, i)]
        table.append((k, 20.0, i_p, 3.6, TRUE["r0"], 0.02))
    return spark.createDataFrame(rows, "id long, t double, v double, i double").repartition(3), spark.createDataFrame(table, "id long, t_p double, i_p double, v_pre double, r0 double, cap double")


def test_joint_fit(made):
    for r in pulses.joint(*made, ["id"]).collect():
        assert not r["degenerate"] and r["rms"] < 1e-4
        for name in ("r1", "tau1", "r2", "tau2"):
            assert r[name] == pytest.approx(TRUE[name], rel=0.05), name


def test_extrapolated_and_staged(made):
    for r in pulses.extrapolated(*made, ["id"]).collect():
        assert r["r0_termination"] == pytest.approx(TRUE["r0"], rel=0.1)
        assert r["r0_onset"] == pytest.approx(TRUE["r0"], rel=0.1)
    for r in pulses.staged(*made, ["id"], cut=25.0).collect():
        assert r["r2_slow"] == pytest.approx(TRUE["r2"], rel=0.1) and r["tau2_slow"] == pytest.approx(TRUE["tau2"], rel=0.1)
        assert r["r1_fast"] == pytest.approx(TRUE["r1"], rel=0.15) and r["staged_rms"] < 1e-3


def test_model_free(made):
    rows, table = made
    for r in pulses.model_free(rows, table, ["id"]).collect():
        t, v, i = pulse(r["i_p"], seed=r["id"])
        k = np.searchsorted(t, 0.5)
        assert r["r_dc_onset"] == pytest.approx(abs((3.6 - v[k]) / i[k]))
        last, first = np.flatnonzero(t <= 20)[-1], np.flatnonzero(t > 20)[0]
        assert r["r_termination"] == pytest.approx(abs((v[first] - v[last]) / r["i_p"]))
        assert TRUE["r0"] * 0.9 < r["r_onset"] < TRUE["r0"] * 1.6


def test_rests_and_their_fit(spark):
    t, v, i = pulse(-2.0, drop=0.0)
    rows = [(1, k, int(a * 1e6), float(b), float(c), "DCH" if c else "PAU") for k, (a, b, c) in enumerate(zip(t, v, i))]
    rows += [(2, k, k * 10**6, 3.0, 0.0, "PAU") for k in range(30)]  # follows nothing
    df = spark.createDataFrame(rows, "cell long, seq long, us long, v double, i double, state string")
    rests = pulses.rests(df, ["cell"], ["us", "seq"], "state", "us", "i", "v")
    reference = spark.createDataFrame([(1, TRUE["r0"])], "cell long, r0 double")
    (r,) = pulses.relaxed(rests, ["cell"], reference, share=0.25, bounded=True).collect()
    assert r["tau2"] == pytest.approx(TRUE["tau2"], rel=0.1) and r["r_squared"] > 0.999
    assert r["consistent"] is True and r["r0"] == pytest.approx(TRUE["r0"], rel=0.25)


def test_left_out_is_the_median_of_the_others(spark):
    rng = np.random.default_rng(2)
    rows = [(g, i, float(x)) for g, n in enumerate((1, 2, 3, 4, 7, 8, 12)) for i, x in enumerate(rng.integers(0, 6, n))]
    out = pulses.left_out(spark.createDataFrame(rows, "g long, i long, x double"), ["g"], "i", ["x"]).collect()
    for r in out:
        others = [x for g, i, x in rows if g == r["g"] and i != r["i"]]
        assert r["x_others"] == (float(np.median(others)) if others else None)


F_ = np.logspace(-1, 3.5, 46)


def impedance(r0=0.001, l=1e-7, arcs=((0.002, 0.01, 0.85),), r_d=0.0005, phi=0.4):
    w = 2 * np.pi * F_
    return r0 + 1j * w * l + sum(r * kernels.zarc(w, t, a) for r, t, a in arcs) + (r_d * kernels.diffusion(w, spectra.DIFFUSION, phi) if r_d else 0)


def table(spark, *all_z):
    return spark.createDataFrame([(k, float(f), float(x.real), float(x.imag)) for k, z in enumerate(all_z) for f, x in zip(F_, z)], "eis long, f double, re double, im double").repartition(3)


def test_arcs(spark):
    for r in spectra.arcs(table(spark, impedance(), impedance(0.002)), "eis").collect():
        assert r["r0"] == pytest.approx(0.001 * (1 + r["eis"]), rel=0.05) and r["r1"] == pytest.approx(0.002, rel=0.05)
        assert r["tau1"] == pytest.approx(0.01, rel=0.1) and r["alpha1"] == pytest.approx(0.85, rel=0.05)
        assert r["r_d"] == pytest.approx(0.0005, rel=0.1) and r["phi_d"] == pytest.approx(0.4, rel=0.1) and r["reason"] == ""


def test_two_plain_arcs(spark):
    z = impedance(arcs=((0.002, 0.001, 1.0), (0.003, 0.1, 1.0)), r_d=0)
    (r,) = spectra.arcs(table(spark, z), "eis", n=2, diffusion=False, depressed=False).collect()
    assert [r[c] for c in ("r1", "tau1", "r2", "tau2")] == pytest.approx([0.002, 0.001, 0.003, 0.1], rel=0.05)


def test_series_resistance_and_table(spark):
    z = impedance(arcs=((0.002, 0.0005, 0.85),))
    bad = z.copy()
    bad[20] *= 1.3
    out = spectra.spectrum_table(table(spark, z, bad), "eis").orderBy("eis").collect()
    for r in out:
        assert r["r0_hf"] == pytest.approx(0.001, rel=0.1) and r["hf_n"] >= 10
        assert r["r1"] == pytest.approx(0.002, rel=0.15)
    assert out[1]["kk_out"] >= 1 and out[0]["kk_out"] == 0


def test_relaxation_peaks(spark):
    z = impedance(arcs=((0.002, 0.001, 1.0), (0.003, 0.1, 1.0)), r_d=0)
    found = spectra.relaxation_peaks(table(spark, z), "eis").orderBy("tau").collect()
    assert [r["tau"] for r in found if r["height"] > 1e-4] == pytest.approx([0.001, 0.1], rel=0.3)
    assert all(r["width"] < 1 for r in found)
    states = spark.createDataFrame([(0, 50.0)], "eis long, soc double")
    names = spectra.labelled_peaks(spectra.relaxation_peaks(table(spark, z), "eis"), states, "eis", [0.01], ["fast", "slow"]).orderBy("tau").collect()
    assert [r["process"] for r in names if r["height"] > 1e-4] == ["fast", "slow"] and names[0]["soc"] == 50


def test_widths_of_a_triangle():
    x = np.array([0, 1, 2, 3, 4, 3, 2, 1, 0], float)
    assert numeric.widths(x, np.array([4])) == pytest.approx([4.0])
    assert numeric.widths(np.array([3.0, 2, 1]), np.array([0])) == pytest.approx([0.0])


def test_mittag_leffler():
    x = np.linspace(0, 3, 7)
    assert kernels.mittag_leffler(x, 1.0) == pytest.approx(np.exp(-x))
    from math import gamma

    series = [sum((-v) ** k / gamma(0.7 * k + 1) for k in range(80)) for v in x]
    assert kernels.mittag_leffler(x, 0.7) == pytest.approx(series, rel=1e-3)


def test_state_of_charge_by_voltage(spark):
    soc = np.linspace(0, 100, 101)
    ocv = 3.0 + 0.01 * soc
    rows = lambda shift: spark.createDataFrame([(1, float(s), float(v + shift)) for s, v in zip(soc, ocv)], "cell long, soc double, v double")
    eta = sweeps.polarisation(rows(0.02), rows(-0.02), ["cell"])
    assert eta.count() == 201 and all(r["eta"] == pytest.approx(0.02) for r in eta.collect())
    knots = sweeps.lookup(rows(-0.02), eta, ["cell"], "discharge")
    points = spark.createDataFrame([(1, 3.254), (1, 2.0), (1, 9.0), (1, None), (2, 3.5)], "cell long, v double")
    out = {(r["cell"], r["v"]): (r["soc"], r["clipped"]) for r in sweeps.mapped(points, knots, ["cell"]).collect()}
    assert out[1, 3.254] == (pytest.approx(25.4), False) and out[1, 2.0] == (pytest.approx(0), True) and out[1, 9.0] == (pytest.approx(100), True)
    assert out[1, None] == (None, False) and out[2, 3.5] == (None, False)


def test_differential_curves(spark):
    v = np.linspace(3.0, 4.0, 1001)
    q = 2 + 0.5 * (v - 3) + 0.2 / (1 + np.exp(-(v - 3.5) / 0.02))
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(v, q)], "cell long, v double, q double")
    out = sweeps.differential_capacity(df, ["cell"], "v", "q").toPandas()
    assert out["v"][out["dqdv"].idxmax()] == pytest.approx(3.5, abs=0.01)
    assert out["dqdv"].iloc[:20].mean() == pytest.approx(0.5, rel=0.05)
    dva = sweeps.differential_voltage(df, ["cell"], "v", "q").toPandas()
    assert len(dva) == 600 and dva["dvdq"].iloc[:20].mean() == pytest.approx(2.0, rel=0.05)
