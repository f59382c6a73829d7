"""Kernels against known truth."""

import numpy as np

from voltaspan.functions import numeric


def test_two_rc_finds_its_own_parameters():
    t = np.linspace(0, 1800, 300)
    truth = np.array([3.7, -0.02, 40.0, -0.03, 700.0])
    v = truth[0] + truth[1] * np.exp(-t / truth[2]) + truth[3] * np.exp(-t / truth[4])
    p, rms = numeric.two_rc(t, v)
    assert rms < 1e-5
    assert np.allclose(p[:2], truth[:2], rtol=0.05) and np.allclose(p[2:], truth[2:], rtol=0.1)


def test_nonnegative_meets_the_optimality_conditions():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.standard_normal((30, 12)), rng.standard_normal(30)
        x = numeric.nonnegative(a, b)
        w = a.T @ (b - a @ x)
        assert (x >= 0).all() and (w <= 1e-8).all() and np.abs(w[x > 0]).max(initial=0) < 1e-8


def test_smoothing_keeps_cubics():
    t = np.arange(80) * 0.5
    y = 0.01 * t**3 - 0.3 * t**2 + t - 4
    assert np.allclose(numeric.smoothed(y, 21, 3), y)
    assert np.allclose(numeric.smoothed(y, 21, 3, 1, 0.5), 0.03 * t**2 - 0.6 * t + 1)


def test_relaxation_times_and_kk():
    f = np.logspace(-2, 4, 50)
    w = 2j * np.pi * f
    z = 0.02 + 0.006 / (1 + w * 60) + 0.0035 / (1 + w * 0.003)
    tau, g, r_s, _ = numeric.relaxation_times(f, z, 1e-8)
    found = tau[numeric.peaks(g, 0.3)]
    assert abs(r_s - 0.02) < 1e-3 and abs(g.sum() - 0.0095) < 1e-3
    assert any(abs(np.log10(found / 0.003)) < 0.2) 
    residual = numeric.linear_kk(f, z)
    assert residual.max() < 0.01
    spiked = z.copy()
    spiked[20] *= 1.2
    assert numeric.outliers(numeric.linear_kk(f, spiked))[20] and not numeric.outliers(residual).any()


def test_density_clusters():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 0.1, (30, 2)), rng.normal(5, 0.1, (25, 2)), rng.normal((0, 8), 0.1, (20, 2)), [[20, 20], [-15, 3]]])
    label = numeric.density_clusters(x, 5, 4)
    assert len(set(label[:30])) == 1 and len(set(label[30:55])) == 1 and len(set(label[55:75])) == 1
    assert len({label[0], label[30], label[55]}) == 3
    assert (numeric.density_clusters(x[:4], 5) == -1).all()
