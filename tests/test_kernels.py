import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lagwise.functions import kernels as K


def pair(rho, n, seed=42):
    r = np.random.default_rng(seed)
    a, b = r.standard_normal(n), r.standard_normal(n)
    return a, rho * a + np.sqrt(1 - rho**2) * b


@pytest.mark.parametrize("rho, tolerance", [(0.5, 0.3), (0.7, 0.3), (0.9, 0.25)])
def test_information_of_gaussians(rho, tolerance):
    x, y = pair(rho, 1000)
    truth = -0.5 * np.log(1 - rho**2)
    assert abs(K.ksg(x, y) - truth) < tolerance * truth


def test_information_is_symmetric_and_small_when_independent():
    x, y = pair(0.0, 300, 123)
    assert K.ksg(x, y) < 0.1
    assert K.ksg(x, y) == pytest.approx(K.ksg(y, x), abs=0.05)


def test_lag_and_direction():
    r = np.random.default_rng(42)
    x = r.standard_normal(300)
    y = np.concatenate([[0, 0], x[:-2] ** 2]) + 0.3 * r.standard_normal(300)
    name, lag, p = K.direction(x, y, max_lag=4, n_perm=30)
    assert name in ("x->y", "bidirectional") and lag == 2 and p < 0.05


def test_unit_roots():
    r = np.random.default_rng(42)
    noise, walk = r.standard_normal(300), np.cumsum(r.standard_normal(300))
    assert K.make_stationary(noise)[1:] == (True, [])
    out, ok, steps = K.make_stationary(walk)
    assert ok and steps and steps[0].startswith(("differenced", "detrended")) and len(out) >= 298


def test_f_tail():
    assert K.f_tail(4.0, 1, 10) == pytest.approx(0.0734, abs=2e-4)
    assert K.f_tail(3.3258, 5, 10) == pytest.approx(0.05, abs=2e-4)


def test_granger_and_out_of_sample():
    r = np.random.default_rng(42)
    x = r.standard_normal(500)
    y = 0.8 * np.concatenate([[0], x[:-1]]) + 0.5 * r.standard_normal(500)
    assert K.granger(x, y)[0] in ("x->y", "bidirectional")
    assert K.out_of_sample(x, y, 1) > 0.1
    z = 0.8 * np.concatenate([[0], x[:-1] ** 2]) + 0.3 * r.standard_normal(500)
    assert K.out_of_sample(x, z, 1) > 0  # the forest sees what ridge can't
    a, b = pair(0.0, 300, 123)
    assert K.out_of_sample(a, b, 2) < 0.05


def test_walk_forward():
    r = np.random.default_rng(42)
    x = r.standard_normal(200)
    y = 0.6 * np.concatenate([[0, 0], x[:-2]]) + 0.4 * r.standard_normal(200)
    assert K.walk_forward(x, y, 2)[2]
    assert K.walk_forward(np.ones(30), np.ones(30), 2) == ([], 0.0, False, 0, 0.0, False)


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 10**6), st.integers(20, 80))
def test_information_is_never_negative(seed, n):
    x, y = pair(0.3, n, seed)
    assert K.ksg(x, y) >= 0
