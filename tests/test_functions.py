import math
import statistics

import pytest
from hypothesis import given
from hypothesis import strategies as st

from veilstat.functions import calibration as cal
from veilstat.functions import noise as nz
from veilstat.functions import validate as v


def test_published_constants():
    assert round(cal.stability_accuracy(2, 0.2, 1e-6)) == 176
    assert round(cal.stability_epsilon(2, 2, 1e-6)) == 35
    assert round(cal.laplace_accuracy(2, 0.2)) == 30
    assert round(cal.laplace_epsilon(2, 0.5)) == 12
    assert cal.mean_sensitivity(0, 100, 10_000) == 0.01
    assert round(cal.laplace_accuracy(0.01, 0.1), 1) == 0.3
    assert round(cal.laplace_epsilon(0.01, 0.3), 1) == 0.1
    assert cal.variance_sensitivity(2, 0, 10) == 50 and cal.variance_sensitivity(5, 5, 10) == 5
    assert round(cal.laplace_accuracy(cal.variance_sensitivity(10_000, 0, 100), 0.1)) == 30
    assert cal.covariance_sensitivity(10_000, [(0, 1), (0, 1)]) == [2 / 10_000] * 3
    assert cal.covariance_sensitivity(10, [(0, 1)], intercept=True) == [0, 0, 0.2]


@given(st.floats(0.001, 50), st.floats(0.01, 5), st.floats(0.001, 0.5))
def test_accuracy_and_epsilon_invert_each_other(sens, epsilon, alpha):
    assert cal.laplace_epsilon(sens, cal.laplace_accuracy(sens, epsilon, alpha), alpha) == pytest.approx(epsilon)
    assert cal.stability_epsilon(sens, cal.stability_accuracy(sens, epsilon, 1e-9, alpha), 1e-9, alpha) == pytest.approx(epsilon)
    assert cal.tree_epsilon(cal.tree_accuracy(epsilon, 0, 63, 1, alpha), 0, 63, 1, alpha) == pytest.approx(epsilon)
    assert cal.laplace_half_width(sens, epsilon, alpha) == pytest.approx(cal.laplace_accuracy(sens, epsilon, alpha))


def test_laplace_functions():
    assert nz.laplace_quantile(0.4, b=3) == pytest.approx(3 * math.log(0.8))
    assert nz.laplace_quantile(0.7, b=5) == pytest.approx(-5 * math.log(0.6))
    for p in (0.01, 0.3, 0.5, 0.9):
        assert nz.laplace_cdf(nz.laplace_quantile(p, 2, 3), 2, 3) == pytest.approx(p)
    step = 1e-3
    assert sum(nz.laplace_density(k * step, 0, 2) * step for k in range(-40_000, 40_000)) == pytest.approx(1, abs=1e-3)
    assert nz.sgn(0) == 1 and nz.sgn(-2) == -1


def test_noise_follows_its_distribution():
    draws = sorted(nz.dp_noise(4000, 2.0, source=nz.Uniforms(seed=1)))
    gap = max(abs(nz.laplace_cdf(x, 0, 2) - (k + 0.5) / 4000) for k, x in enumerate(draws))
    assert gap < 1.63 / 4000**0.5
    normal = nz.dp_noise(4000, 3.0, "gaussian", source=nz.Uniforms(seed=1))
    assert statistics.pstdev(normal) == pytest.approx(3, rel=0.05)
    assert statistics.mean(nz.dp_noise(4000, 2.0, "gamma", 1.0, nz.Uniforms(seed=2))) == pytest.approx(2, rel=0.06)
    with pytest.raises(ValueError):
        nz.dp_noise(1, 1.0, "cauchy")
    assert nz.dp_noise(3, 1.0, source=nz.Uniforms.silent()) == [0, 0, 0]
    assert nz.Uniforms(seed=4).draw(3) == nz.Uniforms(seed=4).draw(3)
    assert all(0 < u < 1 for u in nz.Uniforms().draw(100))


def test_gamma_and_chi_squared():
    assert nz.gamma_quantile(0.3, 1) == pytest.approx(-math.log(0.7))
    assert nz.chi_squared_quantile(0.95, 2) == pytest.approx(5.991465, abs=1e-5)
    assert nz.chi_squared_quantile(0.01, 19) == pytest.approx(7.632730, abs=1e-5)


def test_messages():
    cases = [
        (lambda: v.check_empty(None), "Input may not be NA or NULL."),
        (lambda: v.check_numeric("a"), "a is no number"),
        (lambda: v.check_length([1], 2), "Input was expected to be of length  2  but is instead of length  1"),
        (lambda: v.check_n(0.5), "n must be a positive whole number."),
        (lambda: v.check_n(-1), "n must be a positive whole number."),
        (lambda: v.check_n(None), "Input n may not be NA or NULL."),
        (lambda: v.check_range([1]), "requires upper and lower values as vector of length 2."),
        (lambda: v.check_range(None), "Input range may not be empty."),
        (lambda: v.check_range([1, None]), "Input range may not contain NA values."),
        (lambda: v.check_ranges(5, "numeric", 2), "one pair for each column"),
        (lambda: v.check_epsilon(-1), "must be a value greater than zero."),
        (lambda: v.check_epsilon([1, 0.1]), "one epsilon is wanted here, not 2"),
        (lambda: v.check_epsilon([1, 1], 3), "3 epsilons are wanted, but there are 2"),
        (lambda: v.check_accuracy(0), "an accuracy is a positive number"),
        (lambda: v.check_variable_type("x", ("numeric",)), "Variable type x should be one of numeric"),
        (lambda: v.check_mechanism("x"), "no mechanism 'x' here"),
        (lambda: v.check_epsilon_dist([0.5, 0.4], 2), "add up to 1"),
        (lambda: v.check_accuracy_vals([0, 1], 2), "accuracies are positive"),
        (lambda: v.check_stability_delta(0.1, 10), "privacy risk"),
    ]
    for call, message in cases:
        with pytest.raises(ValueError, match="(?s).*" + message.replace("(", "[(]")):
            call()


def test_values_and_warnings():
    assert v.check_range(None, "logical") == (0, 1)
    assert v.check_range([3, 1]) == (1, 3)
    with pytest.warns(UserWarning, match="more than two values"):
        assert v.check_range([0, 1, 2]) == (0, 2)
    with pytest.warns(UserWarning, match="Setting range to NULL"):
        assert v.check_range([0, None], empty_okay=True) is None
    with pytest.warns(UserWarning, match="protects little"):
        assert v.check_epsilon(4) == 4
    with pytest.warns(UserWarning, match="Lower bound"):
        assert v.check_impute_range((0, 1.5), (1, 2), "numeric") == (1, 1.5)
    with pytest.warns(UserWarning, match="Upper bound"):
        assert v.check_impute_range((1.5, 3), (1, 2), "numeric") == (1.5, 2)
    with pytest.warns(UserWarning, match="not of numeric or integer type"):
        assert v.check_impute_range((0, 1), (0, 1), "logical") == (0, 1)
    assert v.check_impute_range(None, (1, 2), "numeric") == (1, 2)
    assert v.check_delta("mechanismStability", None) == 2**-30
    with pytest.warns(UserWarning, match="Setting delta to 0"):
        assert v.check_delta("mechanismLaplace", 0.1) == 0
    assert v.check_variable_type("NUMERIC", ("numeric",)) == "numeric"
    assert v.check_mechanism("mechanismlaplace") == "mechanismLaplace"
