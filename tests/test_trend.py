import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.operators import trend

series = st.lists(st.integers(-20, 20).map(float), min_size=3, max_size=40).map(np.array)


@given(series)
@settings(max_examples=80, deadline=None)
def test_kendall_and_sen_equal_brute_force(x):
    pairs = list(combinations(range(len(x)), 2))
    assert trend.kendall_s(x) == sum(int(x[j] > x[i]) - int(x[j] < x[i]) for i, j in pairs)
    assert trend.sen_slope(x) == pytest.approx(np.median([(x[j] - x[i]) / (j - i) for i, j in pairs]))


def test_bracketed_median_is_exact(monkeypatch):
    x = np.random.default_rng(1).normal(size=300).cumsum()
    exact = trend.sen_slope(x)
    monkeypatch.setattr(trend, "EXACT_PAIRS", 10)
    assert trend.sen_slope(x) == pytest.approx(exact, abs=1e-15)


def test_tails_against_tables():
    assert 2 * trend.normal_sf(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    for t, df, p in ((2.228138852, 10, 0.05), (12.706204736, 1, 0.05), (2.042272456, 30, 0.05), (63.656741162, 1, 0.01)):
        assert 2 * trend.t_sf(t, df) == pytest.approx(p, rel=1e-8)


def test_linear_series_increases():
    got = trend.mann_kendall(np.arange(800.0))
    assert got["trend"] == "increasing" and got["p"] < 1e-3 and got["slope"] == 1.0


def test_seasonal_truth_is_recovered():
    t = pd.date_range("2000-01-01", periods=240, freq="MS")
    y = 8 * np.sin(2 * np.pi * (t.month - 1) / 12) + 0.04 * np.arange(240) / 12 * 10 + np.random.default_rng(0).normal(0, 0.3, 240)
    got = trend.trend(pd.Series(t), np.asarray(y))
    assert got["seasonal"] and got["method"] == "Seasonal Mann-Kendall" and got["mk_trend"] == "increasing"
    assert got["sens_slope_per_step"] == pytest.approx(0.4, abs=0.05)


def test_autocorrelated_noise_uses_the_corrected_test():
    rng, y = np.random.default_rng(3), [0.0]
    for _ in range(599):
        y.append(0.9 * y[-1] + rng.normal())
    assert trend.trend(pd.Series(pd.date_range("2020-01-01", periods=600)), np.array(y))["method"].startswith("Hamed-Rao")


def test_hamed_rao_by_definition():
    x = np.random.default_rng(5).normal(size=60).cumsum()
    n, slope, var = 60, trend.sen_slope(x), trend.kendall_variance(x)
    r = trend.average_ranks(x - slope * np.arange(1, n + 1))
    r = r - r.mean()
    acf = [sum(r[i] * r[i + k] for i in range(n - k)) / sum(r * r) for k in range(1, n)]
    total = sum((n - k) * (n - k - 1) * (n - k - 2) * a for k, a in enumerate(acf, 1) if abs(a) > 1.959963984540054 / math.sqrt(n))
    assert trend.hamed_rao_variance(x, var, slope) == pytest.approx(var * (1 + 2 / (n * (n - 1) * (n - 2)) * total))


def test_short_and_constant_series_give_nothing():
    assert trend.trend(pd.Series(pd.date_range("2020-01-01", periods=5)), np.arange(5.0)) == {}
    assert trend.trend(pd.Series(pd.date_range("2020-01-01", periods=9)), np.ones(9)) == {}
