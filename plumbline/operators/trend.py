"""Rank tests for trends. A series is one group; its numeric core is numpy, chosen per group by Spark."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.constants import TREND_MIN_POINTS, Z95

EXACT_PAIRS = 4_000_000


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def t_sf(t: float, df: float) -> float:
    """Upper tail of Student's t, by the continued fraction of the incomplete beta function."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    if x >= 1:
        return 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))

    def fraction(x, a, b):
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        h = d
        for m in range(1, 400):
            for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 + k * d, 1 + k / c
                d = 1 / (d if abs(d) > 1e-300 else 1e-300)
                c = c if abs(c) > 1e-300 else 1e-300
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    tail = front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b
    return (tail / 2) if t >= 0 else 1 - tail / 2


def kendall_s(x: np.ndarray) -> int:
    """Sum of sign(x_j - x_i) over i < j, in O(n log n) by counting in a binary indexed tree."""
    _, rank = np.unique(x, return_inverse=True)
    m = int(rank.max(initial=-1)) + 1
    tree, total = [0] * (m + 1), 0
    for seen, r in enumerate(rank.tolist()):
        below, i = 0, r
        while i > 0:
            below += tree[i]
            i -= i & -i
        upto, i = 0, r + 1
        while i > 0:
            upto += tree[i]
            i -= i & -i
        total += below - (seen - upto)
        i = r + 1
        while i <= m:
            tree[i] += 1
            i += i & -i
    return total


def kendall_variance(x: np.ndarray) -> float:
    """Variance of S without a trend, with ties."""
    n = len(x)
    _, t = np.unique(x, return_counts=True)
    t = t.astype(float)
    return float((n * (n - 1) * (2 * n + 5) - (t * (t - 1) * (2 * t + 5)).sum()) / 18)


def sen_slope(x: np.ndarray) -> float:
    """Median of all pairwise slopes per step.

    Beyond ``EXACT_PAIRS`` pairs the median is still exact: a bracket from random pairs is narrowed by one
    counting pass over the slopes by lag, and only slopes inside it are sorted.
    """
    n = len(x)
    pairs = n * (n - 1) // 2
    if pairs <= EXACT_PAIRS:
        i, j = np.triu_indices(n, 1)
        return float(np.median((x[j] - x[i]) / (j - i)))
    rng = np.random.Generator(np.random.PCG64(0))
    width = 0.01
    while True:
        i = rng.integers(0, n - 1, 400_000)
        j = rng.integers(0, n - 1, 400_000)
        j = np.where(j >= i, j + 1, j)
        lo, hi = np.quantile((x[j] - x[i]) / (j - i), [0.5 - width, 0.5 + width])
        below, inside = 0, []
        for lag in range(1, n):
            s = (x[lag:] - x[:-lag]) / lag
            below += int((s < lo).sum())
            inside.append(s[(s >= lo) & (s <= hi)])
        mid = np.sort(np.concatenate(inside))
        a, b = (pairs - 1) // 2 - below, pairs // 2 - below
        if 0 <= a and b < len(mid):
            return float((mid[a] + mid[b]) / 2)
        width *= 4


def average_ranks(x: np.ndarray) -> np.ndarray:
    _, which, count = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(count) - (count - 1) / 2)[which]


def hamed_rao_variance(x: np.ndarray, variance: float, slope: float) -> float:
    """Variance corrected for the significant autocorrelation of detrended ranks."""
    n = len(x)
    r = average_ranks(x - slope * np.arange(1, n + 1))
    r = r - r.mean()
    size = 1 << int(2 * n - 1).bit_length()
    f = np.fft.rfft(r, size)
    acov = np.fft.irfft(f * np.conj(f), size)[:n]
    acf = acov[1:] / acov[0]
    lag = np.arange(1, n)
    use = np.abs(acf) > Z95 / math.sqrt(n)
    total = ((n - lag) * (n - lag - 1) * (n - lag - 2) * acf)[use].sum()
    corrected = variance * (1 + 2 / (n * (n - 1) * (n - 2)) * total)
    return corrected if corrected > 0 else variance


def _verdict(s: float, variance: float) -> tuple[float, float, str]:
    z = (s - math.copysign(1, s)) / math.sqrt(variance) if s and variance > 0 else 0.0
    return z, 2 * normal_sf(abs(z)), ("increasing" if z > 0 else "decreasing") if abs(z) > Z95 else "no trend"


def mann_kendall(x: np.ndarray, autocorrelated: bool = False) -> dict:
    """S, variance, z, p, verdict and Sen's slope of one series in time order."""
    s, variance, slope = kendall_s(x), kendall_variance(x), sen_slope(x)
    if autocorrelated and len(x) > 3:
        variance = hamed_rao_variance(x, variance, slope)
    z, p, verdict = _verdict(s, variance)
    return {"s": s, "variance": variance, "z": z, "p": p, "trend": verdict, "slope": slope}


def seasonal_mann_kendall(x: np.ndarray, period: int = 12) -> dict:
    """S and variance added over the positions of the period; the slope is the median within positions."""
    parts = [x[k::period] for k in range(period)]
    s, variance = sum(map(kendall_s, parts)), sum(kendall_variance(p) for p in parts if len(p) > 1)
    slopes = [(p[j] - p[i]) / (j - i) for p in parts for i, j in [np.triu_indices(len(p), 1)]]
    z, p, verdict = _verdict(s, variance)
    return {"s": s, "variance": variance, "z": z, "p": p, "trend": verdict, "slope": float(np.median(np.concatenate(slopes))) if slopes else math.nan}


def trend(times: pd.Series, values: np.ndarray) -> dict:
    """The full test of one clean series: anomalies where a seasonal cycle matters, then the test that fits."""
    t, y = pd.DatetimeIndex(times), np.asarray(values, float)
    n = len(y)
    if n < TREND_MIN_POINTS or len(np.unique(y)) < 2:
        return {}
    month = t.month.to_numpy()
    span = (t[-1] - t[0]).days
    cycle = n >= 24 and span >= 700 and len(np.unique(month)) == 12
    seasonal, use = False, y
    if cycle:
        means = np.array([y[month == m].mean() for m in range(1, 13)])[month - 1]
        seasonal = means.var() / y.var() > 0.2
        use = y - means if seasonal else y
    day = t.dayofyear.to_numpy() - 1 + t.hour.to_numpy() / 24
    x = t.year.to_numpy() + day / np.where(t.is_leap_year, 366.0, 365.0)
    dx, dy = x - x.mean(), use - use.mean()
    slope = float((dx * dy).sum() / (dx * dx).sum())
    rest = dy - slope * dx
    r2 = 1 - float((rest * rest).sum() / max((dy * dy).sum(), 1e-300))
    error = math.sqrt(max((rest * rest).sum(), 0) / max(n - 2, 1) / (dx * dx).sum())
    p = 2 * t_sf(abs(slope / error), n - 2) if error > 0 else 0.0
    a, b = rest[:-1], rest[1:]
    r1 = float(np.corrcoef(a, b)[0, 1]) if n >= 4 and a.std() > 0 and b.std() > 0 else 0.0
    step = float(np.median(np.diff(t.values).astype("timedelta64[s]").astype(float))) / 86400 if n > 1 else 0.0
    whole = seasonal and 27 <= step <= 32 and len(np.unique(t.year * 12 + month)) == n == (t[-1].year - t[0].year) * 12 + t[-1].month - t[0].month + 1
    if whole:
        method, test = "Seasonal Mann-Kendall", seasonal_mann_kendall(y)
    else:
        corrected = r1 > 2 / math.sqrt(n) and n >= 10
        method, test = ("Hamed-Rao Mann-Kendall" if corrected else "Mann-Kendall"), mann_kendall(use, corrected)
        method += " on deseasonalized anomalies" if seasonal else ""
    return {"n": n, "slope_per_year": slope, "slope_per_decade": 10 * slope, "r2": r2, "intercept": float(y.mean() - slope * x.mean()), "regression_p": p, "lag1": r1, "seasonal": bool(seasonal), "method": method, "mk_z": test["z"], "mk_p": test["p"], "mk_trend": test["trend"], "sens_slope_per_step": test["slope"], "short_record": bool(span / 365.25 < 1.95 and step < 60)}


TREND_DDL = "key string, n long, slope_per_year double, slope_per_decade double, r2 double, intercept double, regression_p double, lag1 double, seasonal boolean, method string, mk_z double, mk_p double, mk_trend string, sens_slope_per_step double, short_record boolean"


def trends(points: DataFrame) -> DataFrame:
    """A row per key of (key, t, v): the trend of that series. A series is bounded by its timestamps."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        got = trend(pdf["t"], pdf["v"].to_numpy())
        return pd.DataFrame([{"key": pdf["key"].iloc[0], **got}] if got else [], columns=[c.split()[0] for c in TREND_DDL.split(", ")])

    clean = points.groupBy(F.col("key").cast("string").alias("key"), F.col("t").cast("timestamp_ntz").alias("t")).agg(F.avg("v").alias("v"))
    return clean.groupBy("key").applyInPandas(run, TREND_DDL)


def _one(points: DataFrame, ddl: str, work) -> DataFrame:
    return points.select(F.col("t").cast("timestamp_ntz").alias("t"), "v").groupBy(F.lit(1).alias("_k")).applyInPandas(lambda pdf: pd.DataFrame([work(pdf.sort_values("t")["v"].to_numpy(float))]), ddl)


def kendall(points: DataFrame) -> DataFrame:
    """One row: s, variance and Sen's slope of (t, v)."""
    return _one(points, "s long, variance double, slope double", lambda x: {"s": kendall_s(x), "variance": kendall_variance(x), "slope": sen_slope(x)})


def tests(points: DataFrame) -> DataFrame:
    """One row: z and p by the plain and the Hamed-Rao test."""

    def work(x):
        a, b = mann_kendall(x), mann_kendall(x, True)
        return {"mk_z": a["z"], "mk_p": a["p"], "hr_z": b["z"], "hr_p": b["p"], "trend": a["trend"]}

    return _one(points, "mk_z double, mk_p double, hr_z double, hr_p double, trend string", work)


def seasonal_test(points: DataFrame) -> DataFrame:
    """One row: s, variance and slope of the seasonal test on monthly (t, v)."""
    return _one(points, "s long, variance double, slope double", lambda x: {k: seasonal_mann_kendall(x)[k] for k in ("s", "variance", "slope")})
