"""Time coverage, calendar aggregates, regressions, extremes and event series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.constants import EXTREME_Z, EXTREMES_KEPT
from plumbline.functions.expr import decimal_year, finite
from plumbline.operators.quantiles import percentiles


def canonical(df: DataFrame, time: str, value: str) -> DataFrame:
    """(t, v): finite values, one mean per timestamp."""
    return df.select(F.col(time).alias("t"), finite(F.col(value)).alias("v")).filter("t IS NOT NULL AND v IS NOT NULL").groupBy("t").agg(F.avg("v").alias("v"))


def daily_mean(df: DataFrame, time: str, value: str) -> DataFrame:
    return canonical(df.withColumn("_day", F.to_date(time)), "_day", value)


def monthly(df: DataFrame, time: str, value: str) -> DataFrame:
    """(month, v, n): mean and count per calendar month."""
    return df.groupBy(F.trunc(F.to_date(time), "month").alias("month")).agg(F.avg(value).alias("v"), F.count(value).alias("n"))


def between(df: DataFrame, time: str, start: str, end: str, whole_last_day: bool) -> DataFrame:
    """Rows in the period. Tables stop at midnight of ``end``; grids take the whole last day."""
    last = F.lit(end).cast("timestamp_ntz")
    upper = F.col(time) < last + F.expr("INTERVAL 1 DAY") if whole_last_day else F.col(time) <= last
    return df.filter((F.col(time) >= F.lit(start).cast("timestamp_ntz")) & upper)


def in_box(df: DataFrame, lon: str, lat: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows in (west, south, east, north), edges included; west > east crosses the date line."""
    w, s, e, n = box
    across = F.col(lon).between(w, e) if w <= e else (F.col(lon) >= w) | (F.col(lon) <= e)
    return df.filter(across & F.col(lat).between(s, n))


def _split_lag(times: DataFrame, column: str, width: int) -> DataFrame:
    """Previous value over the whole order, by blocks of ``width`` seconds, so that no task sorts everything."""
    t = times.withColumn("_b", F.floor(F.col(column).cast("double") / width))
    ends = t.groupBy("_b").agg(F.max(column).alias("_last"))
    prior = ends.withColumn("_before", F.lag("_last").over(Window.orderBy("_b"))).select("_b", "_before")
    w = Window.partitionBy("_b").orderBy(column)
    return t.join(prior, "_b").withColumn("previous", F.coalesce(F.lag(column).over(w), F.col("_before")))


def time_coverage(df: DataFrame, time: str) -> DataFrame:
    """One row: start, end, steps, median step, duplicate times, gaps beyond 1.6 median steps and the largest.

    Times are compared to the microsecond; figures are in seconds.
    """
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    counts = df.filter(F.col(time).isNotNull()).groupBy(micros.alias("t")).agg(F.count(F.lit(1)).alias("n"))
    steps = _split_lag(counts, "t", 86400 * 366 * 1_000_000).withColumn("d", F.col("t") - F.col("previous"))
    seconds = lambda c: (c / 1e6).cast("double")
    found, _ = percentiles(steps, {"d": (F.col("d"), (0.5,))})
    median = F.lit(found["d"][0]).cast("double")
    top = steps.agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count(F.lit(1)).alias("n_steps"), (F.sum("n") - F.count(F.lit(1))).alias("duplicate_times"), F.max("d").alias("gap"), F.count_if(F.col("d") > 1.6 * median).alias("n_gaps"))
    return top.select(seconds(F.col("a")).alias("start_s"), seconds(F.col("b")).alias("end_s"), "n_steps", seconds(median).alias("median_step_s"), "duplicate_times", "n_gaps", seconds(F.col("gap")).alias("largest_gap_s"))


def seasonal_cycle(points: DataFrame) -> DataFrame:
    """(month, mean) from (t, v), if there are 24 points or more over 700 days in all 12 months."""
    by = points.groupBy(F.month("t").alias("month")).agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("_n"), F.min("t").alias("_a"), F.max("t").alias("_b"))
    every = Window.partitionBy()
    ok = (F.sum("_n").over(every) >= 24) & (F.datediff(F.max("_b").over(every), F.min("_a").over(every)) >= 700) & (F.count(F.lit(1)).over(every) == 12)
    return by.withColumn("_ok", ok).filter("_ok").select("month", "mean")


def anomalies(points: DataFrame) -> DataFrame:
    """(t, v, anomaly): the value less the mean of its calendar month."""
    means = points.groupBy(F.month("t").alias("_m")).agg(F.avg("v").alias("_mean"))
    return points.join(F.broadcast(means), F.month("t") == F.col("_m")).select("t", "v", (F.col("v") - F.col("_mean")).alias("anomaly"))


def linear_trend(points: DataFrame) -> DataFrame:
    """One row: slope per year and decade, r2, intercept and count of the least squares line on decimal years."""
    x = points.select(decimal_year(F.col("t").cast("timestamp_ntz")).alias("x"), "v")
    return x.agg(F.regr_slope("v", "x").alias("slope_per_year"), (10.0 * F.regr_slope("v", "x")).alias("slope_per_decade"), F.regr_r2("v", "x").alias("r2"), F.regr_intercept("v", "x").alias("intercept"), F.count(F.lit(1)).alias("n"))


def extremes(points: DataFrame, k: int = EXTREMES_KEPT) -> DataFrame:
    """(t, v, z) with the largest robust |z| of ``EXTREME_Z`` or more."""
    found, row = percentiles(points, {"v": (F.col("v"), (0.5,))}, F.stddev_pop("v").alias("s"))
    off = F.col("v") - F.lit(found["v"][0]).cast("double")
    mad = percentiles(points, {"mad": (F.abs(off), (0.5,))})[0]["mad"][0]
    scale = F.greatest(1.4826 * F.lit(mad).cast("double"), 0.5 * F.lit(row["s"]).cast("double"))
    return points.withColumn("z", F.when(scale > 0, off / scale)).filter(F.abs("z") >= EXTREME_Z).orderBy(F.desc(F.abs("z")), "t").limit(k).select("t", "v", "z")


def daily_counts(df: DataFrame, time: str, key: str | None = None) -> DataFrame:
    """Rows per calendar day (and key), zero where a day between the first and the last has none."""
    keys = [key] if key else []
    counts = df.filter(F.col(time).isNotNull()).groupBy(*keys, F.to_date(time).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    span = counts.groupBy(*keys).agg(F.min("day").alias("a"), F.max("day").alias("b")).select(*keys, F.explode(F.sequence("a", "b")).alias("day"))
    return span.join(counts, [*keys, "day"], "left").select(*keys, "day", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def event_summary(df: DataFrame, time: str) -> DataFrame:
    """One row about events per day: totals, the busiest day (the first of several) and the peak month."""
    d = daily_counts(df, time)
    months = d.groupBy(F.month("day").alias("m")).agg(F.sum("n").alias("k")).agg(F.max_by("m", F.struct(F.col("k"), -F.col("m"))).alias("peak_month"))
    top = d.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("days"), F.round(100.0 * F.avg(F.when(F.col("n") > 0, 1.0).otherwise(0.0)), 1).alias("days_with_events_pct"), F.round(F.avg("n"), 3).alias("mean_per_day"), F.max_by("day", F.struct(F.col("n"), -F.unix_date("day"))).alias("busiest_day"), F.max("n").alias("busiest_n"))
    return top.crossJoin(F.broadcast(months))


def month_shares(df: DataFrame, time: str) -> DataFrame:
    """(month, share_pct) of all rows."""
    by = df.filter(F.col(time).isNotNull()).groupBy(F.month(time).alias("month")).count()
    return by.select("month", F.round(100.0 * F.col("count") / F.sum("count").over(Window.partitionBy()), 1).alias("share_pct"))


def event_table_test(df: DataFrame, time: str, has_place: bool) -> DataFrame:
    """One row: rows, days, rows per day and whether the rows are occurrences."""
    rate = F.col("n_rows") / F.col("n_days")
    limit = 1.0 if has_place else 1.5
    s = df.agg(F.count(time).alias("n_rows"), F.count_distinct(F.to_date(time)).alias("n_days"))
    return s.withColumn("rate", F.round(rate, 6)).withColumn("is_event_table", (F.col("n_rows") >= 10) & ((rate >= 1.5) | (rate > limit)))


def series_column_test(df: DataFrame, time: str, columns: list[str]) -> DataFrame:
    """A row per text column: values, share of rows that repeat a (day, value), and whether it separates series."""
    out = [F.struct(F.lit(c).alias("column"), F.count_distinct(c).alias("n"), (1.0 - F.count_distinct(F.to_date(time), F.col(c)) / F.count(F.lit(1))).alias("repeated")) for c in columns]
    rows = df.agg(F.count(F.lit(1)).alias("rows"), F.array(*out).alias("s")).select("rows", F.explode("s").alias("s")).select("rows", "s.*")
    return rows.select("column", "n", F.round("repeated", 6).alias("repeated"), ((F.col("n") > 1) & (F.col("n") <= F.least(F.lit(200.0), F.col("rows") / 3)) & (F.col("repeated") < 0.05)).alias("is_series"))


def lag1_autocorrelation(points: DataFrame) -> DataFrame:
    """One row: Pearson r of each value with the one before."""
    t = points.withColumn("s", F.unix_timestamp(F.col("t").cast("timestamp")))
    width = 86400 * 366
    b = t.withColumn("_b", F.floor(F.col("s") / width))
    prior = b.groupBy("_b").agg(F.max_by("v", "s").alias("_v")).withColumn("_before", F.lag("_v").over(Window.orderBy("_b"))).select("_b", "_before")
    w = Window.partitionBy("_b").orderBy("s")
    return b.join(prior, "_b").select("v", F.coalesce(F.lag("v").over(w), F.col("_before")).alias("p")).agg(F.corr("v", "p").alias("r1"))


def date_runs(df: DataFrame, keys: list[str], day: str, gap: int = 62) -> DataFrame:
    """(keys, start, end, n): runs of days whose neighbours lie at most ``gap`` days apart."""
    w = Window.partitionBy(*keys).orderBy(day)
    d = df.filter(F.col(day).isNotNull()).select(*keys, F.to_date(day).alias(day)).distinct()
    d = d.withColumn("_new", F.when(F.datediff(day, F.lag(day).over(w)) <= gap, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    return d.groupBy(*keys, "_run").agg(F.min(day).alias("start"), F.max(day).alias("end"), F.count(F.lit(1)).alias("n")).drop("_run")


def monthly_counts(df: DataFrame, time: str, key: str | None = None) -> DataFrame:
    """Rows per calendar month (and key): the sums of ``daily_counts``."""
    keys = [key] if key else []
    return daily_counts(df, time, key).groupBy(*keys, F.trunc("day", "month").alias("month")).agg(F.sum("n").alias("n"))


def subsample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows by a seeded hash of their key, the same on every run; a top-n, so no task sorts all rows."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def default_period(coverage: DataFrame, years: int = 10) -> DataFrame:
    """(start_s, end_s): the last ``years`` years of a record, or all of a shorter one."""
    return coverage.select(F.greatest("start_s", F.col("end_s") - years * 365.25 * 86400).alias("start_s"), "end_s")
