"""Registered queries over the driver's tables, each beside its DuckDB SQL (None where SQL can't express it)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import expr
from plumbline.functions.catalog import CATALOG
from plumbline.operators import claims, documents, fields, profile, rules, series, spatial, trend

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- statistics ---

_NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c})::BIGINT AS count, round(100.0 * (count(*) - count({c})) / count(*), 2)::DOUBLE AS missing_pct, min({c}) AS min, max({c}) AS max, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, round(quantile_cont({c}, 0.05), 6) AS p05, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, round(quantile_cont({c}, 0.95), 6) AS p95 FROM lineitem" for c in _NUM))
def numeric_stats(spark, sf_dir):
    return _rounded(profile.numeric_stats(_t(spark, sf_dir, "lineitem"), list(_NUM)), "mean", "std", "p05", "p25", "p50", "p75", "p95")


_ORD = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(100.0 * count(*) FILTER ({c} IS NULL) / count(*), 2)::DOUBLE AS missing_pct, count(DISTINCT {c})::BIGINT AS n_distinct, substr(arg_min({c}::VARCHAR, o_orderkey), 1, 60) AS example FROM orders" for c in _ORD))
def column_profile(spark, sf_dir):
    return profile.column_profile(_t(spark, sf_dir, "orders").select(*_ORD), "o_orderkey")


@query("SELECT count(*)::BIGINT AS n_rows, 11 AS n_columns FROM lineitem")
def row_column_counts(spark, sf_dir):
    df = _t(spark, sf_dir, "lineitem")
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


@query("WITH e AS (SELECT CASE WHEN event_id % 97 = 0 THEN -999.0 WHEN event_id % 101 = 0 THEN 'inf'::DOUBLE ELSE value END AS v FROM events) SELECT 'v' AS \"column\", count(*) FILTER (v = -999.0 OR isinf(v))::BIGINT AS masked, count(*) FILTER (NOT (v = -999.0 OR isinf(v)))::BIGINT AS valid, round(avg(v) FILTER (NOT (v = -999.0 OR isinf(v))), 6) AS mean FROM e")
def sentinel_clean(spark, sf_dir):
    v = F.when(F.col("event_id") % 97 == 0, F.lit(-999.0)).when(F.col("event_id") % 101 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    return _rounded(profile.sentinel_counts(_t(spark, sf_dir, "events").select(v.alias("v")), ["v"]), "mean")


@query("WITH e AS (SELECT value AS v FROM events), s AS (SELECT min(v) AS lo, max(v) AS hi, least(40, greatest(5, floor(sqrt(count(v)))))::INT AS bins FROM e) SELECT CASE WHEN hi > lo THEN least(bins - 1, floor((v - lo) / (hi - lo) * bins)) ELSE 0 END::INT AS bucket, count(*)::BIGINT AS n FROM e, s GROUP BY 1")
def histogram_data(spark, sf_dir):
    return profile.histogram(_t(spark, sf_dir, "events"), "value")


@query("WITH l AS (SELECT unnest([{'c': 'p_brand', 'v': p_brand}, {'c': 'p_type', 'v': p_type}], recursive := true) FROM part), n AS (SELECT c, v, count(*) AS k FROM l GROUP BY c, v), r AS (SELECT c, v, k, count(*) OVER (PARTITION BY c) AS n, sum(k) OVER (PARTITION BY c) AS t, row_number() OVER (PARTITION BY c ORDER BY k DESC, v) AS rank FROM n) SELECT c AS \"column\", v AS value, round(100.0 * k / t, 1)::DOUBLE AS share_pct, rank::INT AS rank FROM r WHERE n BETWEEN 2 AND 20 AND rank <= 8")
def categories(spark, sf_dir):
    return profile.categories(_t(spark, sf_dir, "part"), ["p_brand", "p_type"])


_PAIRS = [("l_discount", "l_extendedprice"), ("l_discount", "l_quantity"), ("l_discount", "l_tax"), ("l_extendedprice", "l_quantity"), ("l_extendedprice", "l_tax"), ("l_quantity", "l_tax")]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in _PAIRS))
def correlation_matrix(spark, sf_dir):
    return _rounded(profile.correlation_matrix(_t(spark, sf_dir, "lineitem"), list(_NUM)), "r")


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 2) AS r FROM lineitem" for a, b in _PAIRS) + ") WHERE abs(r) >= 0.3 ORDER BY abs(r) DESC LIMIT 5")
def correlations_top5(spark, sf_dir):
    return profile.top_correlations(_t(spark, sf_dir, "lineitem"), list(_NUM))


_CATALOG = [("brass", r"brass|copper"), ("steel", r"steel"), ("small", r"small|tiny"), ("any_part", r"part|item"), ("digits", r"[0-9]{3,}")]


@query("SELECT p_partkey, array_to_string(list_slice(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(p_name || ' ' || p_type), '{p}') THEN '{n}' END" for n, p in _CATALOG) + "], lambda x: x IS NOT NULL), 1, 3), ',') AS products FROM part")
def product_match(spark, sf_dir):
    items = _t(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("t"))
    return profile.product_matches(items, "t", _CATALOG).select("p_partkey", "products")


@query("SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'imerg' WHEN 1 THEN 'merra2' WHEN 2 THEN 'mola' WHEN 3 THEN 'mod13' WHEN 4 THEN 'firms' WHEN 5 THEN 'srtm' WHEN 6 THEN 'mod11,mod13' ELSE '' END AS products FROM part")
def known_products(spark, sf_dir):
    names = ["3B-DAY.MS.MRG.V07.nc4", "MERRA2_400.tavg1.2020.nc4", "megt44n180hb.img", "MOD13A2.A2020001.hdf", "plain.csv", "N31E035.hgt", "MOD11A1 and MYD13 mosaic", "readme"]
    k = F.col("p_partkey") % 8
    items = _t(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))).alias("t"), F.when(k == 4, F.array(F.lit("acq_date"), F.lit("latitude"), F.lit("longitude"), F.lit("frp"))).alias("columns"))
    return profile.product_matches(items, "t", [(n, p) for n, p, _ in CATALOG], columns="columns").select("p_partkey", "products")


# --- filters ---

_LAT, _LON = "20 + (c_nationkey % 5) * 4.0D + (c_custkey % 9) * 0.2D", "-60 + (c_nationkey % 7) * 9.0D + (c_custkey % 5) * 0.3D"


def _places(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.expr(_LAT).alias("lat"), F.expr(_LON).alias("lon"))


_PLACES_SQL = "(SELECT c_custkey, c_acctbal, 20 + (c_nationkey % 5) * 4.0::DOUBLE + (c_custkey % 9) * 0.2::DOUBLE AS lat, -60 + (c_nationkey % 7) * 9.0::DOUBLE + (c_custkey % 5) * 0.3::DOUBLE AS lon FROM customer)"


@query(f"SELECT c_custkey, lat, lon FROM {_PLACES_SQL} WHERE lon BETWEEN -50 AND -20 AND lat BETWEEN 22 AND 30")
def bbox_filter(spark, sf_dir):
    return series.in_box(_places(spark, sf_dir), "lon", "lat", (-50, 22, -20, 30)).select("c_custkey", "lat", "lon")


@query(f"SELECT c_custkey, lon FROM {_PLACES_SQL} WHERE (lon >= -15 OR lon <= -50)")
def bbox_across_date_line(spark, sf_dir):
    return series.in_box(_places(spark, sf_dir), "lon", "lat", (-15, -90, -50, 90)).select("c_custkey", "lon")


@query(f"SELECT min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north, count(*)::BIGINT AS n FROM {_PLACES_SQL}")
def bounding_box(spark, sf_dir):
    return _places(spark, sf_dir).agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1996-12-31'")
def time_filter(spark, sf_dir):
    return series.between(_t(spark, sf_dir, "orders"), "o_orderdate", "1996-01-01", "1996-12-31", False).select("o_orderkey")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-11'")
def partial_day_filter(spark, sf_dir):
    return series.between(_t(spark, sf_dir, "events"), "ts", "2024-01-05", "2024-01-10", True).select("event_id")


# --- time ---

@query("""WITH c AS (SELECT epoch_us(o_orderdate) AS t, count(*) AS n FROM orders GROUP BY 1), d AS (SELECT t, n, t - lag(t) OVER (ORDER BY t) AS d FROM c), m AS (SELECT quantile_cont(d, 0.5) AS m FROM d)
SELECT min(t) / 1e6::DOUBLE AS start_s, max(t) / 1e6::DOUBLE AS end_s, count(*)::BIGINT AS n_steps, any_value(m)::DOUBLE / 1e6 AS median_step_s, (sum(n) - count(*))::BIGINT AS duplicate_times, count(*) FILTER (d > 1.6 * m)::BIGINT AS n_gaps, max(d) / 1e6::DOUBLE AS largest_gap_s FROM d, m""")
def time_coverage(spark, sf_dir):
    return series.time_coverage(_t(spark, sf_dir, "orders"), "o_orderdate")


_DAILY = "(SELECT o_orderdate::DATE AS t, avg(o_totalprice) AS v FROM orders GROUP BY 1)"


def _daily(spark, sf_dir):
    return series.daily_mean(_t(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice")


@query(f"SELECT t, round(v, 6) AS v FROM {_DAILY}")
def mean_per_date(spark, sf_dir):
    return _rounded(_daily(spark, sf_dir), "v")


@query("SELECT date_trunc('month', o_orderdate)::DATE AS month, round(avg(o_totalprice), 6) AS v, count(o_totalprice)::BIGINT AS n FROM orders GROUP BY 1")
def monthly_mean(spark, sf_dir):
    return _rounded(series.monthly(_t(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice"), "v")


@query(f"SELECT month(t)::INT AS month, round(avg(v), 6) AS mean FROM {_DAILY} GROUP BY 1")
def seasonal_cycle(spark, sf_dir):
    return _rounded(series.seasonal_cycle(_daily(spark, sf_dir)), "mean")


@query(f"SELECT t, round(v, 6) AS v, round(v - avg(v) OVER (PARTITION BY month(t)), 6) AS anomaly FROM {_DAILY}")
def anomalies(spark, sf_dir):
    return _rounded(series.anomalies(_daily(spark, sf_dir)), "v", "anomaly")


_YEAR_SQL = "year(t)::DOUBLE + (dayofyear(t)::DOUBLE - 1.0::DOUBLE) / (CASE WHEN year(t) % 4 = 0 AND (year(t) % 100 <> 0 OR year(t) % 400 = 0) THEN 366.0::DOUBLE ELSE 365.0::DOUBLE END)"


@query(f"WITH x AS (SELECT {_YEAR_SQL} AS x, v FROM {_DAILY}) SELECT round(regr_slope(v, x), 4) AS slope_per_year, round(10 * regr_slope(v, x), 4) AS slope_per_decade, round(regr_r2(v, x), 8) AS r2, round(regr_intercept(v, x), 1) AS intercept, count(*)::BIGINT AS n FROM x")
def ols_trend(spark, sf_dir):
    t = series.linear_trend(_daily(spark, sf_dir))
    return t.withColumns({"slope_per_year": F.round("slope_per_year", 4), "slope_per_decade": F.round("slope_per_decade", 4), "r2": F.round("r2", 8), "intercept": F.round("intercept", 1)})


@query(f"""WITH d AS (SELECT row_number() OVER (ORDER BY t) AS k, v FROM {_DAILY}), p AS (SELECT sign(b.v - a.v) AS s, (b.v - a.v) / (b.k - a.k) AS w FROM d a JOIN d b ON a.k < b.k), g AS (SELECT count(*)::DOUBLE AS g FROM d GROUP BY v), n AS (SELECT count(*)::DOUBLE AS n FROM d)
SELECT (SELECT sum(s) FROM p)::BIGINT AS s, ((SELECT n * (n - 1) * (2 * n + 5) FROM n) - (SELECT sum(g * (g - 1) * (2 * g + 5)) FROM g)) / 18 AS variance, round((SELECT quantile_cont(w, 0.5) FROM p), 6) AS slope""")
def mann_kendall_and_sen(spark, sf_dir):
    return _rounded(trend.kendall(_daily(spark, sf_dir)), "slope")


_MONTHLY = "(SELECT date_trunc('month', o_orderdate)::DATE AS t, avg(o_totalprice) AS v FROM orders GROUP BY 1)"


@query(f"""WITH d AS (SELECT row_number() OVER (ORDER BY t) - 1 AS k, v FROM {_MONTHLY}), p AS (SELECT sign(b.v - a.v) AS s, (b.v - a.v) / ((b.k - a.k) / 12) AS w FROM d a JOIN d b ON a.k < b.k AND a.k % 12 = b.k % 12), g AS (SELECT k % 12 AS m, count(*)::DOUBLE AS n FROM d GROUP BY 1)
SELECT (SELECT sum(s) FROM p)::BIGINT AS s, (SELECT sum(n * (n - 1) * (2 * n + 5)) / 18 FROM g) AS variance, round((SELECT quantile_cont(w, 0.5) FROM p), 6) AS slope""")
def seasonal_mann_kendall(spark, sf_dir):
    m = series.monthly(_t(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice").select(F.col("month").alias("t"), "v")
    return _rounded(trend.seasonal_test(m), "slope")


@query()
def trend_tests(spark, sf_dir):
    return trend.tests(_daily(spark, sf_dir))


@query()
def trends_by_status(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return trend.trends(o.groupBy(F.col("o_orderstatus").alias("key"), F.to_date("o_orderdate").alias("t")).agg(F.avg("o_totalprice").alias("v")))


@query(f"SELECT round(corr(v, p), 6) AS r1 FROM (SELECT v, lag(v) OVER (ORDER BY t) AS p FROM {_DAILY})")
def lag1_autocorrelation(spark, sf_dir):
    return _rounded(series.lag1_autocorrelation(_daily(spark, sf_dir)), "r1")


@query("""WITH p AS (SELECT event_id AS t, CASE WHEN event_id % 997 = 0 THEN value + 100000 ELSE value END AS v FROM events), m AS (SELECT quantile_cont(v, 0.5) AS m, stddev_pop(v) AS s FROM p), a AS (SELECT quantile_cont(abs(v - m), 0.5) AS mad FROM p, m), z AS (SELECT t, v, (v - m) / greatest(1.4826 * mad, 0.5 * s) AS z FROM p, m, a)
SELECT t, v, round(z, 6) AS z FROM z WHERE abs(z) >= 5 ORDER BY abs(z) DESC, t LIMIT 5""")
def extremes_robust_z(spark, sf_dir):
    v = F.when(F.col("event_id") % 997 == 0, F.col("value") + 100000).otherwise(F.col("value"))
    return _rounded(series.extremes(_t(spark, sf_dir, "events").select(F.col("event_id").alias("t"), v.alias("v"))), "z")


# --- events ---

@query("""WITH c AS (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT event_type, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM c GROUP BY 1)
SELECT s.event_type, s.day, coalesce(c.n, 0)::BIGINT AS n FROM s LEFT JOIN c USING (event_type, day)""")
def daily_counts_zero_filled(spark, sf_dir):
    return series.daily_counts(_t(spark, sf_dir, "events"), "ts", "event_type")


_SHIP = """WITH c AS (SELECT l_shipdate::DATE AS day, count(*) AS n FROM lineitem GROUP BY 1), d AS (SELECT s.day, coalesce(c.n, 0) AS n FROM (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM c) s LEFT JOIN c USING (day))"""


@query(_SHIP + """, m AS (SELECT month(day) AS m, sum(n) AS k FROM d GROUP BY 1)
SELECT sum(n)::BIGINT AS total, count(*)::BIGINT AS days, round(100.0 * avg(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END), 1)::DOUBLE AS days_with_events_pct, round(avg(n), 3) AS mean_per_day, (SELECT day FROM d ORDER BY n DESC, day LIMIT 1) AS busiest_day, max(n)::BIGINT AS busiest_n, (SELECT m FROM m ORDER BY k DESC, m LIMIT 1)::INT AS peak_month FROM d""")
def event_summary(spark, sf_dir):
    return series.event_summary(_t(spark, sf_dir, "lineitem"), "l_shipdate")


@query("SELECT month(l_shipdate)::INT AS month, round(100.0 * count(*) / sum(count(*)) OVER (), 1)::DOUBLE AS share_pct FROM lineitem GROUP BY 1")
def month_share(spark, sf_dir):
    return series.month_shares(_t(spark, sf_dir, "lineitem"), "l_shipdate")


@query("SELECT count(ts)::BIGINT AS n_rows, count(DISTINCT ts::DATE)::BIGINT AS n_days, round(count(ts) / count(DISTINCT ts::DATE), 6) AS rate, count(ts) >= 10 AND count(ts) / count(DISTINCT ts::DATE) >= 1.5 AS is_event_table FROM events")
def event_table_test(spark, sf_dir):
    return series.event_table_test(_t(spark, sf_dir, "events"), "ts", False)


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c})::BIGINT AS n, round(1.0 - count(DISTINCT (o_orderdate::DATE, {c})) / count(*), 6) AS repeated, count(DISTINCT {c}) > 1 AND count(DISTINCT {c}) <= least(200, count(*) / 3) AND 1.0 - count(DISTINCT (o_orderdate::DATE, {c})) / count(*) < 0.05 AS is_series FROM orders" for c in ("o_orderstatus", "o_orderpriority")))
def series_column_test(spark, sf_dir):
    return series.series_column_test(_t(spark, sf_dir, "orders"), "o_orderdate", ["o_orderstatus", "o_orderpriority"])


@query(f"""WITH RECURSIVE c AS (SELECT floor(lat / 0.5)::INT AS r, floor(lon / 0.5)::INT AS c, count(*) AS n, sum(lon) AS sx, sum(lat) AS sy, min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS t FROM {_PLACES_SQL} GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (ORDER BY r, c) AS id FROM c WHERE n >= greatest(2, 0.002 * (SELECT sum(n) FROM c))),
e AS (SELECT x.id AS a, y.id AS b FROM b x JOIN b y ON abs(x.r - y.r) <= 1 AND abs(x.c - y.c) <= 1),
k AS (SELECT id AS a, id AS b FROM b UNION SELECT k.a, e.b FROM k JOIN e ON e.a = k.b),
m AS (SELECT a AS id, min(b) AS root FROM k GROUP BY a),
h AS (SELECT root, sum(n)::BIGINT AS n, sum(sx) AS sx, sum(sy) AS sy, min(w) AS west, min(s) AS south, max(e) AS east, max(t) AS north FROM b JOIN m USING (id) GROUP BY root),
z AS (SELECT *, row_number() OVER (ORDER BY n DESC, south, west)::INT AS rank FROM h)
SELECT rank, n, round(100.0 * n / (SELECT sum(n) FROM c), 1)::DOUBLE AS share_pct, round(sx / n, 4) AS lon, round(sy / n, 4) AS lat, west, south, east, north FROM z WHERE rank <= 5""")
def hotspots(spark, sf_dir):
    return spatial.hotspots(_places(spark, sf_dir), "lon", "lat")


# --- quality ---

@query("""WITH v AS (SELECT CASE WHEN event_id % 50 = 0 THEN -9999.0 ELSE value END AS precip, CASE WHEN event_id % 3 = 0 THEN value END AS sparse, CASE WHEN event_id % 4 < 3 THEN NULL ELSE value END AS rare, 7.0::DOUBLE AS flat, value * 3 AS ndvi FROM events),
s AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS c, count({c}) AS n, 100.0 * (count(*) - count({c})) / count(*) AS miss, min({c}) AS lo, max({c}) AS hi, stddev_pop({c}) AS sd, quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM v" for c in ("precip", "sparse", "rare", "flat", "ndvi")) + """)
SELECT c AS "column", 'error' AS level, 'undeclared_fill' AS code FROM s WHERE n > 0 AND (lo = -9999 OR hi = -9999)
UNION ALL SELECT c, 'warning', 'mostly_missing' FROM s WHERE round(miss, 2) > 50 UNION ALL SELECT c, 'info', 'missing' FROM s WHERE round(miss, 2) > 20 AND round(miss, 2) <= 50
UNION ALL SELECT c, 'info', 'constant' FROM s WHERE n > 1 AND sd = 0 UNION ALL SELECT c, 'warning', 'negative_values' FROM s WHERE c = 'precip' AND lo < 0
UNION ALL SELECT c, 'warning', 'unscaled' FROM s WHERE c = 'ndvi' AND (lo < -1.0001 OR hi > 1.0001)
UNION ALL SELECT c, 'info', 'outliers' FROM s WHERE b - a > 0 AND abs(a) > 1e-6 * greatest(1, abs(hi)) AND (hi > b + 20 * (b - a) OR lo < a - 20 * (b - a))""")
def quality_flags(spark, sf_dir):
    v, k = F.col("value"), F.col("event_id")
    df = _t(spark, sf_dir, "events").select(F.when(k % 50 == 0, F.lit(-9999.0)).otherwise(v).alias("precip"), F.when(k % 3 == 0, v).alias("sparse"), F.when(k % 4 < 3, None).otherwise(v).alias("rare"), F.lit(7.0).alias("flat"), (v * 3).alias("ndvi"))
    return rules.value_issues(profile.numeric_stats(df, df.columns))


@query("""WITH c AS (SELECT epoch_us(ts) AS t, count(*) AS n FROM events GROUP BY 1), d AS (SELECT t, n, t - lag(t) OVER (ORDER BY t) AS d FROM c), m AS (SELECT quantile_cont(d, 0.5) AS m FROM d)
SELECT 'warning' AS level, 'duplicate_times' AS code FROM d HAVING sum(n) > count(*) UNION ALL SELECT 'info', 'time_gaps' FROM d, m HAVING count(*) FILTER (d > 1.6 * m) > 0 UNION ALL SELECT 'warning', 'short_record' FROM d HAVING (max(t) - min(t)) / (86400e6 * 365.25) < 1.95""")
def coverage_flags(spark, sf_dir):
    return rules.coverage_issues(series.time_coverage(_t(spark, sf_dir, "events"), "ts"))


@query(r"""SELECT doc_id, 'warning' AS level, 'little_text' AS code FROM documents WHERE len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) < 50 UNION ALL SELECT doc_id, 'info', 'no_sections' FROM documents WHERE NOT regexp_matches(text, '(?m)^[ \t\n\x0B\f\r]*(?:[0-9]{1,2}(?:\.[0-9]{1,2})*\.?[ \t\n\x0B\f\r]+)?[A-Z][A-Za-z ,&-]{2,60}$')""")
def document_flags(spark, sf_dir):
    return rules.document_issues(_t(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def claim_verification(spark, sf_dir):
    stats = profile.numeric_stats(_t(spark, sf_dir, "lineitem"), ["l_quantity"]).first()
    facts = {"statistics.l_quantity.mean": stats["mean"], "statistics.l_quantity.max": stats["max"], "trends.l_quantity.slope_per_year": 0.01, "trends.l_quantity.mk_p": 0.4}
    said = [(f"The mean l_quantity is {stats['mean']:.1f}.", float(round(stats["mean"], 1)), "statistics.l_quantity.mean"), ("The mean is 9999.", 9999.0, "statistics.l_quantity.mean"), ("The median is 3.", 3.0, "statistics.l_quantity.p50"), ("About 123456 items were lost.", None, None), ("Quantities look even.", None, None), ("Quantity rises by 0.01 a year.", 0.01, "trends.l_quantity.slope_per_year")]
    return claims.verify(spark.createDataFrame(said, "text string, value double, fact string"), claims.facts_table(spark, facts))


# --- documents ---

@query("""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents), s AS (SELECT doc_id, w, unnest(generate_series(0, greatest(0, len(w) - 1), 350)) AS s FROM w WHERE len(w) > 0)
SELECT doc_id, (s // 350)::INT AS chunk, len(list_slice(w, s + 1, s + 400))::INT AS n_words, array_to_string(list_slice(w, s + 1, s + 400), ' ') AS chunk_text FROM s""")
def doc_chunks(spark, sf_dir):
    return documents.chunks(_t(spark, sf_dir, "documents"))


_STOP_SQL = ", ".join(f"'{w}'" for w in documents.STOP_WORDS)


@query(rf"SELECT word, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z][a-z\-]{{2,}}')) AS word FROM documents) WHERE word NOT IN ({_STOP_SQL}) GROUP BY 1 ORDER BY n DESC, word LIMIT 25")
def keyword_top25(spark, sf_dir):
    return documents.keywords(_t(spark, sf_dir, "documents"))


_TERMS = ["the", "from", "und", "token", "idiot", "license"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS term, count(DISTINCT doc_id)::BIGINT AS n_pages, min(doc_id)::BIGINT AS first_page FROM documents WHERE regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{N}}_]){t}($|[^\\p{{L}}\\p{{N}}_])') HAVING count(*) > 0" for t in _TERMS))
def mentions_by_page(spark, sf_dir):
    return documents.mentions(_t(spark, sf_dir, "documents"), "doc_id", "text", _TERMS)


@query(r"""WITH d AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_\-]{2,}')) AS term FROM documents), f AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM d GROUP BY ALL), g AS (SELECT term, count(*)::DOUBLE AS df FROM f GROUP BY 1), n AS (SELECT count(*)::DOUBLE AS n FROM documents),
w AS (SELECT doc_id, term, df, n, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM f JOIN g USING (term), n), m AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1),
r AS (SELECT doc_id, sum(w / norm * (1 + ln(q.tf)) * (ln((1 + n) / (1 + df)) + 1)) AS score FROM w JOIN m USING (doc_id) JOIN (VALUES ('the', 1.0::DOUBLE), ('that', 2.0::DOUBLE), ('worthless', 1.0::DOUBLE)) q(term, tf) USING (term) GROUP BY 1)
SELECT doc_id, round(score, 6) AS score FROM r ORDER BY round(score, 9) DESC, doc_id LIMIT 6""")
def tfidf_search(spark, sf_dir):
    return _rounded(documents.search(_t(spark, sf_dir, "documents"), "the that worthless that"), "score")


_QUERY_VECTOR = [((7 * i) % 13 - 6) / 10 for i in range(64)]


@query(f"SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], {_QUERY_VECTOR}::DOUBLE[]), 6) AS score FROM embeddings ORDER BY list_dot_product(embedding::DOUBLE[], {_QUERY_VECTOR}::DOUBLE[]) DESC, vec_id LIMIT 6")
def vector_topk(spark, sf_dir):
    return _rounded(documents.vector_top(_t(spark, sf_dir, "embeddings"), _QUERY_VECTOR, "vec_id", "embedding"), "score")


@query(r"""SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS h1, len(regexp_extract_all(html, '(?i)<p[ >]'))::BIGINT AS n_paragraphs, len(regexp_extract_all(html, '(?i)<a '))::BIGINT AS n_links, regexp_extract(html, '(?i)<html[^>]*lang="([a-z]+)"', 1) AS lang FROM pages""")
def html_title_headings(spark, sf_dir):
    return documents.page_structure(_t(spark, sf_dir, "pages"))


_SENTENCE_SQL = "(SELECT o_orderkey AS k, 'Records from ' || (1950 + o_orderkey % 40) || ' to ' || (1991 + o_orderkey % 30) || ' show ' || (o_custkey % 90) || ' mm and ' || (o_custkey % 7) || '.5 %.' AS s FROM orders)"


def _sentences(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return _t(spark, sf_dir, "orders").select(k.alias("k"), F.concat(F.lit("Records from "), (1950 + k % 40).cast("string"), F.lit(" to "), (1991 + k % 30).cast("string"), F.lit(" show "), (c % 90).cast("string"), F.lit(" mm and "), (c % 7).cast("string"), F.lit(".5 %.")).alias("s"))


@query(rf"SELECT min(regexp_extract(s, '((?:19|20)\d\d) to ((?:19|20)\d\d)', 1)::INT) AS start_year, max(regexp_extract(s, '((?:19|20)\d\d) to ((?:19|20)\d\d)', 2)::INT) AS end_year, count(*)::BIGINT AS n FROM {_SENTENCE_SQL}")
def study_period(spark, sf_dir):
    return documents.study_period(_sentences(spark, sf_dir), "s")


@query(rf"SELECT k, unnest(regexp_extract_all(s, '\d+(?:\.\d+)? (?:mm|%)')) AS quantity FROM {_SENTENCE_SQL}")
def key_quantities(spark, sf_dir):
    return documents.quantities(_sentences(spark, sf_dir), "k", "s")


@query()
def page_packing(spark, sf_dir):
    return documents.pack_pages(_t(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 120)


@query(r"SELECT role, count(*)::BIGINT AS turns, count(DISTINCT conv_id)::BIGINT AS conversations, sum(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')))::BIGINT AS words FROM conversations GROUP BY role")
def conversation_roles(spark, sf_dir):
    return documents.latest_turns(_t(spark, sf_dir, "conversations"))


# --- scalar functions ---

@query("SELECT c_custkey, pmod_lon AS lon, greatest(1, floor(length(c_name) / 3.5))::INT AS tokens FROM (SELECT c_custkey, c_name, ((c_custkey * 17.0::DOUBLE + 180) % 360 + 360) % 360 - 180 AS pmod_lon FROM customer)")
def scalar_functions(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", expr.wrap_longitude(F.col("c_custkey") * F.lit(17.0)).alias("lon"), expr.token_estimate(F.col("c_name")).alias("tokens"))


@query(r"SELECT url, substr(regexp_replace(regexp_replace(url, '[^A-Za-z0-9_.\-]+', '_', 'g'), '^[_.]+|[_.]+$', '', 'g'), 1, 150) AS name FROM pages")
def safe_names(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("url", expr.safe_name(F.col("url")).alias("name"))


@query(f"SELECT o_orderkey, round({_YEAR_SQL.replace('(t)', '(o_orderdate)')}, 9) AS y FROM orders")
def decimal_years(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.round(expr.decimal_year(F.col("o_orderdate")), 9).alias("y"))


# --- grids and terrain: made from ranges, the same in both engines ---

_SIDE = 96


def _grid(spark):
    k = F.col("id")
    g = spark.range(24 * 12 * 10).select((k % 24).cast("int").alias("t"), F.floor(k / 24).alias("p")).select("t", (F.col("p") % 12).cast("int").alias("iy"), F.floor(F.col("p") / 12).cast("int").alias("ix"))
    v = (F.col("t") * F.col("iy") % 17 + F.col("ix") * 3 + F.col("t") * 0.25).cast("double")
    return g.select("t", "iy", "ix", (-60.0 + F.col("iy") * 10.0).alias("y"), F.when((F.col("t") + F.col("iy") + F.col("ix")) % 11 != 0, v).alias("value"))


_GRID_SQL = "(SELECT t, iy, ix, -60.0::DOUBLE + iy * 10.0::DOUBLE AS y, CASE WHEN (t + iy + ix) % 11 <> 0 THEN (t * iy % 17 + ix * 3 + t * 0.25)::DOUBLE END AS value FROM (SELECT (i % 24)::INT AS t, ((i // 24) % 12)::INT AS iy, ((i // 24) // 12)::INT AS ix FROM range(24 * 12 * 10) r(i)))"


@query(f"SELECT t, round(sum(value * cos(radians(y))) / sum(CASE WHEN value IS NOT NULL THEN cos(radians(y)) END), 6) AS mean, count(value)::BIGINT AS n FROM {_GRID_SQL} GROUP BY t")
def area_mean_weighted(spark, sf_dir):
    return _rounded(spatial.area_mean(_grid(spark), ["t"]), "mean")


@query(f"WITH g AS (SELECT iy, ix, regr_slope(value, t) AS slope, regr_sxx(value, t) AS sxx, regr_syy(value, t) AS syy, count(*) AS n FROM {_GRID_SQL} WHERE value IS NOT NULL GROUP BY ALL) SELECT iy, ix, round(slope, 6) AS slope, round(slope / sqrt((syy - slope * slope * sxx) / (n - 2) / sxx), 4) AS t_stat, n::BIGINT AS n FROM g WHERE n >= 8 AND iy > 0")
def pixel_trend_map(spark, sf_dir):
    p = spatial.pixel_trends(_grid(spark).filter("iy > 0"), ["iy", "ix"], "t", "value")
    return p.withColumns({"slope": F.round("slope", 6), "t_stat": F.round("t_stat", 4)})


def _dem(spark):
    k = F.col("id")
    g = spark.range(_SIDE * _SIDE).select((F.floor(k / _SIDE)).cast("int").alias("iy"), (k % _SIDE).cast("int").alias("ix"))
    bowl = F.greatest(F.lit(0), 100 - (F.col("iy") - 40) * (F.col("iy") - 40) - (F.col("ix") - 50) * (F.col("ix") - 50))
    return g.withColumn("z", (200 + 2 * F.col("iy") + F.col("ix") + (F.col("iy") * F.col("ix") * 7) % 5 - bowl).cast("double"))


_DEM_SQL = f"(SELECT iy, ix, (200 + 2 * iy + ix + (iy * ix * 7) % 5 - greatest(0, 100 - (iy - 40) * (iy - 40) - (ix - 50) * (ix - 50)))::DOUBLE AS z FROM (SELECT (i // {_SIDE})::INT AS iy, (i % {_SIDE})::INT AS ix FROM range({_SIDE * _SIDE}) r(i)))"
_GRADIENT = lambda w, d: f"CASE WHEN lead(z) OVER {w} IS NOT NULL AND lag(z) OVER {w} IS NOT NULL THEN (lead(z) OVER {w} - lag(z) OVER {w}) / 2.0 ELSE coalesce(lead(z) OVER {w} - z, z - lag(z) OVER {w}) END / {d}.0"
_SLOPE_SQL = f"(SELECT iy, ix, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope FROM (SELECT iy, ix, {_GRADIENT('(PARTITION BY iy ORDER BY ix)', 30)} AS gx, {_GRADIENT('(PARTITION BY ix ORDER BY iy)', 30)} AS gy FROM {_DEM_SQL}))"


@query(f"SELECT (iy // 5)::INT AS by, (ix // 5)::INT AS bx, round(avg(z), 6) AS mean, count(*)::BIGINT AS n FROM {_DEM_SQL} GROUP BY 1, 2 HAVING count(*) = 25")
def block_mean(spark, sf_dir):
    return _rounded(spatial.block_mean(_dem(spark), 5), "mean")


@query(f"SELECT iy, ix, round(slope, 6) AS slope FROM {_SLOPE_SQL}")
def slope_degrees(spark, sf_dir):
    return _rounded(spatial.slopes(_dem(spark), 30.0, 30.0), "slope")


@query(f"SELECT a.iy, a.ix, round(avg(abs(b.z - a.z)), 6) AS tri FROM {_DEM_SQL} a JOIN {_DEM_SQL} b ON abs(a.iy - b.iy) <= 1 AND abs(a.ix - b.ix) <= 1 AND (a.iy <> b.iy OR a.ix <> b.ix) GROUP BY 1, 2")
def ruggedness_index(spark, sf_dir):
    return _rounded(spatial.ruggedness(_dem(spark)), "tri")


@query(f"SELECT round(quantile_cont(slope, 0.5), 6) AS median_slope, round(quantile_cont(slope, 0.9), 6) AS p90_slope, round(quantile_cont(slope, 0.999), 6) AS p999_slope, " + ", ".join(f"round(100.0 * avg(CASE WHEN slope < {k} THEN 1.0 ELSE 0.0 END), 4)::DOUBLE AS below_{k}_pct" for k in (5, 10, 15, 25)) + f" FROM {_SLOPE_SQL}")
def terrain_summary(spark, sf_dir):
    return _rounded(spatial.terrain_summary(spatial.slopes(_dem(spark), 30.0, 30.0)), "median_slope", "p90_slope", "p999_slope")


@query(f"SELECT floor(least(slope, 60 - 1e-9))::INT AS bin, count(*)::BIGINT AS n FROM {_SLOPE_SQL} GROUP BY 1")
def slope_histogram(spark, sf_dir):
    return spatial.slope_histogram(spatial.slopes(_dem(spark), 30.0, 30.0))


@query(f"SELECT min(z) AS min, quantile_cont(z, 0.05) AS p05, quantile_cont(z, 0.5) AS median, quantile_cont(z, 0.95) AS p95, max(z) AS max, quantile_cont(z, 0.99) - quantile_cont(z, 0.01) AS relief, 0.0::DOUBLE AS voids_pct FROM {_DEM_SQL}")
def elevation_summary(spark, sf_dir):
    return spatial.elevation_summary(_dem(spark))


@query(f"""WITH g AS (SELECT iy, ix, {_GRADIENT('(PARTITION BY iy ORDER BY ix)', 30)} AS gx, {_GRADIENT('(PARTITION BY ix ORDER BY iy)', 30)} AS gy FROM {_DEM_SQL}), a AS (SELECT iy, ix, atan(sqrt(gx * gx + gy * gy)) AS slope, atan2(gy, -gx) AS aspect FROM g)
SELECT iy, ix, round(greatest(0.0, least(1.0, sin(radians(45.0)) * cos(slope) + cos(radians(45.0)) * sin(slope) * cos(radians(135.0) - aspect))), 6) AS shade FROM a""")
def hillshade(spark, sf_dir):
    return _rounded(spatial.hillshade(_dem(spark), 30.0, 30.0), "shade")


@query()
def depressions(spark, sf_dir):
    return spatial.depressions(_dem(spark), 30.0, 30.0, 1.0)


@query("WITH v AS (SELECT ((event_id * 37) % 12000 - 1500)::DOUBLE AS v FROM events), s AS (SELECT CASE WHEN (SELECT quantile_cont(abs(v), 0.99) FROM v) > 1.5 THEN v / 10000.0 ELSE v END AS v FROM v), f AS (SELECT v FROM s WHERE v BETWEEN -1 AND 1) SELECT round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, " + ", ".join(f"round(100.0 * avg(CASE WHEN v >= {a} AND v < {b} THEN 1.0 ELSE 0.0 END), 2)::DOUBLE AS \"{n.replace('.', '_')}\"" for n, a, b in spatial.NDVI_CLASSES) + " FROM f")
def ndvi_classes(spark, sf_dir):
    return spatial.ndvi_classes(_t(spark, sf_dir, "events").select(((F.col("event_id") * 37) % 12000 - 1500).cast("double").alias("v")))


def _pixels(spark):
    k = F.col("id")
    g = spark.range(80 * 64).select(F.floor(k / 80).cast("int").alias("iy"), (k % 80).cast("int").alias("ix"))
    return g.select("iy", "ix", ((F.col("ix") * 3 % 256) / 255.0).alias("r"), ((F.col("iy") * 5 % 256) / 255.0).alias("g"), (((F.col("ix") + F.col("iy")) % 7) * 36 / 255.0).alias("b"))


_PIXELS_SQL = "(SELECT iy, ix, (ix * 3 % 256) / 255.0::DOUBLE AS r, (iy * 5 % 256) / 255.0::DOUBLE AS g, ((ix + iy) % 7) * 36 / 255.0::DOUBLE AS b FROM (SELECT (i // 80)::INT AS iy, (i % 80)::INT AS ix FROM range(80 * 64) p(i)))"


@query(f"""WITH p AS (SELECT *, 0.2126 * r + 0.7152 * g + 0.0722 * b AS lum, CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) ELSE 0 END AS sat, r - g AS rg, 0.5 * (r + g) - b AS yb FROM {_PIXELS_SQL}),
q AS (SELECT *, lag(lum) OVER x AS l, lead(lum) OVER x AS rr, lag(lum) OVER y AS u, lead(lum) OVER y AS d FROM p WINDOW x AS (PARTITION BY iy ORDER BY ix), y AS (PARTITION BY ix ORDER BY iy)),
e AS (SELECT *, CASE WHEN l IS NOT NULL AND rr IS NOT NULL THEN (rr - l) / 2 ELSE coalesce(rr - lum, lum - l) END AS gx, CASE WHEN u IS NOT NULL AND d IS NOT NULL THEN (d - u) / 2 ELSE coalesce(d - lum, lum - u) END AS gy, (l + rr + u + d - 4 * lum) * 255 AS lap FROM q)
SELECT round(100 * avg(lum), 1) AS brightness_pct, round(100 * stddev_pop(lum), 1) AS contrast_pct, round(100.0 * avg((lum < 0.02)::INT), 1) AS dark_clipped_pct, round(100.0 * avg((lum > 0.98)::INT), 1) AS bright_clipped_pct, round(100 * avg(sat), 1) AS saturation_pct, round(100 * (sqrt(var_pop(rg) + var_pop(yb)) + 0.3 * sqrt(avg(rg) ** 2 + avg(yb) ** 2)), 1) AS colourfulness, round(var_pop(lap), 1) AS sharpness, round(100.0 * avg((gx * gx + gy * gy > 0.01)::INT), 1) AS edge_density_pct, round(100.0 * avg((lum > 0.75 AND sat < 0.15)::INT), 1) AS white_pct, round(100.0 * avg((lum < 0.1)::INT), 1) AS dark_pct FROM e""")
def image_metrics(spark, sf_dir):
    return spatial.image_metrics(_pixels(spark))


@query(f"WITH c AS (SELECT floor(r * 3.999)::INT * 16 + floor(g * 3.999)::INT * 4 + floor(b * 3.999)::INT AS code, count(*) AS n FROM {_PIXELS_SQL} GROUP BY 1), s AS (SELECT code, 100.0 * n / sum(n) OVER () AS share, row_number() OVER (ORDER BY n DESC, code)::INT AS rank FROM c) SELECT rank, code, round(share, 1)::DOUBLE AS share_pct FROM s WHERE rank <= 5 AND share >= 1")
def dominant_colours(spark, sf_dir):
    return spatial.dominant_colours(_pixels(spark))


# --- fields, runs and reviews ---


@query(f"SELECT 'v' AS var, count(value)::BIGINT AS count, round(100.0 * avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 2)::DOUBLE AS missing_pct, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM {_GRID_SQL}")
def band_statistics(spark, sf_dir):
    return _rounded(fields.band_statistics(_grid(spark).withColumn("var", F.lit("v"))), "mean", "std")


@query(f"WITH g AS (SELECT iy, ix, regr_slope(value, t) AS slope, regr_sxx(value, t) AS sxx, regr_syy(value, t) AS syy, count(*) AS n FROM {_GRID_SQL} WHERE value IS NOT NULL AND iy > 0 GROUP BY ALL), p AS (SELECT slope, slope / sqrt((syy - slope * slope * sxx) / (n - 2) / sxx) AS t FROM g WHERE n >= 8) SELECT count(*)::BIGINT AS n_pixels, round(quantile_cont(slope, 0.5), 6) AS median_slope, round(100.0 * avg((slope > 0)::INT), 2)::DOUBLE AS rising_pct, round(100.0 * avg((slope < 0)::INT), 2)::DOUBLE AS falling_pct, round(100.0 * avg((abs(t) > 2)::INT), 2)::DOUBLE AS significant_pct FROM p")
def trend_map(spark, sf_dir):
    return _rounded(fields.trend_map(_grid(spark).filter("iy > 0"), "t"), "median_slope")


@query(" UNION ALL ".join(f"SELECT {base} AS baseline, count(*)::BIGINT AS n, round(quantile_cont(slope, 0.5), 6) AS median_slope, round(quantile_cont(slope, 0.9), 6) AS p90_slope FROM (SELECT degrees(atan(sqrt(gx * gx + gy * gy))) AS slope FROM (SELECT {_GRADIENT('(PARTITION BY iy ORDER BY ix)', 10 * f)} AS gx, {_GRADIENT('(PARTITION BY ix ORDER BY iy)', 10 * f)} AS gy FROM (SELECT iy // {f} AS iy, ix // {f} AS ix, avg(z) AS z FROM {_DEM_SQL} GROUP BY 1, 2 HAVING count(*) = {f * f}))) WHERE slope IS NOT NULL HAVING count(*) >= 500" for base, f in fields.factors(10.0, _SIDE)))
def baseline_profile(spark, sf_dir):
    return _rounded(fields.baseline_profile(_dem(spark), 10.0, _SIDE), "median_slope", "p90_slope")


@query("WITH e AS (SELECT quantile_cont(value, 0.001) AS a, quantile_cont(value, 0.999) AS b FROM events) SELECT greatest(0, least(63, floor((value - a) / (b - a) * 64)))::INT AS bin, count(*)::BIGINT AS n FROM events, e WHERE value IS NOT NULL GROUP BY 1")
def colour_histogram(spark, sf_dir):
    return fields.colour_histogram(_t(spark, sf_dir, "events"), "value")


@query("WITH p AS (SELECT quantile_cont(value - 50, 0.02) AS a, quantile_cont(value - 50, 0.98) AS b FROM events) SELECT round(CASE WHEN a < 0 AND b > 0 THEN -greatest(-a, b) ELSE a END, 6) AS low, round(CASE WHEN a < 0 AND b > 0 THEN greatest(-a, b) ELSE b END, 6) AS high, a < 0 AND b > 0 AS diverging FROM p")
def map_scale(spark, sf_dir):
    return _rounded(fields.map_scale(_t(spark, sf_dir, "events").select((F.col("value") - 50).alias("v")), "v"), "low", "high")


@query("""WITH d AS (SELECT DISTINCT o_custkey, o_orderdate::DATE AS day FROM orders), f AS (SELECT *, CASE WHEN day - lag(day) OVER w <= 62 THEN 0 ELSE 1 END AS new FROM d WINDOW w AS (PARTITION BY o_custkey ORDER BY day)), r AS (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY day) AS run FROM f)
SELECT o_custkey, min(day) AS start, max(day) AS "end", count(*)::BIGINT AS n FROM r GROUP BY o_custkey, run""")
def date_runs(spark, sf_dir):
    return series.date_runs(_t(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day")), ["o_custkey"], "day")


@query("SELECT event_type, date_trunc('month', ts)::DATE AS month, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def monthly_counts(spark, sf_dir):
    return series.monthly_counts(_t(spark, sf_dir, "events"), "ts", "event_type")


@query("SELECT event_id, value FROM events ORDER BY md5('3:' || event_id::VARCHAR), event_id LIMIT 200")
def seeded_subsample(spark, sf_dir):
    return series.subsample(_t(spark, sf_dir, "events").select("event_id", "value"), "event_id", 200, 3)


@query("WITH c AS (SELECT max(epoch_us(o_orderdate)) / 1e6 AS b, min(epoch_us(o_orderdate)) / 1e6 AS a FROM orders) SELECT greatest(a, b - 5 * 365.25 * 86400)::DOUBLE AS start_s, b::DOUBLE AS end_s FROM c")
def default_period(spark, sf_dir):
    return series.default_period(series.time_coverage(_t(spark, sf_dir, "orders"), "o_orderdate"), 5)


@query("SELECT o_orderstatus AS status, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def status_tally(spark, sf_dir):
    return claims.tally(_t(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status")))


@query(r"""WITH t AS (SELECT doc_id AS page, ' ' || trim(lower(regexp_replace(text, '[^\p{L}\p{N}]+', ' ', 'g'))) || ' ' AS t FROM documents WHERE text IS NOT NULL),
q AS (SELECT doc_id AS page, substr(text, 11, 60) AS quote FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id + 1, substr(text, 5, 90) FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id + 5, substr(text, 1, 80) FROM documents WHERE text IS NOT NULL),
w AS (SELECT *, trim(lower(regexp_replace(quote, '[^\p{L}\p{N}]+', ' ', 'g'))) AS w FROM q),
h AS (SELECT w.page, w.quote, arg_min(t.page, abs(t.page - w.page) * 10 + (t.page > w.page)::INT) AS found_page FROM w JOIN t ON t.page BETWEEN w.page - 1 AND w.page + 1 AND w.w <> '' AND contains(t.t, ' ' || w.w || ' ') GROUP BY w.page, w.quote)
SELECT q.page, q.quote, h.found_page FROM q LEFT JOIN h ON h.page = q.page AND h.quote = q.quote""")
def page_quotes(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("page"), "text")
    part = lambda shift, a, n: d.select((F.col("page") + shift).alias("page"), F.substring("text", a, n).alias("quote"))
    return claims.find_quotes(part(0, 11, 60).unionByName(part(1, 5, 90)).unionByName(part(5, 1, 80)), d)


@query("SELECT event_type AS \"case\", count(*)::BIGINT AS n, count(*) FILTER (value > 20)::BIGINT AS passed, round(avg((value > 20)::INT), 4)::DOUBLE AS score FROM events GROUP BY 1")
def case_scores(spark, sf_dir):
    return claims.scores(_t(spark, sf_dir, "events").select(F.col("event_type").alias("case"), F.col("event_id").alias("check"), (F.col("value") > 20).alias("passed")))


@query("SELECT p_partkey, p_name, regexp_matches(p_name, '(?i)\\b(elevation|dem|dtm|dsm|height|topograph\\w*|altitude|terrain|relief)\\b') AS is_elevation, regexp_matches(p_name, '(?i)(^|[^a-z])(ndvi|evi|vegetation)([^a-z]|$)') AS is_vegetation FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'surface elevation ' || p_name WHEN 1 THEN 'mean NDVI of ' || p_name WHEN 2 THEN 'redemption ' || p_name ELSE p_name END AS p_name FROM part)")
def variable_roles(spark, sf_dir):
    k = F.col("p_partkey") % 5
    lead = F.when(k == 0, "surface elevation ").when(k == 1, "mean NDVI of ").when(k == 2, "redemption ").otherwise("")
    return fields.roles(_t(spark, sf_dir, "part").select("p_partkey", F.concat(lead, F.col("p_name")).alias("p_name")), "p_name")
