"""Column statistics, profiles, categories, correlations and histograms."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.catalog import COLUMNS, TOP
from plumbline.functions.constants import CATEGORY_MAX, CORRELATION_MIN
from plumbline.functions.expr import finite
from plumbline.operators.quantiles import percentiles

PERCENTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """Numbers, not booleans, that aren't excluded."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def numeric_stats(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """A row per column: count, missing_pct, min, max, mean, std (population) and percentiles.

    Exact percentiles take a second pass over the rows, at once; ``approximate`` is one aggregate.
    """
    names = ("p05", "p25", "p50", "p75", "p95")
    out = []
    for c in columns:
        v = finite(F.col(c))
        p = [F.percentile_approx(v, list(PERCENTILES), 10_000).alias("p")] if approximate else []
        out.append(F.struct(F.lit(c).alias("column"), F.count(v).alias("count"), F.round(100.0 * (F.count(F.lit(1)) - F.count(v)) / F.count(F.lit(1)), 2).alias("missing_pct"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), *p))
    if not approximate:
        found, row = percentiles(df, {c: (finite(F.col(c)), PERCENTILES) for c in columns}, F.array(*out).alias("s"))
        return df.sparkSession.createDataFrame([(*s, *found[s["column"]]) for s in row["s"]], "column string, count long, missing_pct double, min double, max double, mean double, std double, " + ", ".join(f"{n} double" for n in names))
    rows = df.agg(F.array(*out).alias("s")).select(F.explode("s").alias("s")).select("s.*")
    return rows.select("column", "count", "missing_pct", "min", "max", "mean", "std", *[F.col("p")[i].alias(n) for i, n in enumerate(names)])


def column_profile(df: DataFrame, order: str) -> DataFrame:
    """A row per column: missing_pct, distinct values and the first value by ``order``, from one aggregate."""
    first = lambda c: F.min_by(F.col(c).cast("string"), F.when(F.col(c).isNotNull(), F.col(order)))
    out = [F.struct(F.lit(c).alias("column"), F.round(100.0 * F.count_if(F.col(c).isNull()) / F.count(F.lit(1)), 2).alias("missing_pct"), F.count_distinct(c).alias("n_distinct"), F.substring(first(c), 1, 60).alias("example")) for c in df.columns]
    return df.agg(F.array(*out).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def categories(df: DataFrame, columns: list[str], top: int = 8) -> DataFrame:
    """Shares (percent, 1 dp) of the most frequent values of text columns with 2 to ``CATEGORY_MAX`` values."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*").filter("value IS NOT NULL")
    counts = long.groupBy("column", "value").count()
    own = Window.partitionBy("column")
    ranked = counts.withColumns({"n": F.count(F.lit(1)).over(own), "total": F.sum("count").over(own), "rank": F.row_number().over(own.orderBy(F.desc("count"), "value"))})
    return ranked.filter((F.col("n") >= 2) & (F.col("n") <= CATEGORY_MAX) & (F.col("rank") <= top)).select("column", "value", F.round(100.0 * F.col("count") / F.col("total"), 1).alias("share_pct"), F.col("rank").cast("int").alias("rank"))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of each pair of columns over rows where both are given, from one aggregate."""
    pairs = list(combinations(sorted(columns), 2))
    out = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(finite(F.col(a)), finite(F.col(b))).alias("r")) for a, b in pairs]
    return df.agg(F.array(*out).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def top_correlations(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """The strongest pairs with |r| of at least ``CORRELATION_MIN``."""
    return correlation_matrix(df, columns).filter(F.abs("r") >= CORRELATION_MIN).orderBy(F.desc(F.abs("r")), F.desc("a"), F.desc("b")).limit(k).withColumn("r", F.round("r", 2))


def histogram(df: DataFrame, column: str, most: int = 40, least: int = 5) -> DataFrame:
    """(bucket, n): equal bins between minimum and maximum, about the square root of the count of them."""
    v = finite(F.col(column))
    s = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.least(F.lit(most), F.greatest(F.lit(least), F.floor(F.sqrt(F.count(v))))).cast("int").alias("bins"))
    x = df.select(v.alias("v")).filter("v IS NOT NULL").crossJoin(F.broadcast(s))
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.col("bins") - 1, F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("bins")))).otherwise(0)
    return x.groupBy(b.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def sentinel_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """How many values of each column stand for missing."""
    from plumbline.functions.expr import without_sentinels

    out = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNotNull() & without_sentinels(F.col(c)).isNull()).alias("masked"), F.count(without_sentinels(F.col(c))).alias("valid"), F.avg(without_sentinels(F.col(c))).alias("mean")) for c in columns]
    return df.agg(F.array(*out).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def product_matches(items: DataFrame, text: str, catalog: list[tuple[str, str]], top: int = TOP, columns: str | None = None) -> DataFrame:
    """Each item with the first ``top`` catalog entries (name, pattern) that its text matches, in catalog order.

    ``columns`` may name an array of lower-case column names, by which some data sets are known as well.
    """
    by_columns = lambda n: F.size(F.array_except(F.array(*map(F.lit, COLUMNS[n])), F.coalesce(F.col(columns), F.array().cast("array<string>")))) == 0 if columns and n in COLUMNS else F.lit(False)
    hits = F.filter(F.array(*[F.when(F.coalesce(F.lower(F.col(text)).rlike(p), F.lit(False)) | by_columns(n), F.lit(n)) for n, p in catalog]), lambda x: x.isNotNull())
    return items.withColumn("products", F.array_join(F.slice(hits, 1, top), ","))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
