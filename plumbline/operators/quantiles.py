"""Exact percentiles in two passes over the data."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

# Accuracy of the first pass, the count of values up to which all are counted in the second, and the columns of one
# second pass (code for more of them gets too long to be compiled).
ACCURACY = 1000
FEW = 20 * ACCURACY
AT_ONCE = 8


def percentiles(df: DataFrame, wanted: dict[str, tuple[Column, tuple[float, ...]]], *others: Column) -> tuple[dict[str, list[float | None]], Row]:
    """Percentiles of each wanted column, as ``percentile`` interpolates them, and a row of other aggregates.

    A first pass brackets each percentile by approximate ones on both sides of it. A second counts the values within brackets one by
    one and those between brackets as one, so no task gets all distinct values. Should a rank lie between brackets, all values of
    its column are counted, spread over tasks.
    """
    names = list(wanted)
    values = [wanted[c][0].cast("double") for c in names]
    near = [[q for p in wanted[c][1] for q in (max(0.0, p - 2 / ACCURACY), min(1.0, p + 2 / ACCURACY))] for c in names]
    first = df.agg(F.struct(*others, F.lit(0).alias("_")).alias("others"), *[F.struct(F.count(v).alias("n"), F.percentile_approx(v, q, ACCURACY).alias("ends")).alias(f"_{i}") for i, (v, q) in enumerate(zip(values, near))]).first()
    found: dict[tuple[int, int], float] = {}
    places = {i: [p * (first[f"_{i}"]["n"] - 1) for p in wanted[c][1]] for i, c in enumerate(names) if first[f"_{i}"]["n"]}
    for whole in (False, True):
        ranks = sorted({(i, r) for i, at in places.items() for x in at for r in (math.floor(x), math.ceil(x))} - set(found))
        if not ranks:
            break
        left = sorted({i for i, _ in ranks})
        brackets = {i: [(-math.inf, math.nan)] if whole or first[f"_{i}"]["n"] <= FEW else _merged(first[f"_{i}"]["ends"]) for i in left}
        for some in (left[k : k + AT_ONCE] for k in range(0, len(left), AT_ONCE)):
            found |= _at_ranks(df, {i: values[i] for i in some}, brackets, [r for r in ranks if r[0] in some])
    out = {c: [None] * len(wanted[c][1]) for c in names}
    for i, at in places.items():
        out[names[i]] = [_between(found[i, math.floor(x)], found[i, math.ceil(x)], x) for x in at]
    return out, first["others"]


def _between(low: float, high: float, x: float) -> float:
    """Interpolated as Spark's ``percentile`` does."""
    return low if low == high or math.floor(x) == math.ceil(x) else (math.ceil(x) - x) * low + (x - math.floor(x)) * high


def _merged(ends: list[float]) -> list[tuple[float, float]]:
    """Disjoint brackets, in order; NaN is the largest value."""
    key = lambda x: (math.isnan(x), x)
    out: list[tuple[float, float]] = []
    for a, b in sorted(zip(ends[::2], ends[1::2]), key=lambda e: key(e[0])):
        if out and key(a) <= key(out[-1][1]):
            out[-1] = (out[-1][0], max(out[-1][1], b, key=key))
        else:
            out.append((a, b))
    return out


def _at_ranks(df: DataFrame, values: dict[int, Column], brackets: dict[int, list[tuple[float, float]]], ranks: list[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """Values at (column, rank), ranks from 0; none for ranks that lie between brackets."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), v.alias("v")) for i, v in values.items()])).alias("x")).select("x.*").filter("v IS NOT NULL")
    block = F.lit(-1)
    for i in values:
        own = F.when(F.col("v") < brackets[i][0][0], 0)
        for j, (a, b) in enumerate(brackets[i]):
            own = (own.when(F.col("v") < a, 2 * j) if j else own).when(F.col("v") <= b, 2 * j + 1)
        block = F.when(F.col("c") == i, own.otherwise(2 * len(brackets[i]))).otherwise(block)
    counts = long.withColumn("block", block).withColumn("v", F.when(F.col("block") % 2 == 1, F.col("v"))).groupBy("c", "block", "v").agg(F.count(F.lit(1)).alias("n"))
    blocks = counts.groupBy("c", "block").agg(F.sum("n").alias("all"))
    before = blocks.select("c", "block", (F.sum("all").over(Window.partitionBy("c").orderBy("block")) - F.col("all")).alias("before"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("c", "block").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    asked = df.sparkSession.createDataFrame(ranks, "c int, rank long")
    place = upto.join(F.broadcast(before), ["c", "block"]).withColumn("end", F.col("before") + F.col("upto"))
    got = place.join(F.broadcast(asked), "c").filter((F.col("rank") < F.col("end")) & (F.col("rank") >= F.col("end") - F.col("n")))
    return {(r["c"], r["rank"]): r["v"] for r in got.select("c", "rank", "block", "v").collect() if r["block"] % 2}
