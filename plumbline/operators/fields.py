"""Fields of a grid over time: area means, trends of pixels, roles and slope by baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import spatial
from plumbline.operators.quantiles import percentiles

# Words that name elevation and vegetation, and the baselines of terrain.
ELEVATION = r"(?i)\b(elevation|dem|dtm|dsm|height|topograph\w*|altitude|terrain|relief)\b|(?i)(?:^|_)(dem|elev)(?:_|$)"
VEGETATION = r"(?i)(?:^|[^a-z])(ndvi|evi|vegetation)(?:[^a-z]|$)"
BASELINES = (10, 20, 30, 60, 100, 200, 300, 500, 1000, 2000, 5000, 10_000)
BASELINE_SLACK, LEAST_SIDE, LEAST_CELLS, HISTOGRAM_BINS = 0.25, 32, 500, 30


def roles(variables: DataFrame, *texts: str) -> DataFrame:
    """``variables`` with is_elevation and is_vegetation, by all that their text columns say.

    Elevation needs two dimensions above 1 (``wide``, where there is that column).
    """
    said = F.concat_ws(" ", *texts)
    two = F.col("wide") == 2 if "wide" in variables.columns else F.lit(True)
    return variables.withColumns({"is_elevation": said.rlike(ELEVATION) & two, "is_vegetation": said.rlike(VEGETATION)})


def box_of(grid: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """One row (west, south, east, north); longitudes from 0 to 360 are turned where they pass 180."""
    turned = F.when(F.col(x) > 180, F.col(x) - 360).otherwise(F.col(x))
    s = grid.agg(F.min(x).alias("a"), F.max(x).alias("b"), F.min(turned).alias("c"), F.max(turned).alias("d"), F.min(y).alias("south"), F.max(y).alias("north"))
    round_the_world = (F.col("a") >= 0) & (F.col("b") > 180)
    return s.select(F.when(round_the_world, F.col("c")).otherwise(F.col("a")).alias("west"), "south", F.when(round_the_world, F.col("d")).otherwise(F.col("b")).alias("east"), "north")


def band_statistics(cells: DataFrame) -> DataFrame:
    """(var, count, missing_pct, min, max, mean, std) of each band, variable or dataset."""
    return cells.groupBy("var").agg(F.count("value").alias("count"), F.round(100.0 * F.avg(F.col("value").isNull().cast("double")), 2).alias("missing_pct"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def area_series(cells: DataFrame, key: str = "t") -> DataFrame:
    """(key, mean, n): means over the grid with cos(latitude) weights."""
    return spatial.area_mean(cells, [key])


def trend_map(cells: DataFrame, year: str) -> DataFrame:
    """One row about the slopes of all pixels: how many, the shares that rise and fall, and those beyond |t| = 2."""
    p = spatial.pixel_trends(cells, ["iy", "ix"], year, "value")
    pct = lambda c: F.round(100.0 * F.avg(F.when(c, 1.0).otherwise(0.0)), 2)
    median = F.lit(percentiles(p, {"slope": (F.col("slope"), (0.5,))})[0]["slope"][0]).cast("double")
    return p.agg(F.count(F.lit(1)).alias("n_pixels"), median.alias("median_slope"), pct(F.col("slope") > 0).alias("rising_pct"), pct(F.col("slope") < 0).alias("falling_pct"), pct(F.abs("t_stat") > 2).alias("significant_pct"))


def factors(cell: float, side: int) -> list[tuple[int, int]]:
    """(baseline, cells of it): baselines that whole blocks of cells reach within the slack, until a side has too few blocks."""
    out = []
    for base in BASELINES:
        f = max(1, round(base / cell))
        if abs(f * cell - base) <= BASELINE_SLACK * base and side // f >= LEAST_SIDE:
            out.append((base, f))
    return out


def baseline_profile(grid: DataFrame, cell: float, side: int) -> DataFrame:
    """(baseline, n, median_slope, p90_slope): slopes of the terrain as blocks of each baseline's size see it.

    Every factor is one aggregation and two windows over its own blocks, which get fewer with the factor.
    """
    out = None
    for base, f in factors(cell, side):
        blocks = grid if f == 1 else spatial.block_mean(grid, f).select(F.col("by").alias("iy"), F.col("bx").alias("ix"), F.col("mean").alias("z"))
        s = spatial.slopes(blocks, cell * f, cell * f).filter("slope IS NOT NULL")
        found, count = percentiles(s, {"slope": (F.col("slope"), (0.5, 0.9))}, F.count(F.lit(1)).alias("n"))
        row = grid.sparkSession.createDataFrame([(base, count["n"], *found["slope"])], "baseline int, n long, median_slope double, p90_slope double").filter(F.col("n") >= LEAST_CELLS)
        out = row if out is None else out.unionByName(row)
    if out is None:
        return grid.sparkSession.createDataFrame([], "baseline int, n long, median_slope double, p90_slope double")
    return out


def colour_histogram(values: DataFrame, value: str, bins: int = 64, whole_bytes: bool = False) -> DataFrame:
    """(bin, n): equal bins over 0 to 255, or over the 0.1th to 99.9th percentile; what lies beyond is in the outer bins."""
    v = values.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    a, b = [F.lit(x).cast("double") for x in ((0.0, 255.0) if whole_bytes else percentiles(v, {"v": (F.col("v"), (0.001, 0.999))})[0]["v"])]
    at = F.floor((F.col("v") - a) / (b - a) * bins)
    return v.filter(b > a).groupBy(F.greatest(F.lit(0), F.least(F.lit(bins - 1), at)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def map_scale(values: DataFrame, value: str) -> DataFrame:
    """One row (low, high, diverging): the 2nd and 98th percentile, made symmetric where they lie on both sides of 0."""
    found, _ = percentiles(values, {"v": (F.col(value), (0.02, 0.98))})
    p = values.sparkSession.createDataFrame([tuple(found["v"])], "a double, b double")
    both = (F.col("a") < 0) & (F.col("b") > 0)
    far = F.greatest(-F.col("a"), F.col("b"))
    return p.select(F.when(both, -far).otherwise(F.col("a")).alias("low"), F.when(both, far).otherwise(F.col("b")).alias("high"), both.alias("diverging"))
