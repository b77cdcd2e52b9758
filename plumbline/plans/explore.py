"""From a path to a report: open, find roles, run the fixed battery of aggregates, check, write.

Rows stay on the executors; the driver gathers aggregates of a few rows each.
"""

from __future__ import annotations

import math
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.catalog import CATALOG
from plumbline.functions.expr import decimal_year, human_delta, without_sentinels
from plumbline.operators import documents, fields, profile, rules, series, spatial, trend
from plumbline.sources import files, registry
from plumbline.sources.registry import Dataset, Options

# Names of roles.
TIME_NAME = re.compile(r"date|time|timestamp|datetime|acq_date|day|month|year|^ts$|^t$", re.I)
LAT_NAME, LON_NAME = re.compile(r"^(lat|latitude|y_lat|lat_deg)$", re.I), re.compile(r"^(lon|long|longitude|lng|x_lon|lon_deg)$", re.I)
FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyyMMdd", "yyyy/MM/dd", "MM/dd/yyyy", "dd/MM/yyyy", "dd.MM.yyyy")
TOP_QUANTITIES = 40


def find_time(df: DataFrame) -> tuple[DataFrame, str | None]:
    """``df`` with ``_time``, and the column it comes from. One aggregate tries every format on every candidate.

    Day-first is chosen only where some first part is beyond 12 and no second part is.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    lower = {c.lower(): c for c in df.columns}
    pick = lambda *names: next((lower[n] for n in names if n in lower), None)
    y, m, d = pick("year"), pick("mo", "month"), pick("dy", "day")
    if y and m and d:
        made = F.expr(f"try_to_timestamp(format_string('%04d-%02d-%02d', cast(`{y}` as int), cast(`{m}` as int), cast(`{d}` as int)), 'yyyy-MM-dd')")
        return df.withColumn("_time", made.cast("timestamp_ntz")), f"{y}+{m}+{d}"
    doy = pick("doy", "dayofyear")
    if y and doy:
        return df.withColumn("_time", F.expr(f"cast(date_add(make_date(cast(`{y}` as int), 1, 1), cast(`{doy}` as int) - 1) as timestamp_ntz)")), f"{y}+{doy}"
    for c, k in kinds.items():
        if isinstance(k, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return df.withColumn("_time", F.col(f"`{c}`").cast("timestamp_ntz")), c
    named = sorted(kinds, key=lambda c: not TIME_NAME.search(c))
    text = [c for c in named if isinstance(kinds[c], T.StringType)]
    number = [c for c in named if isinstance(kinds[c], T.NumericType) and TIME_NAME.search(c)]
    if text:
        parsed = {(c, f): F.expr(f"try_to_timestamp(trim(`{c}`), \"{f}\")") for c in text for f in FORMATS}
        part = lambda c, i: F.expr(f"try_cast(regexp_extract(`{c}`, '^\\\\s*(\\\\d{{1,2}})[-/.](\\\\d{{1,2}})[-/.]', {i}) AS int)")
        s = df.agg(*[F.avg(F.when(F.col(f"`{c}`").isNotNull(), p.isNotNull().cast("double"))).alias(f"{text.index(c)}|{f}") for (c, f), p in parsed.items()], *[F.max(part(c, i)).alias(f"{text.index(c)}#{i}") for c in text for i in (1, 2)]).first()
        for c in text:
            k = text.index(c)
            day_first = (s[f"{k}#1"] or 0) > 12 and (s[f"{k}#2"] or 0) <= 12
            order = [f for f in FORMATS if not f.startswith("dd/" if not day_first else "MM/")]
            good = [f for f in order if (s[f"{k}|{f}"] or 0) > 0.9]
            if good:
                return df.withColumn("_time", parsed[(c, good[0])].cast("timestamp_ntz")), c
    if number:
        s = df.agg(*[F.struct(F.min(f"`{c}`").alias("a"), F.max(f"`{c}`").alias("b")).alias(f"_{i}") for i, c in enumerate(number)]).first()
        for i, c in enumerate(number):
            a, b = s[f"_{i}"]["a"], s[f"_{i}"]["b"]
            if a is None:
                continue
            if 1e11 <= a and b <= 4.2e12:
                return df.withColumn("_time", F.timestamp_millis(F.col(f"`{c}`").cast("long")).cast("timestamp_ntz")), c
            if 1e8 <= a and b <= 4.2e9:
                return df.withColumn("_time", F.timestamp_seconds(F.col(f"`{c}`").cast("long")).cast("timestamp_ntz")), c
            if 19000101 <= a and b <= 21001231:
                return df.withColumn("_time", F.expr(f"try_to_timestamp(cast(cast(`{c}` as long) as string), 'yyyyMMdd')").cast("timestamp_ntz")), c
            if c.lower() == "year" and 1000 <= a and b <= 3000:
                return df.withColumn("_time", F.expr(f"cast(make_date(cast(`{c}` as int), 1, 1) as timestamp_ntz)")), c
    return df, None


def find_place(df: DataFrame) -> tuple[str | None, str | None]:
    """(latitude, longitude) columns by name and range."""
    numeric = profile.numeric_columns(df)
    lat, lon = next((c for c in numeric if LAT_NAME.match(c)), None), next((c for c in numeric if LON_NAME.match(c)), None)
    if not lat or not lon:
        return None, None
    s = df.agg(F.max(F.abs(f"`{lat}`")).alias("a"), F.max(F.abs(f"`{lon}`")).alias("b")).first()
    return (lat, lon) if s["a"] is not None and s["b"] is not None and s["a"] <= 90 and s["b"] <= 360 else (None, None)


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(True) for r in df.collect()]


def analyze_table(df: DataFrame, options: Options) -> dict:
    """Statistics, coverage, events or trends, categories and correlations of a table."""
    df = df.toDF(*[re.sub(r"[.`]", "_", c) for c in df.columns])
    numeric = profile.numeric_columns(df)
    df = df.select(*[without_sentinels(F.col(f"`{c}`")).alias(c) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{c}`") for c in df.columns])
    df, time = find_time(df)
    lat, lon = find_place(df)
    if options.var and options.var not in df.columns:
        raise KeyError(f"{options.var} is not among {', '.join(df.columns)}")
    notes = []
    if options.bbox and lat:
        df = series.in_box(df, lon, lat, options.bbox)
        notes.append(f"rows within {options.bbox}")
    if time and (options.start or options.end):
        df = series.between(df, "_time", options.start or "0001-01-01", options.end or "9999-12-31", False)
    skip = {lat, lon, time, *(time or "").split("+")}
    columns = sorted((c for c in numeric if c not in skip), key=lambda c: c != options.var)
    kept = df.cache()
    try:
        out: dict = {"summary": {"n_rows": kept.count(), "n_columns": len(kept.columns) - ("_time" in kept.columns)}, "notes": notes}
        if not out["summary"]["n_rows"]:
            return out
        out["statistics"] = _rows(profile.numeric_stats(kept, columns)) if columns else []
        if lat:
            out["coverage_place"] = kept.agg(F.min(lon).alias("west"), F.min(lat).alias("south"), F.max(lon).alias("east"), F.max(lat).alias("north")).first().asDict()
        text = [f.name for f in kept.schema.fields if isinstance(f.dataType, T.StringType) and f.name != time]
        if time:
            cover = series.time_coverage(kept, "_time").first().asDict()
            cover["resolution"] = human_delta(cover["median_step_s"])
            out["coverage"] = cover
            apart = [r["column"] for r in _rows(series.series_column_test(kept, "_time", text)) if r["is_series"]] if text and cover["duplicate_times"] else []
            event = series.event_table_test(kept, "_time", lat is not None).first()["is_event_table"]
            if apart:
                out["series_column"] = apart[0]
            elif event:
                out["events"] = series.event_summary(kept, "_time").first().asDict()
                cover.pop("n_gaps"), cover.pop("largest_gap_s")
                if lat:
                    out["events"]["hotspots"] = _rows(spatial.hotspots(kept, lon, lat))
            if columns:
                long = kept.select("_time", F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns])).alias("x")).select(F.col("x.key").alias("key"), F.to_date("_time").alias("t"), F.col("x.v").alias("v"))
                found = trend.trends(long.filter("t IS NOT NULL AND v IS NOT NULL"))
                out["trends"] = _rows(found)
                out["trend_text"] = _rows(rules.trend_wording(found))
        out["categories"] = _rows(profile.categories(kept, text)) if text else []
        out["correlations"] = _rows(profile.top_correlations(kept, columns)) if len(columns) > 1 else []
        out["quality"] = _rows(rules.value_issues(profile.numeric_stats(kept, columns))) if columns else []
        if time:
            out["quality"] += _rows(rules.coverage_issues(series.time_coverage(kept, "_time")))
            if columns:
                out["quality"] += _rows(rules.trend_issues(found))
        if lat:
            out["quality"] += _rows(rules.place_issues(kept.agg(F.min(lon).alias("west"), F.min(lat).alias("south"), F.max(lon).alias("east"), F.max(lat).alias("north"))))
        return out
    finally:
        kept.unpersist()


def analyze_grid(df: DataFrame, options: Options) -> dict:
    """Elevation summary, slopes and depressions of a (iy, ix, y, x, z) grid."""
    if options.bbox:
        df = series.in_box(df, "x", "y", options.bbox)
    step = df.agg(((F.max("y") - F.min("y")) / (F.max("iy") - F.min("iy"))).alias("d"), F.avg("y").alias("lat")).first()
    metres = abs(step["d"] or 0) * 111_194.9
    east = metres * max(0.01, math.cos(math.radians(step["lat"] or 0)))
    slope = spatial.slopes(df, east or 1.0, metres or 1.0)
    return {"summary": {"n_cells": df.count()}, "elevation": spatial.elevation_summary(df).first().asDict(), "terrain": spatial.terrain_summary(slope).first().asDict(), "slope_histogram": _rows(spatial.slope_histogram(slope).orderBy("bin"))}


def analyze_document(df: DataFrame, options: Options) -> dict:
    """Words, keywords, study period and quantities of pages of text."""
    words = df.agg(F.sum(F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))).alias("n_words"), F.count(F.lit(1)).alias("n_pages")).first().asDict()
    return {"summary": words, "keywords": _rows(documents.keywords(df)), "study_period": documents.study_period(df, "text").first().asDict(), "quantities": [r["quantity"] for r in documents.quantities(df, "page", "text").groupBy("quantity").count().orderBy(F.desc("count"), "quantity").limit(TOP_QUANTITIES).collect()], "quality": _rows(rules.document_issues(df, "page", "text"))}


def analyze_field(df: DataFrame, options: Options, meta: dict | None = None) -> dict:
    """A variable on a grid: statistics, box, the series of area means with its trend, and trends of pixels.

    A field without time whose name or attributes say elevation gets the terrain's figures.
    """
    meta = meta or {}
    if options.bbox:
        df = series.in_box(df.withColumn("x", F.when(F.col("x") > 180, F.col("x") - 360).otherwise(F.col("x"))), "x", "y", options.bbox)
    if "t" in df.columns and (options.start or options.end):
        df = series.between(df, "t", options.start or "0001-01-01", options.end or "9999-12-31", True)
    kept = df.cache()
    try:
        value = kept.select(F.col("value").alias(meta.get("variable") or "value"))
        stats = profile.numeric_stats(value, value.columns)
        out: dict = {"summary": {"n_cells": kept.count(), "dimensions": meta.get("dims", {})}, "statistics": _rows(stats), "bands": _rows(fields.band_statistics(kept).orderBy("var")), "coverage_place": fields.box_of(kept).first().asDict(), "quality": _rows(rules.value_issues(stats.withColumn("units", F.lit(meta.get("units") or "")), "units"))}
        out["quality"] += _rows(rules.place_issues(kept.agg(F.min("x").alias("west"), F.min("y").alias("south"), F.max("x").alias("east"), F.max("y").alias("north"))))
        out["map_scale"] = fields.map_scale(kept, "value").first().asDict()
        if "t" in kept.columns:
            cover = series.time_coverage(kept, "t").first().asDict() | {"duplicate_times": 0}
            out["coverage"] = cover | {"resolution": human_delta(cover["median_step_s"])}
            means = fields.area_series(kept).filter("mean IS NOT NULL").select(F.lit(meta.get("variable") or "value").alias("key"), "t", F.col("mean").alias("v"))
            found = trend.trends(means)
            out["trends"] = _rows(found)
            out["trend_text"] = [r["text"] for r in _rows(rules.trend_wording(found, meta.get("units") or ""))]
            out["trend_map"] = fields.trend_map(kept.withColumn("year", decimal_year(F.col("t"))), "year").first().asDict()
            out["quality"] += _rows(rules.trend_issues(found)) + _rows(rules.extreme_issues(series.extremes(means), (cover["median_step_s"] or 0) / 86400))
            return out
        said = df.sparkSession.createDataFrame([(" ".join([str(meta.get("variable")), *map(str, meta.get("attributes", {}).values())]), 2)], "said string, wide int")
        if fields.roles(said, "said").first()["is_elevation"]:
            out |= analyze_grid(kept.select("iy", "ix", "y", "x", F.col("value").alias("z")), Options())
        return out
    finally:
        kept.unpersist()


def analyze_image(df: DataFrame, options: Options) -> dict:
    """Brightness, sharpness and colours of a picture."""
    return {"image": spatial.image_metrics(df).first().asDict(), "colours": _rows(spatial.dominant_colours(df))}


ANALYZERS = {"field": analyze_field, "image": analyze_image, "table": analyze_table, "grid": analyze_grid, "document": analyze_document}


def analyze(found: Dataset, options: Options) -> dict:
    """The battery for the dataset's kind; what can't be read says why."""
    out = {"kind": found.kind, "reader": found.reader, "meta": found.meta, "problems": found.problems}
    if found.df is not None and found.kind in ANALYZERS:
        out |= ANALYZERS[found.kind](found.df, options, *([found.meta] if found.kind == "field" else []))
    elif found.kind == "binary":
        out["quality"] = [{"level": "error", "code": "unreadable"}]
    return out


def known_products(spark: SparkSession, name: str, found: Dataset) -> list[dict]:
    """Data sets that a file's name, attributes, header text or columns tell."""
    said = " ".join([name, *(str(found.meta.get(k, "")) for k in ("attributes", "header_text", "title"))])
    columns = [c.lower() for c in found.df.columns] if found.df is not None else []
    keys = profile.product_matches(spark.createDataFrame([(said, columns)], "said string, names array<string>"), "said", [(k, p) for k, p, _ in CATALOG], columns="names").first()["products"]
    return [{"key": k, "resolution": r} for k, _, r in CATALOG if k in keys.split(",")]


def explore(spark: SparkSession, path: str | Path, out: str | Path | None = None, options: Options | None = None, reuse: bool = False) -> list[dict]:
    """Results of every file below ``path``; archives are opened; reports are written to ``out``."""
    path, options, results = Path(path), options or Options(), []
    target = Path(out) if out else None

    def handle(p: Path, depth: int) -> None:
        name = re.sub(r"[^\w.\-]+", "_", p.name).strip("_")[:150] or "file"
        if reuse and target and files.fresh(p, target / f"{name}.json", target / f"{name}.html"):
            return
        if files.is_archive(p) and depth < files.MOST_DEPTH:
            try:
                with files.work_folder(spark) as tmp:
                    for m in files.unpack(p, tmp / "members"):
                        handle(m, depth + 1)
                return
            except ValueError as e:
                result = {"kind": "binary", "file": p.name, "error": str(e)}
        elif p.is_file() and not p.stat().st_size:
            result = {"kind": "binary", "file": p.name, "quality": [{"level": "error", "code": "empty_file"}]}
        else:
            try:
                found = registry.read(spark, p, options)
                result = {"file": p.name, "products": known_products(spark, p.name, found), **analyze(found, options)}
            except Exception as e:  # noqa: BLE001  a file that fails is a report with an error
                result = {"kind": "binary", "file": p.name, "error": f"{type(e).__name__}: {e}"}
        results.append(result)
        if target:
            files.write_report(target, name, result)

    for p in files.inputs(path, target) if path.is_dir() and not path.name.endswith(".parquet") else [path]:
        handle(p, 0)
    if target:
        files.write_index(target)
    return results
