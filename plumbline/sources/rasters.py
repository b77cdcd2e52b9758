"""Raster sources: raw elevation tiles, label files of planetary images, and formats whose libraries are absent."""

from __future__ import annotations

import re
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.registry import Dataset, NotThisFormat, Options, missing_library, reader

VOID = -32768
# Mean radii in metres, and axes that coordinate systems give.
RADII = {"Earth": 6_371_008.8, "Moon": 1_737_400.0, "Mars": 3_389_500.0, "Mercury": 2_439_400.0, "Venus": 6_051_800.0}
AXES = ((1_737_400.0, "Moon"), (1_737_150.0, "Moon"), (3_396_190.0, "Mars"), (3_396_000.0, "Mars"), (3_389_500.0, "Mars"), (3_393_400.0, "Mars"), (2_439_400.0, "Mercury"), (2_440_000.0, "Mercury"), (6_051_800.0, "Venus"), (6_051_000.0, "Venus"))
NAMES = {"moon": "Moon", "lunar": "Moon", "luna": "Moon", "mars": "Mars", "martian": "Mars", "mercury": "Mercury", "venus": "Venus", "earth": "Earth"}
AXIS_SLACK = 0.005


def label_facts(text: str) -> dict[str, str]:
    """What the ``KEY = value`` and ``"key": value`` lines of a label say."""
    pairs = (re.split(r"\s*[=:]\s*", line, maxsplit=1) for line in text.splitlines())
    return {p[0].strip(" \t'\"{,"): p[1].strip(" \t'\"},;") for p in pairs if len(p) == 2}


def crs_facts(crs: str) -> tuple[set[str], float | None]:
    """(words of a coordinate system's text, its longer radius in metres if it gives one)."""
    cells = [c for c in re.split(r'[\[\](),"\s]+', crs) if c]
    named = dict(c[1:].split("=", 1) for c in cells if c.startswith("+") and "=" in c)
    sizes = [named[k] for k in ("R", "a") if k in named]
    at = next((i for i, c in enumerate(cells) if c.upper() in ("ELLIPSOID", "SPHEROID")), len(cells))
    sizes += [c for c in cells[at + 1 :] if re.fullmatch(r"\d+(\.\d*)?", c) and float(c) > 1e5]
    words = {w.lower() for c in cells for w in re.split(r"[^A-Za-z]+", c)}
    return words, float(sizes[0]) if sizes else None


def body_of(crs: str = "", label: str = "") -> str:
    """The planet or moon that a label's target or a coordinate system's words or radius tell; else Earth."""
    targets = [v for k, v in label_facts(label).items() if k.rsplit("_", 1)[0].lower() in ("target", "planet", "body")]
    words, radius = crs_facts(crs)
    told = [NAMES[t.lower()] for t in targets if t.lower() in NAMES] + sorted(NAMES[w] for w in words & set(NAMES) - {"earth"})
    if told:
        return told[0]
    gap, name = min((abs(radius - axis) / axis, name) for axis, name in AXES) if radius else (1.0, "")
    return name if gap < AXIS_SLACK else "Earth"


def tile_cells(tiles: DataFrame) -> DataFrame:
    """(path, iy, ix, y, x, z) of raw big-endian 16-bit tiles named by their south-west corner; voids are null.

    ``tiles`` has path and content, as Spark's binaryFile source gives them; each tile is one row.
    """

    def run(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                m = re.search(r"([NS])(\d{1,2})([EW])(\d{1,3})", path.rsplit("/", 1)[-1], re.I)
                side = int(round((len(content) / 2) ** 0.5))
                if not m or side * side * 2 != len(content):
                    continue
                south = int(m[2]) * (1 if m[1].upper() == "N" else -1)
                west = int(m[4]) * (1 if m[3].upper() == "E" else -1)
                z = np.frombuffer(content, ">i2").astype(float)
                iy, ix = np.divmod(np.arange(side * side), side)
                yield pd.DataFrame({"path": path, "iy": iy, "ix": ix, "y": south + 1 - iy / (side - 1), "x": west + ix / (side - 1), "z": np.where(z == VOID, np.nan, z)})

    cells = tiles.select("path", "content").mapInPandas(run, "path string, iy int, ix int, y double, x double, z double")
    return cells.withColumn("z", F.when(~F.isnan("z"), F.col("z")))


@reader("elevation-tile", "Raster", extensions=(".hgt",), priority=5)
def read_tile(spark: SparkSession, path: Path, options: Options) -> Dataset:
    n = path.stat().st_size
    if int(round((n / 2) ** 0.5)) ** 2 * 2 != n or not re.match(r"[NS]\d{1,2}[EW]\d{1,3}", path.name, re.I):
        raise NotThisFormat("not a square tile named by its corner")
    return Dataset("grid", tile_cells(spark.read.format("binaryFile").load(str(path))), {"side": int(round((n / 2) ** 0.5)), "variable": "elevation", "units": "m"})


for _name, _module, _ends, _magic in (
    ("netcdf", "netCDF4", (".nc", ".nc4"), (b"\x89HDF",)), ("hdf5", "h5py", (".h5", ".hdf5", ".he5"), (b"\x89HDF",)), ("hdf4", "pyhdf", (".hdf",), (b"\x0e\x03\x13\x01",)), ("grib", "cfgrib", (".grib", ".grib2", ".grb"), (b"GRIB",)),
    ("planetary", "rasterio", (".lbl", ".img", ".cub"), ()), ("image", "PIL", (".jpg", ".jpeg", ".webp"), (b"\xff\xd8\xff",)),
):
    missing_library(_name, "Raster", _module, extensions=_ends, magic=_magic)
