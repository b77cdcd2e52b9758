"""Gridded binary files read without their libraries: classic NetCDF, baseline GeoTIFF, FITS and chunk stores.

The driver reads headers only. A file becomes a table of slabs (a record of a variable, a strip or tile, a band of
rows, a chunk), each with its place in the file; tasks read and decode their own slabs into cells. A slab holds
``SLAB_CELLS`` cells or the format's own block, so a file of any size is many small tasks. Cells:
(var, k, iy, ix, y, x, value), k counting what lies outside the last two dimensions; masked cells are null.
"""

from __future__ import annotations

import json
import math
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.registry import Dataset, NotThisFormat, Options, reader

SLAB_CELLS = 1 << 20
CELLS = "var string, k long, iy int, ix int, y double, x double, value double"
# Names and units that tell a coordinate.
LATITUDE = ("lat", "latitude", "y", "nav_lat"), ("degrees_north", "degree_north", "degrees_n"), "latitude"
LONGITUDE = ("lon", "longitude", "x", "nav_lon"), ("degrees_east", "degree_east", "degrees_e"), "longitude"
TIME_NAMES = ("time", "t", "date", "valid_time")
UNITS_OF_TIME = {"second": 1.0, "sec": 1.0, "minute": 60.0, "min": 60.0, "hour": 3600.0, "hr": 3600.0, "day": 86400.0}


@dataclass
class Variable:
    """A variable's shape, type and place; ``begin`` and ``stride`` are bytes (of one record, if it has records)."""

    name: str
    dims: tuple[str, ...]
    shape: tuple[int, ...]
    dtype: str
    begin: int = 0
    stride: int = 0
    records: bool = False
    attrs: dict = field(default_factory=dict)


def coordinate(variables: dict[str, Variable], kind: tuple) -> str | None:
    """The one-dimensional variable that is a coordinate of a kind, by standard name, units, then its own name."""
    names, units, standard = kind
    flat = [v for v in variables.values() if len(v.shape) == 1]
    tests = (lambda v: str(v.attrs.get("standard_name", "")).lower() == standard, lambda v: str(v.attrs.get("units", "")).lower() in units, lambda v: v.name.lower() in names)
    return next((v.name for test in tests for v in flat if test(v)), None)


def main_variable(variables: dict[str, Variable], asked: str | None = None) -> Variable:
    """The variable asked for, or the largest numeric one of two dimensions or more."""
    fields = {v.name: v for v in variables.values() if len(v.shape) >= 2 and np.dtype(v.dtype).kind in "iuf"}
    if asked is not None:
        if asked not in fields:
            raise KeyError(f"{asked} is not among {', '.join(fields)}")
        return fields[asked]
    if not fields:
        raise NotThisFormat("no variable of two dimensions")
    return max(fields.values(), key=lambda v: math.prod(v.shape))


def decoding(attrs: dict) -> dict:
    """How raw values become numbers: fills and bounds in raw units, then factor and offset by either convention."""
    one = lambda *names: next((float(np.ravel(attrs[n])[0]) for n in names if n in attrs and not isinstance(attrs[n], str)), None)
    bounds = attrs.get("valid_range")
    low, high = (float(bounds[0]), float(bounds[1])) if bounds is not None and len(bounds) == 2 else (one("valid_min"), one("valid_max"))
    factor, shift = one("scale_factor"), one("add_offset")
    if factor is None and one("Slope", "slope") is not None:
        factor, shift = one("Slope", "slope"), one("Intercept", "intercept")
    return {"fills": [f for f in (one("_FillValue"), one("missing_value")) if f is not None], "low": low, "high": high, "factor": 1.0 if factor is None else factor, "shift": shift or 0.0}


def decoded(raw: np.ndarray, how: dict) -> np.ndarray:
    """Raw values as numbers; what is masked or not finite is NaN."""
    value = raw.astype(np.float64)
    bad = ~np.isfinite(value)
    for f in how["fills"]:
        bad |= value == f
    if how["low"] is not None:
        bad |= value < how["low"]
    if how["high"] is not None:
        bad |= value > how["high"]
    return np.where(bad, np.nan, value * how["factor"] + how["shift"])


def _bytes(path: str, start: int, size: int) -> bytes:
    with open(path, "rb") as f:
        f.seek(start)
        return f.read(size)


def _unpacked(raw: bytes, codec: str) -> bytes:
    if codec == "zlib":
        return zlib.decompress(raw)
    if codec == "gzip":
        return zlib.decompress(raw, 47)
    if codec == "zstd":
        import zstandard

        return zstandard.decompress(raw)
    return raw


def cells(spark: SparkSession, slabs: list[dict], shared: dict) -> DataFrame:
    """Cells of slabs (path, start, size, rows, columns, top, left, k). ``shared`` holds what all slabs have in
    common: name, dtype, codec, decoding, coordinate values or origin and step, and a horizontal difference."""
    table = spark.createDataFrame(pd.DataFrame(slabs), "path string, start long, size long, rows int, columns int, top int, left int, k long").repartition(max(1, min(len(slabs), 4096)))

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        axis = lambda kind, at: np.asarray(shared[kind], float)[at] if shared.get(kind) is not None else shared[f"{kind}0"] + shared[f"{kind}_step"] * at
        for part in parts:
            for s in part.itertuples():
                kind = np.dtype(shared["dtype"])
                raw = np.frombuffer(_unpacked(_bytes(s.path, s.start, s.size), shared.get("codec", "")), kind)
                bands = shared.get("bands", 1)
                grid = raw[: raw.size // (s.columns * bands) * s.columns * bands].reshape(-1, s.columns, bands)[: s.rows]
                if shared.get("difference"):
                    grid = np.cumsum(grid, axis=1, dtype=kind)
                keep = min(s.columns, shared.get("width", s.columns + s.left) - s.left), min(len(grid), shared.get("height", len(grid) + s.top) - s.top)
                iy, ix = np.divmod(np.arange(keep[0] * keep[1]), keep[0]) if keep[0] > 0 and keep[1] > 0 else (np.zeros(0, int), np.zeros(0, int))
                for b in range(bands):
                    value = decoded(grid[: keep[1], : keep[0], b].ravel(), shared["how"])
                    name = shared["name"] if bands == 1 else f"{shared['name']}{b + 1}"
                    yield pd.DataFrame({"var": name, "k": s.k, "iy": (iy + s.top).astype(np.int32), "ix": (ix + s.left).astype(np.int32), "y": axis("y", iy + s.top), "x": axis("x", ix + s.left), "value": value})

    found = table.mapInPandas(run, CELLS)
    return found.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def _slabs(path: Path, v: Variable) -> list[dict]:
    """Bands of rows of each two-dimensional field of a variable."""
    ny, nx = v.shape[-2:]
    size = np.dtype(v.dtype).itemsize
    step = max(1, SLAB_CELLS // nx)
    outer = v.shape[:-2]
    per_record = math.prod(outer[1:]) if v.records and outer else math.prod(outer)
    out = []
    for k in range(math.prod(outer)):
        base = v.begin + (k // per_record * v.stride + k % per_record * ny * nx * size if v.records and outer else k * ny * nx * size)
        for top in range(0, ny, step):
            rows = min(step, ny - top)
            out.append({"path": str(path), "start": base + top * nx * size, "size": rows * nx * size, "rows": rows, "columns": nx, "top": top, "left": 0, "k": k})
    return out


# --- classic NetCDF ---

_NC_TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}


def netcdf_header(raw: bytes) -> tuple[dict[str, Variable], dict]:
    """Variables and global attributes of a classic, 64-bit offset or 64-bit data file."""
    if raw[:3] != b"CDF" or raw[3] not in (1, 2, 5):
        raise NotThisFormat("not a classic NetCDF file")
    wide = raw[3] == 5
    at = 4

    def number(big: bool = False) -> int:
        nonlocal at
        size = 8 if big else 4
        at += size
        return int.from_bytes(raw[at - size : at], "big")

    def text() -> str:
        nonlocal at
        n = number(wide)
        at += -(-n // 4) * 4
        start = at - -(-n // 4) * 4
        return raw[start : start + n].decode("utf-8")

    def attributes() -> dict:
        nonlocal at
        _, n = number(), number(wide)
        out = {}
        for _ in range(n):
            name, kind, m = text(), number(), number(wide)
            dtype = np.dtype(_NC_TYPES[kind])
            size = dtype.itemsize * m
            value = raw[at : at + size]
            at += -(-size // 4) * 4
            out[name] = value.decode("utf-8", "replace").rstrip("\0") if kind == 2 else [x.item() for x in np.frombuffer(value, dtype)]
        return out

    many = number(wide)
    _, n = number(), number(wide)
    dims = [(text(), number(wide)) for _ in range(n)]
    globals_ = attributes()
    _, n = number(), number(wide)
    found = {}
    for _ in range(n):
        name = text()
        ids = [number(wide) for _ in range(number(wide))]
        attrs, kind, size, begin = attributes(), number(), number(wide), number(raw[3] != 1)
        records = bool(ids) and dims[ids[0]][1] == 0
        found[name] = Variable(name, tuple(dims[i][0] for i in ids), tuple(dims[i][1] or many for i in ids), _NC_TYPES[kind], begin, size, records, attrs)
    recorded = [v for v in found.values() if v.records]
    for v in recorded:
        # One record of the file holds a record of each variable; a single one is not padded.
        v_bytes = math.prod(v.shape[1:]) * np.dtype(v.dtype).itemsize
        v.stride = v_bytes if len(recorded) == 1 else sum(-(-math.prod(r.shape[1:]) * np.dtype(r.dtype).itemsize // 4) * 4 for r in recorded)
    return found, globals_


def values_of(path: Path, v: Variable) -> np.ndarray:
    """All values of a small variable."""
    kind = np.dtype(v.dtype)
    if not v.records:
        return np.frombuffer(_bytes(str(path), v.begin, math.prod(v.shape) * kind.itemsize), kind).reshape(v.shape)
    one = math.prod(v.shape[1:]) * kind.itemsize
    return np.concatenate([np.frombuffer(_bytes(str(path), v.begin + r * v.stride, one), kind) for r in range(v.shape[0])]).reshape(v.shape) if v.shape[0] else np.zeros(v.shape, kind)


def times_of(values: np.ndarray, units: str) -> list[pd.Timestamp] | None:
    """Times from numbers and units such as ``days since 2001-01-01``; None if the units don't say."""
    m = re.match(r"\s*(\w+?)s?\s+since\s+(.+)$", units or "")
    if not m or m[1].lower() not in UNITS_OF_TIME:
        return None
    start = pd.Timestamp(m[2].replace(" UTC", "").strip())
    start = start.tz_convert(None) if start.tzinfo else start
    return [start + pd.Timedelta(seconds=float(v) * UNITS_OF_TIME[m[1].lower()]) for v in values]


def fields_of(spark: SparkSession, path: Path, variables: dict[str, Variable], options: Options, slabs, codec: str = "", read=values_of) -> Dataset:
    """The main variable of a file with named dimensions as cells, with its coordinates in ``meta``."""
    v = main_variable(variables, options.var)
    lat, lon = coordinate(variables, LATITUDE), coordinate(variables, LONGITUDE)
    axis = lambda name, dim, n: read(path, variables[name]).astype(float).tolist() if name and variables[name].dims[0] == dim else list(map(float, range(n)))
    shared = {"name": v.name, "dtype": v.dtype, "codec": codec, "how": decoding(v.attrs), "height": v.shape[-2], "width": v.shape[-1], "y": axis(lat, v.dims[-2], v.shape[-2]), "x": axis(lon, v.dims[-1], v.shape[-1])}
    meta = {"variable": v.name, "dims": dict(zip(v.dims, v.shape)), "variables": {w.name: list(w.shape) for w in variables.values()}, "units": v.attrs.get("units"), "attributes": {k: a for k, a in v.attrs.items() if isinstance(a, str)}}
    df = cells(spark, slabs(v), shared)
    time = next((w for w in variables.values() if len(w.shape) == 1 and (w.name.lower() in TIME_NAMES or " since " in str(w.attrs.get("units", "")))), None)
    if time is not None and len(v.shape) == 3 and v.dims[0] == time.dims[0]:
        stamps = times_of(read(path, time), str(time.attrs.get("units", "")))
        if stamps:
            df = df.join(F.broadcast(spark.createDataFrame(pd.DataFrame({"k": range(len(stamps)), "t": stamps}), "k long, t timestamp_ntz")), "k")
    return Dataset("field", df, meta)


@reader("netcdf-classic", "Raster", extensions=(".nc", ".cdf", ".nc3"), magic=(b"CDF\x01", b"CDF\x02", b"CDF\x05"), priority=5)
def read_netcdf(spark: SparkSession, path: Path, options: Options) -> Dataset:
    """Header from the file's first megabytes; more is read if it goes on."""
    size = 1 << 22
    while True:
        try:
            variables, _ = netcdf_header(_bytes(str(path), 0, size))
            break
        except (IndexError, KeyError, UnicodeDecodeError):
            if size >= path.stat().st_size:
                raise
            size *= 8
    return fields_of(spark, path, variables, options, lambda v: _slabs(path, v))


# --- chunk stores, version 2 ---


@reader("chunk-store", "Raster", extensions=(".zarr",), priority=5)
def read_store(spark: SparkSession, path: Path, options: Options) -> Dataset:
    """Arrays of a folder store with whole chunks in the last two dimensions; absent chunks are masked."""
    variables, codecs = {}, {}
    for at in sorted(path.glob("*/.zarray")):
        d = json.loads(at.read_text())
        extra = json.loads((at.parent / ".zattrs").read_text()) if (at.parent / ".zattrs").exists() else {}
        if d.get("order", "C") != "C" or d.get("filters") or (d.get("compressor") or {}).get("id", "zlib") not in ("zlib", "gzip", "zstd"):
            raise NotThisFormat(f"{at.parent.name}: only plain chunks in row order, or zlib, gzip or zstd, are read")
        fill = {"_FillValue": [d["fill_value"]]} if isinstance(d.get("fill_value"), (int, float)) else {}
        variables[at.parent.name] = Variable(at.parent.name, tuple(extra.get("_ARRAY_DIMENSIONS", [f"d{i}" for i in range(len(d["shape"]))])), tuple(d["shape"]), d["dtype"], attrs={**fill, **extra})
        codecs[at.parent.name] = ((d.get("compressor") or {}).get("id", ""), d["chunks"], d.get("dimension_separator", "."))
    if not variables:
        raise NotThisFormat("no arrays inside")

    def slabs(v: Variable) -> list[dict]:
        _, chunks, sep = codecs[v.name]
        if any(c != 1 for c in chunks[:-2]):
            raise NotThisFormat("chunks span several fields")
        out = []
        for at in np.ndindex(*(-(-n // c) for n, c in zip(v.shape, chunks))):
            file = path / v.name / sep.join(map(str, at))
            if file.exists():
                out.append({"path": str(file), "start": 0, "size": file.stat().st_size, "rows": chunks[-2], "columns": chunks[-1], "top": at[-2] * chunks[-2], "left": at[-1] * chunks[-1], "k": int(np.ravel_multi_index(at[:-2], v.shape[:-2])) if v.shape[:-2] else 0})
        return out

    def read(_, v: Variable) -> np.ndarray:
        codec, chunks, _ = codecs[v.name]
        parts = [np.frombuffer(_unpacked((path / v.name / str(i)).read_bytes(), codec), v.dtype) for i in range(-(-v.shape[0] // chunks[0]))]
        return np.concatenate(parts)[: v.shape[0]]

    return fields_of(spark, path, variables, options, slabs, codecs[main_variable(variables, options.var).name][0], read)


# --- GeoTIFF ---

_TIFF_TYPES = {1: "u1", 2: "S1", 3: "u2", 4: "u4", 5: "u4", 6: "i1", 8: "i2", 9: "i4", 11: "f4", 12: "f8", 16: "u8"}


def tiff_tags(raw: bytes) -> tuple[dict[int, list], str]:
    """Tags of the first directory of a baseline TIFF, and its byte order."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if not order or struct.unpack(order + "H", raw[2:4])[0] != 42:
        raise NotThisFormat("not a baseline TIFF")
    (at,) = struct.unpack(order + "I", raw[4:8])
    (n,) = struct.unpack(order + "H", raw[at : at + 2])
    out = {}
    for i in range(n):
        entry = raw[at + 2 + 12 * i : at + 14 + 12 * i]
        tag, kind, count = struct.unpack(order + "HHI", entry[:8])
        if kind not in _TIFF_TYPES:
            continue
        dtype = np.dtype(_TIFF_TYPES[kind]).newbyteorder(order)
        size = dtype.itemsize * count * (2 if kind == 5 else 1)
        start = struct.unpack(order + "I", entry[8:])[0] if size > 4 else None
        data = entry[8 : 8 + size] if start is None else raw[start : start + size]
        out[tag] = [data.decode("latin-1").rstrip("\0")] if kind == 2 else np.frombuffer(data, dtype).tolist()
    return out, order


@reader("geotiff", "Raster", extensions=(".tif", ".tiff"), magic=(b"II*\x00", b"MM\x00*"), priority=5)
def read_geotiff(spark: SparkSession, path: Path, options: Options) -> Dataset:
    """Strips or tiles, plain or deflated, of a TIFF with a place on the ground; pixel centres are coordinates."""
    with open(path, "rb") as f:
        # Directories may stand at either end of the file.
        raw = f.read() if path.stat().st_size < 64 << 20 else f.read(64 << 20)
    tags, order = tiff_tags(raw)
    if 33550 not in tags or 33922 not in tags:
        raise NotThisFormat("no place on the ground")
    width, height, samples = tags[256][0], tags[257][0], tags.get(277, [1])[0]
    codec = {1: "", 8: "zlib", 32946: "zlib"}.get(tags.get(259, [1])[0])
    if codec is None or tags.get(317, [1])[0] not in (1, 2) or tags.get(284, [1])[0] != 1 and samples > 1:
        raise NotThisFormat("only plain or deflated pixels, band by pixel, are read")
    kind = np.dtype(f"{order}{'uif'[tags.get(339, [1])[0] - 1]}{tags.get(258, [1])[0] // 8}")
    starts, sizes = (tags[324], tags[325]) if 324 in tags else (tags[273], tags[279])
    tall, wide = (tags[323][0], tags[322][0]) if 324 in tags else (min(height, tags.get(278, [height])[0]), width)
    across = -(-width // wide)
    slabs = [{"path": str(path), "start": a, "size": n, "rows": tall, "columns": wide, "top": i // across * tall, "left": i % across * wide, "k": 0} for i, (a, n) in enumerate(zip(starts, sizes))]
    (dx, dy, *_), tie = tags[33550], tags[33922]
    nodata = [float(x) for x in tags.get(42113, [""])[0].split()[:1] if re.fullmatch(r"[-+\d.eE]+", x)]
    how = {"fills": nodata, "low": None, "high": None, "factor": 1.0, "shift": 0.0}
    shared = {"name": "band", "dtype": kind.str, "codec": codec, "how": how, "bands": samples, "difference": tags.get(317, [1])[0] == 2, "width": width, "height": height, "x0": tie[3] + (0.5 - tie[0]) * dx, "x_step": dx, "y0": tie[4] - (0.5 - tie[1]) * dy, "y_step": -dy}
    crs = " ".join(str(x) for t in (34737, 34736) for x in tags.get(t, []))
    keys = tags.get(34735, [])
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4)}
    return Dataset("field", cells(spark, slabs, shared), {"variable": "band", "dims": {"y": height, "x": width}, "bands": samples, "crs": crs, "epsg": codes.get(3072) or codes.get(2048), "geographic": codes.get(1024) == 2})


# --- FITS ---


def fits_headers(path: Path) -> list[tuple[dict, int, int]]:
    """(cards, first byte, bytes) of the data of every unit."""
    out, at, end = [], 0, path.stat().st_size
    while at < end:
        cards: dict = {}
        while True:
            block = _bytes(str(path), at, 2880).decode("ascii", "replace")
            at += 2880
            lines = [block[i : i + 80] for i in range(0, len(block), 80)]
            for line in lines:
                if line[8:10] == "= ":
                    value = line[10:].strip()
                    text = re.match(r"'((?:[^']|'')*)'", value)
                    value = value.split("/")[0].strip()
                    cards[line[:8].strip()] = text[1].rstrip() if text else {"T": True, "F": False}[value] if value in ("T", "F") else float(value.replace("D", "E")) if re.fullmatch(r"[-+\d.EDed]+", value) else value
            if any(line.startswith("END") and not line[3:].strip() for line in lines) or at >= end:
                break
        shape = [int(cards.get(f"NAXIS{i + 1}", 0)) for i in range(int(cards.get("NAXIS", 0)))]
        size = int(abs(cards.get("BITPIX", 8))) // 8 * (math.prod(shape) if shape else 0) + int(cards.get("PCOUNT", 0) if "XTENSION" in cards else 0)
        out.append((cards, at, size))
        at += -(-size // 2880) * 2880
    return out


_FITS_COLUMNS = {"L": "S1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8"}


@reader("fits", "Raster", extensions=(".fits", ".fit", ".fts"), magic=(b"SIMPLE  =",), priority=5)
def read_fits(spark: SparkSession, path: Path, options: Options) -> Dataset:
    """Images as fields, names that repeat numbered; without an image the largest table."""
    units = fits_headers(path)
    images = [(c, a) for c, a, _ in units if int(c.get("NAXIS", 0)) >= 2 and c.get("XTENSION", "IMAGE").strip() == "IMAGE"]
    tables = [(c, a) for c, a, _ in units if c.get("XTENSION", "").strip() == "BINTABLE"]
    if images:
        seen: dict[str, int] = {}
        df, meta = None, {"variables": {}}
        for c, a in images:
            name = c.get("EXTNAME", "image")
            seen[name] = seen.get(name, 0) + 1
            name = name if seen[name] == 1 else f"{name}_{seen[name]}"
            shape = tuple(int(c[f"NAXIS{i}"]) for i in range(int(c["NAXIS"]), 0, -1))
            kind = {8: "u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}[int(c["BITPIX"])]
            how = {"fills": [c["BLANK"]] if "BLANK" in c else [], "low": None, "high": None, "factor": c.get("BSCALE", 1.0), "shift": c.get("BZERO", 0.0)}
            axis = lambda i: {"0": c.get(f"CRVAL{i}", 0.0) + (1 - c.get(f"CRPIX{i}", 1.0)) * c.get(f"CDELT{i}", c.get(f"CD{i}_{i}", 1.0)), "_step": c.get(f"CDELT{i}", c.get(f"CD{i}_{i}", 1.0))}  # noqa: B023, E731
            shared = {"name": name, "dtype": kind, "how": how, **{f"x{k}": v for k, v in axis(1).items()}, **{f"y{k}": v for k, v in axis(2).items()}}
            part = cells(spark, _slabs(path, Variable(name, (), shape, kind, a)), shared)
            df = part if df is None else df.unionByName(part)
            meta["variables"][name] = list(shape)
        meta["variable"] = options.var or next(iter(meta["variables"]))
        if meta["variable"] not in meta["variables"]:
            raise KeyError(f"{options.var} is not among {', '.join(meta['variables'])}")
        return Dataset("field", df.filter(F.col("var") == meta["variable"]), meta)
    if not tables:
        raise NotThisFormat("neither image nor table")
    c, a = max(tables, key=lambda t: t[0]["NAXIS2"])
    names, formats = [], []
    for i in range(1, int(c["TFIELDS"]) + 1):
        count, letter = re.match(r"(\d*)([A-Z])", c[f"TFORM{i}"]).groups()
        if letter not in (*_FITS_COLUMNS, "A"):
            raise NotThisFormat(f"columns of format {letter} are not read")
        names.append(c.get(f"TTYPE{i}", f"c{i}"))
        formats.append(f"S{count or 1}" if letter == "A" else (_FITS_COLUMNS[letter], (int(count or 1),)) if int(count or 1) > 1 else _FITS_COLUMNS[letter])
    kind = np.dtype({"names": [f"f{i}" for i in range(len(names))], "formats": formats})
    rows, width, step = int(c["NAXIS2"]), int(c["NAXIS1"]), max(1, (8 << 20) // max(1, int(c["NAXIS1"])))
    simple = [i for i, f in enumerate(formats) if isinstance(f, str)]
    ddl = ", ".join(f"`{names[i]}` {'string' if formats[i].startswith('S') else 'double' if formats[i][1:2] == 'f' else 'long'}" for i in simple)

    def run(parts):
        for part in parts:
            for first in part["id"]:
                n = min(step, rows - first)
                t = np.frombuffer(_bytes(str(path), a + first * width, n * width), kind)
                yield pd.DataFrame({names[i]: [x.decode("latin-1").strip() for x in t[f"f{i}"]] if formats[i].startswith("S") else t[f"f{i}"].astype(float if formats[i][1:2] == "f" else np.int64) for i in simple})

    return Dataset("table", spark.range(0, rows, step).mapInPandas(run, ddl), {"rows": rows, "columns": len(names)})


def described(variables: dict[str, Variable]) -> list[dict]:
    """A row per variable, for reports."""
    return [{k: v for k, v in asdict(v).items() if k in ("name", "dims", "shape", "dtype")} for v in variables.values()]
