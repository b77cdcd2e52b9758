"""Tables and layers in container files, read with the standard library: workbooks, shapefiles and geopackages.

Their formats can't be split; the driver opens them, and files of this kind hold what one program can edit.
"""

from __future__ import annotations

import re
import sqlite3
import struct
import xml.etree.ElementTree as E
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from plumbline.sources.registry import Dataset, NotThisFormat, Options, reader
from plumbline.sources.tabular import tidy

MOST_LAYERS = 50
# Geometry codes.
SHAPES = {1: "Point", 3: "LineString", 5: "Polygon", 8: "MultiPoint", 11: "Point", 13: "LineString", 15: "Polygon", 21: "Point", 23: "LineString", 25: "Polygon"}
WKB = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}


def frame(spark: SparkSession, names: list[str], rows: list[tuple]) -> tuple[DataFrame, dict]:
    """Rows of text as a tidy table; a first row of units is found by its place."""
    ddl = ", ".join(["_at long", *(f"`{n}` string" for n in names)])
    df, meta = tidy(spark.createDataFrame([(i, *(None if v is None else str(v) for v in r)) for i, r in enumerate(rows)], ddl), "_at")
    return df.drop("_at"), meta


def _local(e: E.Element) -> str:
    return e.tag.rpartition("}")[2]


def sheets(path: Path) -> dict[str, list[list[str | None]]]:
    """Cells of every sheet of a workbook, by name, in rows."""
    out = {}
    with zipfile.ZipFile(path) as z:
        names = set(z.namelist())
        if "xl/workbook.xml" not in names:
            raise NotThisFormat("no workbook inside")
        shared = ["".join(t.text or "" for t in s.iter() if _local(t) == "t") for s in E.fromstring(z.read("xl/sharedStrings.xml")) if _local(s) == "si"] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in E.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for s in (e for e in E.fromstring(z.read("xl/workbook.xml")).iter() if _local(e) == "sheet"):
            link = next(v for k, v in s.attrib.items() if k.endswith("}id"))
            rows: list[list[str | None]] = []
            for row in (e for e in E.fromstring(z.read("xl/" + targets[link].removeprefix("/xl/"))).iter() if _local(e) == "row"):
                cells: list[str | None] = []
                for c in row:
                    letters = re.match(r"[A-Z]+", c.get("r", ""))
                    at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters[0]))) - 1 if letters else len(cells)
                    value = next((e.text for e in c.iter() if _local(e) in ("v", "t")), None)
                    cells += [None] * (at + 1 - len(cells))
                    cells[at] = shared[int(value)] if c.get("t") == "s" and value is not None else value
                rows.append(cells)
            out[s.get("name")] = rows
    return out


@reader("excel", "Tabular", extensions=(".xlsx", ".xlsm"), priority=5)
def read_workbook(spark: SparkSession, path: Path, options: Options) -> Dataset:
    """The sheet with the most cells; the others are listed."""
    every = sheets(path)
    name = max(every, key=lambda n: sum(c is not None for r in every[n] for c in r), default=None)
    rows = [r for r in every.get(name, []) if any(c is not None for c in r)]
    if len(rows) < 2:
        raise NotThisFormat("no sheet with rows")
    width = max(map(len, rows))
    head = [h or f"Unnamed: {i}" for i, h in enumerate([*rows[0], *[None] * width][:width])]
    head = [h if head.index(h) == i else f"{h}.{i}" for i, h in enumerate(head)]
    df, meta = frame(spark, head, [(*r, *[None] * (width - len(r))) for r in rows[1:]])
    return Dataset("table", df, meta | {"sheet": name, "other_sheets": [n for n in every if n != name]})


def dbf_rows(raw: bytes) -> tuple[list[str], list[list[str]]]:
    """Field names and rows of a dBASE table."""
    count, head, size = struct.unpack("<IHH", raw[4:12])
    fields = []
    at = 32
    while at < head - 1 and raw[at] != 0x0D:
        fields.append((raw[at : at + 11].split(b"\0")[0].decode("latin-1"), raw[at + 16]))
        at += 32
    rows = []
    for i in range(count):
        record, row, at = raw[head + i * size : head + (i + 1) * size], [], 1
        for _, n in fields:
            row.append(record[at : at + n].decode("utf-8", "replace").strip())
            at += n
        if record[:1] != b"*":
            rows.append(row)
    return [n for n, _ in fields], rows


@reader("shapefile", "Vector", extensions=(".shp",), magic=(b"\x00\x00\x27\x0a",), priority=5)
def read_shapefile(spark: SparkSession, path: Path, options: Options) -> Dataset:
    """Geometry type and a point of each shape (its own, or the middle of its box) beside its attributes."""
    raw, at, shapes = path.read_bytes(), 100, []
    if struct.unpack(">i", raw[:4])[0] != 9994:
        raise NotThisFormat("not a shapefile")
    while at + 12 <= len(raw):
        (size,) = struct.unpack(">i", raw[at + 4 : at + 8])
        (kind,) = struct.unpack("<i", raw[at + 8 : at + 12])
        name = SHAPES.get(kind)
        box = struct.unpack("<2d", raw[at + 12 : at + 28]) * 2 if name == "Point" else struct.unpack("<4d", raw[at + 12 : at + 44]) if name else None
        shapes.append((name, (box[0] + box[2]) / 2 if box else None, (box[1] + box[3]) / 2 if box else None))
        at += 8 + 2 * size
    beside = next((p for p in (path.with_suffix(".dbf"), path.with_suffix(".DBF")) if p.exists()), None)
    names, rows = dbf_rows(beside.read_bytes()) if beside else ([], [[] for _ in shapes])
    df, meta = frame(spark, [*names, "geometry_type", "longitude", "latitude"], [(*r, *s) for r, s in zip(rows, shapes)])
    return Dataset("table", df, meta | {"features": len(shapes)})


def wkb_point(blob: bytes | None) -> tuple[str | None, float | None, float | None]:
    """(geometry type, x, y of its first vertex) of a geopackage's geometry."""
    if not blob or blob[:2] != b"GP":
        return None, None, None
    body = blob[8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[blob[3] >> 1 & 7] :]
    order = "<" if body[0] else ">"
    (kind,) = struct.unpack(order + "I", body[1:5])
    kind %= 1000
    at = {1: 5, 2: 9, 3: 13, 4: 14, 5: 18, 6: 22}.get(kind)
    if at is None or len(body) < at + 16:
        return WKB.get(kind), None, None
    return WKB[kind], *struct.unpack(order + "2d", body[at : at + 16])


@reader("geopackage", "Vector", extensions=(".gpkg",), magic=(b"SQLite format 3\x00",), priority=5)
def read_geopackage(spark: SparkSession, path: Path, options: Options) -> Dataset:
    """The layer with the most features, of ``MOST_LAYERS`` at most; the sizes of all are listed."""
    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        quoted = lambda n: '"' + n.replace('"', '""') + '"'
        layers = db.execute("SELECT table_name, column_name FROM gpkg_geometry_columns ORDER BY table_name LIMIT ?", (MOST_LAYERS,)).fetchall()
        sizes = {n: db.execute(f"SELECT count(*) FROM {quoted(n)}").fetchone()[0] for n, _ in layers}
        if not sizes:
            raise NotThisFormat("no layers")
        name, geometry = max(layers, key=lambda x: sizes[x[0]])
        got = db.execute(f"SELECT * FROM {quoted(name)}")
        names = [d[0] for d in got.description]
        at = names.index(geometry)
        rows = [(*(v for i, v in enumerate(r) if i != at), *wkb_point(r[at])) for r in got]
    except sqlite3.DatabaseError as e:
        raise NotThisFormat(str(e)) from e
    finally:
        db.close()
    df, meta = frame(spark, [*(n for n in names if n != geometry), "geometry_type", "longitude", "latitude"], rows)
    return Dataset("table", df, meta | {"features": len(rows), "layer": name, "layers": sizes})
