"""Folders, archives, report cache and sinks."""

from __future__ import annotations

import bz2
import contextlib
import gzip
import html
import json
import lzma
import math
import os
import shutil
import tarfile
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

# Names that aren't data of their own.
IGNORED = frozenset((".DS_Store", "Thumbs.db", "desktop.ini"))
SHAPE_PARTS = frozenset((".shx", ".dbf", ".prj", ".cpg", ".sbn", ".sbx", ".qix"))
SIDECARS = (".aux.xml", ".ovr", ".idx", ".ncx", ".ncx4")
MOST_MEMBERS, MOST_BYTES, MOST_DEPTH = 500, 8 << 30, 3
STORE_MARKS = (".zgroup", ".zarray", "zarr.json")


def listing(folder: Path, out: Path | None = None) -> list[tuple[Path, str, bool]]:
    """(folder, name, is a chunk store) of all that lies below; stores are not entered, ``out`` and hidden folders neither."""
    rows = []
    for at, folders, names in os.walk(folder):
        here = Path(at)
        stores = [d for d in folders if d.lower().endswith(".zarr") or any((here / d / m).exists() for m in STORE_MARKS)]
        rows += [(here, d, True) for d in stores if not d.startswith(".")]
        rows += [(here, n, False) for n in names]
        folders[:] = [d for d in folders if d not in stores and not d.startswith(".") and not (out and (here / d).resolve() == out.resolve())]
    return rows


def inputs(folder: Path, out: Path | None = None) -> list[Path]:
    """Data files below a folder in order: its listing less the companions that name another row as their owner."""
    rows = listing(folder, out)
    known = {(at, name.lower()) for at, name, _ in rows}

    def owners(name: str) -> set[str]:
        """Names of files that this one would accompany."""
        base, _, end = name.lower().rpartition(".")
        shapes = {f"{base}.shp"} if f".{end}" in SHAPE_PARTS else set()
        return shapes | {name.lower()[: -len(s)] for s in SIDECARS if name.lower().endswith(s)}

    kept = [(at, name) for at, name, store in rows if store or (name not in IGNORED and not name.startswith(".") and not any((at, o) in known for o in owners(name)))]
    return sorted(at / name for at, name in kept)


def unpack(path: Path, to: Path, most_bytes: int = MOST_BYTES, most_members: int = MOST_MEMBERS) -> list[Path]:
    """Members of an archive as files below ``to``. Unsafe paths and too much data raise, and nothing is left."""
    to.mkdir(parents=True, exist_ok=True)
    total = 0

    def place(name: str) -> Path:
        p = (to / name).resolve()
        if not p.is_relative_to(to.resolve()):
            raise ValueError(f"unsafe path in archive: {name}")
        p.parent.mkdir(parents=True, exist_ok=True)
        return p

    def copy(src, dst: Path):
        nonlocal total
        with open(dst, "wb") as f:
            while piece := src.read(1 << 20):
                total += len(piece)
                if total > most_bytes:
                    raise ValueError("archive unpacks to more than the limit")
                f.write(piece)
        return dst

    try:
        low = path.name.lower()
        if zipfile.is_zipfile(path):
            with zipfile.ZipFile(path) as z:
                members = [m for m in z.infolist() if not m.is_dir()]
                if len(members) > most_members:
                    raise ValueError("archive has more members than the limit")
                return [copy(z.open(m), place(m.filename)) for m in members]
        if tarfile.is_tarfile(path):
            with tarfile.open(path) as t:
                members = [m for m in t.getmembers() if m.isfile()]
                if len(members) > most_members:
                    raise ValueError("archive has more members than the limit")
                return [copy(t.extractfile(m), place(m.name)) for m in members]
        for end, module in ((".gz", gzip), (".bz2", bz2), (".xz", lzma)):
            if low.endswith(end):
                with module.open(path, "rb") as f:
                    return [copy(f, place(path.name[: -len(end)]))]
    except Exception:
        shutil.rmtree(to, ignore_errors=True)
        raise
    raise ValueError("not an archive")


@contextlib.contextmanager
def work_folder(spark) -> Iterator[Path]:
    """A folder that driver and executors see, gone at the end: below ``spark.checkpoint.dir`` where that is a
    mounted path, else a temporary one if all runs on this machine."""
    base = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://")
    master = spark.sparkContext.master
    if base and not base.startswith("/"):
        raise ValueError("archives are unpacked below spark.checkpoint.dir, which must be a mounted folder here")
    if not base and master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if base:
        Path(base).mkdir(parents=True, exist_ok=True)
    with tempfile.TemporaryDirectory(dir=base or None) as made:
        yield Path(made)


def is_archive(path: Path) -> bool:
    return path.suffix.lower() in (".zip", ".tar", ".gz", ".tgz", ".bz2", ".xz") and path.is_file()


def strict(x):
    """Values that strict JSON can hold: NaN and infinities become null."""
    if isinstance(x, dict):
        return {str(k): strict(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [strict(v) for v in x]
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    if isinstance(x, (str, int, bool)) or x is None:
        return x
    if hasattr(x, "item"):
        return strict(x.item())
    if hasattr(x, "asDict"):
        return strict(x.asDict(True))
    return str(x)


def fresh(source: Path, *results: Path) -> bool:
    """Whether all results exist and aren't older than their source."""
    return all(r.exists() for r in results) and min(r.stat().st_mtime for r in results) >= source.stat().st_mtime


def _section(title: str, x) -> str:
    e = html.escape
    if isinstance(x, list) and x and all(isinstance(r, dict) for r in x):
        names = list(dict.fromkeys(k for r in x for k in r))
        rows = "".join("<tr>" + "".join(f"<td>{e(str(r.get(n, '')))}</td>" for n in names) + "</tr>" for r in x)
        body = f"<table><tr>{''.join(f'<th>{e(n)}</th>' for n in names)}</tr>{rows}</table>"
    elif isinstance(x, dict):
        body = "<dl>" + "".join(f"<dt>{e(str(k))}</dt><dd>{e(str(v))}</dd>" for k, v in x.items()) + "</dl>"
    else:
        body = f"<p>{e(str(x))}</p>"
    return f"<section><h2>{e(title)}</h2>{body}</section>"


def write_report(out: Path, name: str, result: dict) -> tuple[Path, Path]:
    """JSON and HTML of one result."""
    out.mkdir(parents=True, exist_ok=True)
    clean = strict(result)
    j, h = out / f"{name}.json", out / f"{name}.html"
    j.write_text(json.dumps(clean, ensure_ascii=False, allow_nan=False, indent=1), encoding="utf-8")
    body = "".join(_section(k, v) for k, v in clean.items() if v not in (None, [], {}))
    h.write_text(f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(name)}</title></head><body><h1>{html.escape(name)}</h1>{body}</body></html>", encoding="utf-8")
    return j, h


def write_index(out: Path) -> Path:
    """One page that lists every report in the folder."""
    items = []
    for j in sorted(out.glob("*.json")):
        try:
            r = json.loads(j.read_text(encoding="utf-8"))
        except ValueError:
            continue
        if isinstance(r, dict) and "kind" in r:
            items.append(f"<li><a href='{html.escape(j.stem)}.html'>{html.escape(j.stem)}</a> {html.escape(str(r['kind']))}</li>")
    page = out / "index.html"
    page.write_text(f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Reports</title></head><body><ul>{''.join(items)}</ul></body></html>", encoding="utf-8")
    return page


def point_series_url(base: str, latitude: float, longitude: float, start: str, end: str, parameters: tuple[str, ...]) -> str:
    """URL of a daily point series at a web service: checked latitude, wrapped longitude, compact dates."""
    if not (-90 <= latitude <= 90 and -180 <= longitude <= 360):
        raise ValueError(f"latitude {latitude} or longitude {longitude} is out of range")
    lon = round((float(longitude) + 180) % 360 - 180, 4)
    return f"{base}?parameters={','.join(parameters)}&longitude={lon}&latitude={round(float(latitude), 4)}&start={start.replace('-', '')}&end={end.replace('-', '')}&format=CSV"
