"""Binary formats written here byte by byte, read back as cells and tables, whole and in slabs."""

import json
import math
import sqlite3
import struct
import zipfile
import zlib

import numpy as np
import pytest

from plumbline.plans.explore import explore
from plumbline.sources import arrays, images, registry, workbooks
from plumbline.sources.registry import NotThisFormat, Options

RNG = np.random.default_rng(5)


def padded(b, n=4):
    return b + b"\0" * (-len(b) % n)


def netcdf(path, fields, records=None, version=1):
    """fields: name -> (dims, array, attributes); ``records`` names the record dimension."""
    number = lambda n: struct.pack(">I", n)
    text = lambda s: number(len(s.encode())) + padded(s.encode())
    codes = {"i1": 1, "S1": 2, "i2": 3, "i4": 4, "f4": 5, "f8": 6}

    def attributes(a):
        out = b"\0" * 8 if not a else struct.pack(">II", 0x0C, len(a))
        for k, v in a.items():
            if isinstance(v, str):
                out += text(k) + number(2) + text(v)
            else:
                v = np.asarray(v)
                out += text(k) + number(codes[v.dtype.str[1:]]) + number(v.size) + padded(v.astype(v.dtype.newbyteorder(">")).tobytes())
        return out

    dims = {}
    for d, x, _ in fields.values():
        dims.update(zip(d, x.shape))
    names = list(dims)
    many = dims.get(records, 0)
    head = b"CDF" + bytes([version]) + number(many) + struct.pack(">II", 0x0A, len(dims)) + b"".join(text(d) + number(0 if d == records else n) for d, n in dims.items()) + attributes({"title": "made"})
    size = {k: len(padded(x[:1].tobytes() if records in d else x.tobytes())) for k, (d, x, _) in fields.items()}
    order = [k for k, (d, _, _) in fields.items() if records not in d] + [k for k, (d, _, _) in fields.items() if records in d]

    def table(begins):
        out = struct.pack(">II", 0x0B, len(fields))
        for k, (d, x, a) in fields.items():
            out += text(k) + number(len(d)) + b"".join(number(names.index(i)) for i in d) + attributes(a) + number(codes[x.dtype.str[1:]]) + number(size[k]) + struct.pack(">Q" if version == 2 else ">I", begins[k])
        return out

    at, begins = len(head) + len(table(dict.fromkeys(fields, 0))), {}
    for k in order:
        begins[k] = at
        at += size[k]
    big = {k: x.astype(x.dtype.newbyteorder(">")) for k, (_, x, _) in fields.items()}
    body = b"".join(padded(big[k].tobytes()) for k in order if records not in fields[k][0])
    some = [k for k in order if records in fields[k][0]]
    for r in range(many):
        body += b"".join(big[k][r : r + 1].tobytes() if len(some) == 1 else padded(big[k][r : r + 1].tobytes()) for k in some)
    path.write_bytes(head + table(begins) + body)


def field(n=48):
    t2m = 290 + 0.05 * np.arange(n)[:, None, None] + RNG.normal(0, 0.3, (n, 9, 11))
    return t2m


def values(found, ny, nx):
    out = np.full((max(r.k for r in found) + 1, ny, nx), np.nan)
    for r in found:
        out[r.k, r.iy, r.ix] = np.nan if r.value is None else r.value
    return out


@pytest.mark.parametrize("records,version", [("time", 1), (None, 2)])
def test_classic_netcdf(spark, tmp_path, monkeypatch, records, version):
    monkeypatch.setattr(arrays, "SLAB_CELLS", 33)
    raw = np.round((field() - 290) * 100).astype(np.int16)
    raw[3, 2, 1] = -32767
    coordinates = {"lat": (("lat",), np.linspace(20, 40, 9), {"units": "degrees_north"}), "lon": (("lon",), np.linspace(300, 350, 11).astype(np.float32), {}), "time": (("time",), np.arange(48, dtype=np.float64) * 31, {"units": "days since 2001-01-01"})}
    name = tmp_path / "packed.csv"
    netcdf(name, {**coordinates, "t2m": (("time", "lat", "lon"), raw, {"scale_factor": np.array([0.01]), "add_offset": np.array([290.0]), "_FillValue": np.array([-32767], np.int16), "units": "K"}), "z": (("lat", "lon"), np.zeros((9, 11), np.float32), {})}, records, version)
    found = registry.read(spark, name, Options())
    assert found.reader == "netcdf-classic" and found.meta["variable"] == "t2m" and found.meta["dims"] == {"time": 48, "lat": 9, "lon": 11}
    got = values(rows := found.df.collect(), 9, 11)
    want = np.where(raw == -32767, np.nan, raw * 0.01 + 290)
    assert np.allclose(got, want, equal_nan=True) and np.isnan(got).sum() == 1
    assert {(r.iy, r.y) for r in rows} == {(i, 20 + 2.5 * i) for i in range(9)} and str(min(r.t for r in rows)) == "2001-01-01 00:00:00"
    (r,) = explore(spark, name)
    assert r["coverage_place"] == {"west": -60.0, "south": 20.0, "east": -10.0, "north": 40.0} and r["trends"][0]["mk_trend"] == "increasing" and r["trend_map"]["n_pixels"] == 99
    assert "increase" in r["trend_text"][0] and r["statistics"][0]["count"] == 48 * 99 - 1
    assert registry.read(spark, name, Options(var="z")).df.count() == 99
    with pytest.raises(KeyError):
        arrays.read_netcdf(spark, name, Options(var="none"))


def test_chunk_store(spark, tmp_path):
    x = field(6)
    at = tmp_path / "s.zarr" / "t2m"
    at.mkdir(parents=True)
    (at.parent / ".zgroup").write_text('{"zarr_format": 2}')
    (at / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": [6, 9, 11], "chunks": [1, 5, 6], "dtype": "<f8", "order": "C", "compressor": {"id": "zlib"}, "fill_value": -1.0, "filters": None}))
    (at / ".zattrs").write_text(json.dumps({"_ARRAY_DIMENSIONS": ["time", "lat", "lon"]}))
    full = np.full((6, 10, 12), -1.0)
    full[:, :9, :11] = x
    for k in range(6):
        for i in range(2):
            for j in range(2):
                if (k, i, j) != (5, 1, 1):
                    (at / f"{k}.{i}.{j}").write_bytes(zlib.compress(full[k, 5 * i : 5 * i + 5, 6 * j : 6 * j + 6].tobytes()))
    found = registry.read(spark, tmp_path / "s.zarr", Options())
    got = values(found.df.collect(), 9, 11)
    x[5, 5:, 6:] = np.nan
    assert found.reader == "chunk-store" and np.allclose(got, x, equal_nan=True)


def tiff(path, x, tile=None, codec=1, predictor=1, nodata="-9999", place=True):
    blocks = []
    ny, nx = x.shape
    if tile:
        for i in range(0, ny, tile):
            for j in range(0, nx, tile):
                b = np.zeros((tile, tile), x.dtype)
                part = x[i : i + tile, j : j + tile]
                b[: part.shape[0], : part.shape[1]] = part
                blocks.append(b)
    else:
        blocks = [x[i : i + 16] for i in range(0, ny, 16)]
    if predictor == 2:
        blocks = [np.concatenate([b[:, :1], np.diff(b, axis=1)], 1).astype(b.dtype) for b in blocks]
    data = [zlib.compress(b.tobytes()) if codec == 8 else b.tobytes() for b in blocks]
    starts = np.cumsum([8, *map(len, data)])
    tags = {256: ("I", [nx]), 257: ("I", [ny]), 258: ("H", [x.dtype.itemsize * 8]), 259: ("H", [codec]), 277: ("H", [1]), 317: ("H", [predictor]), 339: ("H", [{"u": 1, "i": 2, "f": 3}[x.dtype.kind]]), 34735: ("H", [1, 1, 0, 2, 1024, 0, 1, 2, 2048, 0, 1, 4326]), 42113: ("s", nodata)}
    tags |= {322: ("I", [tile]), 323: ("I", [tile]), 324: ("I", starts[:-1]), 325: ("I", list(map(len, data)))} if tile else {273: ("I", starts[:-1]), 278: ("I", [16]), 279: ("I", list(map(len, data)))}
    if place:
        tags |= {33550: ("d", [0.05, 0.05, 0]), 33922: ("d", [0, 0, 0, 35.0, 34.0, 0])}
    end, entries, extra = int(starts[-1]) + int(starts[-1]) % 2, [], b""
    base = end + 2 + 12 * len(tags) + 4
    for t in sorted(tags):
        kind, v = tags[t]
        raw = v.encode() + b"\0" if kind == "s" else struct.pack(f"<{len(v)}{kind}", *v)
        n = len(raw) if kind == "s" else len(v)
        cell = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", base + len(extra))
        extra += padded(raw, 2) if len(raw) > 4 else b""
        entries.append(struct.pack("<HHI", t, {"H": 3, "I": 4, "d": 12, "s": 2}[kind], n) + cell)
    path.write_bytes((b"II*\0" + struct.pack("<I", end) + b"".join(data)).ljust(end, b"\0") + struct.pack("<H", len(tags)) + b"".join(entries) + b"\0" * 4 + extra)


@pytest.mark.parametrize("tile,codec,predictor,kind", [(None, 1, 1, "f4"), (None, 8, 1, "f4"), (32, 8, 2, "i2"), (32, 1, 1, "u1")])
def test_geotiff(spark, tmp_path, tile, codec, predictor, kind):
    x = (RNG.normal(100, 30, (50, 60)) // 1).clip(1, 250).astype(kind)
    x[4, 5] = 251
    tiff(tmp_path / "dem.tif", x, tile, codec, predictor, "251")
    found = registry.read(spark, tmp_path / "dem.tif", Options())
    got = values(rows := found.df.collect(), 50, 60)
    assert len(rows) == 3000 and np.allclose(got[0], np.where(x == 251, np.nan, x.astype(float)), equal_nan=True) and found.meta["epsg"] == 4326
    assert {(r.ix, round(r.x, 6)) for r in rows} == {(i, round(35.025 + 0.05 * i, 6)) for i in range(60)} and max(r.y for r in rows) == pytest.approx(33.975)
    tiff(tmp_path / "plain.tif", x, place=False)
    assert "no place" in " ".join(registry.read(spark, tmp_path / "plain.tif", Options()).problems)


def fits(path, units):
    raw = b""
    for cards, data in units:
        lines = [f"{k:<8}= {('T' if v else 'F') if isinstance(v, bool) else repr(v) if isinstance(v, str) else v!s:>20}" for k, v in cards]
        raw += padded(b"".join(x.ljust(80).encode() for x in [*lines, "END"]), 1)
        raw += b" " * (-len(raw) % 2880) + padded(data, 2880)
    path.write_bytes(raw)


def test_fits(spark, tmp_path):
    x = RNG.normal(size=(40, 50)).astype(">f4")
    y = RNG.integers(0, 99, (4, 6)).astype(">i2")
    wcs = [("CRVAL1", 10.0), ("CRPIX1", 1.0), ("CDELT1", -0.5), ("CRVAL2", 5.0), ("CRPIX2", 1.0), ("CDELT2", 0.5)]
    image = lambda a, bits: [("BITPIX", bits), ("NAXIS", 2), ("NAXIS1", a.shape[1]), ("NAXIS2", a.shape[0])]
    fits(tmp_path / "multi.fits", [([("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0)], b""), ([("XTENSION", "IMAGE"), *image(x, -32), ("EXTNAME", "sci"), *wcs], x.tobytes()), ([("XTENSION", "IMAGE"), *image(y, 16), ("EXTNAME", "sci"), ("BZERO", 100), ("BSCALE", 2)], y.tobytes())])
    found = registry.read(spark, tmp_path / "multi.fits", Options())
    assert found.reader == "fits" and found.meta["variables"] == {"sci": [40, 50], "sci_2": [4, 6]}
    rows = found.df.collect()
    assert np.allclose(values(rows, 40, 50)[0], x) and {(r.ix, r.x) for r in rows} == {(i, 10 - 0.5 * i) for i in range(50)}
    assert np.allclose(values(registry.read(spark, tmp_path / "multi.fits", Options(var="sci_2")).df.collect(), 4, 6)[0], y * 2.0 + 100)
    t = np.zeros(30, np.dtype([("ra", ">f8"), ("n", ">i4"), ("name", "S5")]))
    t["ra"], t["n"], t["name"] = RNG.normal(size=30), np.arange(30), [f"s{i}".encode() for i in range(30)]
    columns = [("TFIELDS", 3), ("TTYPE1", "ra"), ("TFORM1", "D"), ("TTYPE2", "n"), ("TFORM2", "J"), ("TTYPE3", "name"), ("TFORM3", "5A")]
    fits(tmp_path / "catalog.fits", [([("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0)], b""), ([("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", t.itemsize), ("NAXIS2", 30), ("PCOUNT", 0), ("GCOUNT", 1), *columns], t.tobytes())])
    got = registry.read(spark, tmp_path / "catalog.fits", Options()).df.orderBy("n").collect()
    assert [r.name for r in got] == [f"s{i}" for i in range(30)] and np.allclose([r.ra for r in got], t["ra"])


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda ref, v: f'<c r="{ref}" t="s"><v>{v}</v></c>' if isinstance(v, int) else f'<c r="{ref}"><v>{v}</v></c>'
    rows = [[0, 1, 2]] + [[3, f"{i}.5", f"{1000 + i}"] for i in range(20)]
    sheet = lambda rs: f"<worksheet {ns}><sheetData>" + "".join(f'<row r="{i + 1}">' + "".join(cell("ABC"[j] + str(i + 1), v) for j, v in enumerate(r) if v is not None) + "</row>" for i, r in enumerate(rs)) + "</sheetData></worksheet>"
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://x"><sheets><sheet name="small" sheetId="1" r:id="r1"/><sheet name="data" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{s}</t></si>" for s in ("station", "t", "n", "Amman")) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", sheet([[0]]))
        z.writestr("xl/worksheets/sheet2.xml", sheet(rows))
    found = registry.read(spark, tmp_path / "b.xlsx", Options())
    got = found.df.collect()
    assert found.reader == "excel" and found.meta["sheet"] == "data" and found.meta["other_sheets"] == ["small"]
    assert sorted((r.station, r.t, r.n) for r in got) == sorted(("Amman", i + 0.5, 1000.0 + i) for i in range(20))


def test_vector_layers(spark, tmp_path):
    points = [(35 + i / 10, 31 + i / 20) for i in range(10)]
    body = b"".join(struct.pack(">ii", i + 1, 10) + struct.pack("<i2d", 1, *p) for i, p in enumerate(points))
    (tmp_path / "points.shp").write_bytes(struct.pack(">i", 9994).ljust(100, b"\0") + body)
    fields = b"".join(n.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([8]) + b"\0" * 15 for n in ("name", "value"))
    (tmp_path / "points.dbf").write_bytes(b"\x03\x7a\x01\x01" + struct.pack("<IHH", 10, 33 + len(fields), 17) + b"\0" * 20 + fields + b"\r" + b"".join(b" " + f"p{i}".encode().ljust(8) + f"{i}.25".encode().ljust(8) for i in range(10)))
    got = registry.read(spark, tmp_path / "points.shp", Options())
    assert sorted((r.name, r.value, r.longitude, r.latitude) for r in got.df.collect()) == sorted((f"p{i}", i + 0.25, *map(float, p)) for i, p in enumerate(points))
    db = sqlite3.connect(tmp_path / "sites.gpkg")
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name, column_name)")
    for name, n in (("few", 2), ("sites", 10)):
        db.execute(f"CREATE TABLE {name} (geom BLOB, name TEXT, value REAL)")
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom')", (name,))
        db.executemany(f"INSERT INTO {name} VALUES (?, ?, ?)", [(b"GP\0\x01" + struct.pack("<i", 4326) + struct.pack("<BI2d", 1, 1, *points[i]), f"s{i}", i / 2) for i in range(n)])
    db.commit()
    db.close()
    got = registry.read(spark, tmp_path / "sites.gpkg", Options())
    assert got.meta["layer"] == "sites" and got.meta["layers"] == {"few": 2, "sites": 10}
    assert sorted((r.name, r.value, r.longitude) for r in got.df.collect()) == sorted((f"s{i}", i / 2, p[0]) for i, p in enumerate(points))
    assert workbooks.wkb_point(None) == (None, None, None)


@pytest.mark.parametrize("how", range(5))
def test_png(spark, tmp_path, how):
    x = RNG.integers(0, 256, (13, 17, 3)).astype(np.uint8)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    flat, lines = x.reshape(13, 51).astype(int), b""
    for y in range(13):
        up = flat[y - 1] if y else np.zeros(51, int)
        left, corner = np.concatenate([[0] * 3, flat[y][:-3]]), np.concatenate([[0] * 3, up[:-3]])
        guess = left + up - corner
        near = np.where((abs(guess - left) <= abs(guess - up)) & (abs(guess - left) <= abs(guess - corner)), left, np.where(abs(guess - up) <= abs(guess - corner), up, corner))
        lines += bytes([how]) + ((flat[y] - [0, left, up, (left + up) // 2, near][how]) & 255).astype(np.uint8).tobytes()
    raw = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 17, 13, 8, 2, 0, 0, 0)) + chunk(b"tEXt", b"k\0v") + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    pixels, texts = images.png_pixels(raw)
    assert (pixels == x).all() and texts == {"k": "v"}
    if how == 4:
        (tmp_path / "p.png").write_bytes(raw)
        (r,) = explore(spark, tmp_path / "p.png")
        assert r["kind"] == "image" and r["image"]["brightness_pct"] > 0 and not math.isnan(r["image"]["contrast_pct"])
    assert images.degrees((31, 57, 0), "S") == pytest.approx(-31.95)


def test_other_bytes_are_not_these_formats():
    for f in (arrays.netcdf_header, arrays.tiff_tags, images.png_pixels):
        with pytest.raises(NotThisFormat):
            f(b"something else entirely")
