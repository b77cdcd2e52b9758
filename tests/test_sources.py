import gzip
import json
import zipfile

import numpy as np
import pytest

from plumbline.operators import claims
from plumbline.plans.explore import explore
from plumbline.sources import files, rasters, registry, tabular, unknown
from plumbline.sources.registry import Options


def one(spark, path, **options):
    (r,) = explore(spark, path, options=Options(**options))
    assert "error" not in r, r
    return r


def stats(r, column):
    return next(s for s in r["statistics"] if s["column"] == column)


def test_delimited_with_decimal_comma_and_day_first(spark, tmp_path):
    rows = [f"{d:02d}/{m:02d}/2018;{d + m / 10:.1f}".replace(".", ",") for m in range(1, 7) for d in range(1, 29)]
    (tmp_path / "a.csv").write_text("date;value\n" + "\n".join(rows))
    r = one(spark, tmp_path / "a.csv")
    assert r["meta"]["decimal"] == "comma" and stats(r, "value")["count"] == 168
    assert r["coverage"]["n_steps"] == 168 and stats(r, "value")["min"] == pytest.approx(1.1)


def test_header_text_units_row_thousands_and_sentinels(spark, tmp_path):
    lines = ["-BEGIN-", "some station", "-END-", "date,rain_mm,count", ",mm,"]
    lines += [f'2020-{m:02d}-{d:02d},{-999 if d == 3 else d / 10},"1,{d:03d}"' for m in range(1, 4) for d in range(1, 29)]
    (tmp_path / "b.csv").write_text("\n".join(lines))
    r = one(spark, tmp_path / "b.csv")
    assert r["reader"] == "delimited-text" and "station" in r["meta"]["header_text"]
    assert stats(r, "rain_mm")["count"] == 81 and stats(r, "count")["max"] == 1028


def test_events_with_places(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = ["acq_date,latitude,longitude,frp,daynight"]
    for _ in range(1200):
        a, b = ((31.2, 35.2), (33.7, 38.1))[rng.integers(2)]
        rows.append(f"2020-{rng.integers(7, 9):02d}-{rng.integers(1, 29):02d},{a + rng.normal(0, 0.05):.3f},{b + rng.normal(0, 0.05):.3f},{rng.gamma(2, 5):.2f},{'DN'[rng.integers(2)]}")
    (tmp_path / "fires.csv").write_text("\n".join(rows))
    r = one(spark, tmp_path / "fires.csv")
    assert r["events"]["total"] == 1200 and r["events"]["peak_month"] in (7, 8)
    assert len(r["events"]["hotspots"]) == 2 and all(30 < h["share_pct"] < 70 for h in r["events"]["hotspots"])
    part = one(spark, tmp_path / "fires.csv", bbox=(34, 30, 36, 32))
    assert 300 < part["summary"]["n_rows"] < 900


def test_json_tables(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"meta": {"n": 3}, "rows": [{"date": f"2020-01-{d:02d}", "v": d, "at": {"coordinates": [35.0, 31.0]}} for d in range(1, 21)]}))
    r = one(spark, tmp_path / "r.json")
    assert r["summary"]["n_rows"] == 20 and stats(r, "v")["max"] == 20
    assert tabular.largest_table({"p": {"T": {"20200101": 1.0, "20200102": 2.0, "20200103": 4.0}, "R": {"20200101": 5.0, "20200102": 6.0, "20200103": 7.0}}}) == [{"key": "20200101", "T": 1.0, "R": 5.0}, {"key": "20200102", "T": 2.0, "R": 6.0}, {"key": "20200103", "T": 4.0, "R": 7.0}]


def test_tile_documents_archives_and_folder(spark, tmp_path):
    z = np.add.outer(np.arange(61), np.zeros(61)).astype(">i2")
    z[0, 0] = rasters.VOID
    (tmp_path / "N10E020.hgt").write_bytes(z.tobytes())
    r = one(spark, tmp_path / "N10E020.hgt")
    assert r["kind"] == "grid" and r["elevation"]["max"] == 60 and r["elevation"]["voids_pct"] > 0
    (tmp_path / "p.html").write_text("<html><title>x</title><body><h1>Head</h1><script>no()</script><p>Rain fell 39 mm from 2001-2020.</p></body></html>")
    r = one(spark, tmp_path / "p.html")
    assert r["meta"]["title"] == "Head" and r["study_period"]["start_year"] == 2001 and "39 mm" in r["quantities"]
    (tmp_path / "n.md").write_text("# Title\n\nwords here\n")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as f:
        f.writestr("in/a.csv", "a,b\n1,2\n3,4\n")
    with gzip.open(tmp_path / "g.csv.gz", "wb") as f:
        f.write(b"a,b\n1,2\n3,4\n")
    (tmp_path / "m.bin").write_bytes(b"\x00\x01\x02junk")
    (tmp_path / "e.csv").write_bytes(b"")
    (tmp_path / "x.grib").write_bytes(b"GRIBrest")
    (tmp_path / "x.grib.idx").write_text("<x/>")
    got = explore(spark, tmp_path, tmp_path / "out")
    assert len(got) == 8
    assert any(q["code"] == "empty_file" for r in got for q in r.get("quality", []))
    assert any("install cfgrib" in p for r in got for p in r.get("problems", []))
    assert (tmp_path / "out" / "index.html").exists() and len(list((tmp_path / "out").glob("*.json"))) == 8
    assert explore(spark, tmp_path, tmp_path / "out", reuse=True) != got


def test_unsafe_archives_are_refused(tmp_path):
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as f:
        f.writestr("../evil.txt", "x")
    with pytest.raises(ValueError):
        files.unpack(tmp_path / "bad.zip", tmp_path / "o")
    with zipfile.ZipFile(tmp_path / "bomb.zip", "w", zipfile.ZIP_DEFLATED) as f:
        f.writestr("big", b"0" * (4 << 20))
    with pytest.raises(ValueError):
        files.unpack(tmp_path / "bomb.zip", tmp_path / "o", most_bytes=1 << 20)
    assert not (tmp_path / "o").exists()


def test_small_helpers(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"\x89PNG....")
    assert unknown.signatures(spark, str(tmp_path / "f.bin")).first()["signature"] == "PNG"
    assert rasters.body_of("+proj=stere +R=1737400") == "Moon" and rasters.body_of(label="TARGET_NAME = MARS") == "Mars" and rasters.body_of() == "Earth"
    assert files.strict({"a": float("nan"), "b": [float("inf"), 1]}) == {"a": None, "b": [None, 1]}
    assert [r.name for r in registry.candidates(tmp_path / "a.parquet", b"PAR1")][:1] == ["parquet"]
    with pytest.raises(ValueError):
        files.point_series_url("http://host/api", 91, 0, "2020-01-01", "2020-12-31", ("T",))
    assert "longitude=-170.0" in files.point_series_url("http://host/api", 1, 190, "2020-01-01", "2020-12-31", ("T",))


def statuses(spark, facts, said):
    rows = [(k, *(list(x) + [None, None])[:3]) for k, x in enumerate(said)]
    got = claims.verify(spark.createDataFrame(rows, "k int, text string, value double, fact string"), claims.facts_table(spark, facts))
    assert got.columns == ["k", "text", "value", "fact", "status"]
    return [r.status for r in got.orderBy("k").collect()]


def test_claims(spark):
    facts = {"statistics": {"t": {"mean": 12.345}, "share": {"mean": 0.25}}, "trends": {"t": {"slope_per_year": 0.05, "mk_p": 0.4}, "u": {"slope_per_year": -2.0, "mk_p": 0.001}}, "summary": {"n_rows": 240}}
    cases = [
        (("The mean is 12.3.", 12.3, "statistics.t.mean"), "verified"), (("The mean is 14.", 14.0, "statistics.t.mean"), "mismatch"), (("The mean is 12.3 of 77.", 12.3, "statistics.t.mean"), "unsupported"),
        (("x", 1.0, "statistics.u.mean"), "unsupported"), (("Looks even.",), "qualitative"), (("About 5 people.",), "unsupported"), (("It rises by 0.05 a year.", 0.05, "trends.t.slope_per_year"), "mismatch"),
        (("The rise of 0.05 a year is not significant at 95% (p<0.5).", 0.05, "trends.t.slope_per_year"), "verified"), (("The rise of 0.05 is insignificant at the 95% confidence level.", 0.05, "trends.t.slope_per_year"), "verified"),
        (("It falls by 2 a year.", -2.0, "trends.u.slope_per_year"), "unsupported"), (("It changes by \u22122.0 a year over 240 rows.", -2.0, "trends.u.slope_per_year"), "verified"), (("Its change of -2 is not significant.", -2.0, "trends.u.slope_per_year"), "mismatch"),
        (("A share of 25% is cloudy.",), "verified"), ((None,), "qualitative"), (("CO2 and T2M look even.",), "qualitative"), (("The share is 0.25, from 2001-2020.",), "unsupported"), (("Mean 1,234.", None, ""), "unsupported"), ((None, 12.345, "statistics.t.mean"), "verified"),
    ]
    assert statuses(spark, facts, [c for c, _ in cases]) == [s for _, s in cases]
    assert claims.loose_json("```json\n{\"a\": [1, 2,],}\n```") == {"a": [1, 2]} and claims.loose_json("none") is None and claims.loose_json('so {x} then {"b": "1,]"} end') == {"b": "1,]"}
    assert claims.fact_paths({"a": {"b": 1}, "c": [2, 3], "d": [2, {"d": "x"}], "e": "y" * 81, "f": float("nan"), "g": list(range(9)), "h": "z"}) == {"a.b": 1, "c.0": 2, "c.1": 3, "h": "z"}


def test_wrong_claims_rarely_pass(spark):
    rng = np.random.default_rng(4)
    facts = {"statistics": {f"v{i}": {"mean": float(rng.normal(0, 100))} for i in range(20)}}
    wrong, right = [], []
    for k, v in facts["statistics"].items():
        for _ in range(10):
            bad = float(v["mean"] * (1 + rng.choice([-1, 1]) * rng.uniform(0.02, 0.5)) + 0.2)
            wrong.append((f"The mean is {bad:.2f}.", round(bad, 2), f"statistics.{k}.mean"))
            right.append((f"The mean is {v['mean']:.2f}.", round(v["mean"], 2), f"statistics.{k}.mean"))
    assert statuses(spark, facts, wrong).count("verified") < 0.05 * 200 and statuses(spark, facts, right).count("verified") > 0.95 * 200


def test_rows_that_equal_the_header_or_lack_values_stay(spark, tmp_path):
    rows = ["a,b,c", ",mm,K"] + [f"x{i},{i},{i + 0.5}" for i in range(100)] + ["a,b,c", "x,,", "x,,"]
    (tmp_path / "t.csv").write_text("\n".join(rows))
    found = tabular.read_delimited(spark, tmp_path / "t.csv", Options())
    got = found.df.collect()
    assert found.meta["units"] == {"b": "mm", "c": "K"} and len(got) == 103 and sum(r.b is None for r in got) == 3 and sum(r.a == "a" for r in got) == 1
    (tmp_path / "q.csv").write_text('note\na,b,c\n' + "\n".join(f'x{i},"line one\nline {i}",{i}' for i in range(20)))
    got = tabular.read_delimited(spark, tmp_path / "q.csv", Options()).df.collect()
    assert len(got) == 20 and {r.b for r in got} == {f"line one\nline {i}" for i in range(20)} and sorted(r.c for r in got) == list(range(20))


def test_companions_and_stores(tmp_path):
    for n in ("a.shp", "a.dbf", "a.shx", "b.dbf", "c.tif", "c.tif.aux.xml", "c.tif.ovr", "d.idx", ".hidden", "sub/e.csv", "sub/s.zarr/.zgroup", "sub/k/.zarray", "out/r.json"):
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text("x")
    got = [str(p.relative_to(tmp_path)) for p in files.inputs(tmp_path, tmp_path / "out")]
    assert got == ["a.shp", "b.dbf", "c.tif", "d.idx", "sub/e.csv", "sub/k", "sub/s.zarr"]


def test_bodies():
    assert rasters.body_of('PROJCRS["x", ELLIPSOID["Mars_2000_IAU", 3396190, 169.8]]') == "Mars" and rasters.body_of('SPHEROID["s",2439400.0,0]') == "Mercury"
    assert rasters.body_of("+proj=longlat +a=6378137 +b=6356752") == "Earth" and rasters.body_of(label='{"target": "Venus",') == "Venus" and rasters.body_of('GEOGCS["GCS_Moon_2000"]') == "Moon"


def test_stream_equals_batch(spark, tmp_path):
    from plumbline.streaming import profile as stream

    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = stream.daily_counts(s, "ts", late="40 days").writeStream.outputMode("complete").format("memory").queryName("days").start()
    q.processAllAvailable()
    q.stop()
    got = {str(r["day"]): r["n"] for r in spark.table("days").collect()}
    want = {str(r["day"]): r["count"] for r in src.selectExpr("to_date(ts) AS day").groupBy("day").count().collect()}
    assert got == want
