"""Every registered query that has SQL equals DuckDB on the small tables."""

import math

import duckdb
import pytest

from plumbline.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.8g}") + 0.0 if math.isfinite(v) else str(v)
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    if name not in ORACLE:
        assert rows
        return
    cur = duck.execute(ORACLE[name])
    own = [d[0] for d in cur.description]
    assert sorted(own) == names
    want = [tuple(plain(r[own.index(c)]) for c in names) for r in cur.fetchall()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))
