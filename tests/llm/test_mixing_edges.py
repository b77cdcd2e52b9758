"""Mixing where many rows share an id, a text or a source, and the shape of the plans of stages."""

import pytest
from pyspark.sql import functions as F

from plumbline.llm import mixing, quality

DDL = "doc_id long, text string, source string, lang string, target double"


def check(spark, rows, block=4):
    df = spark.createDataFrame(rows, DDL).repartition(3)
    size = lambda t: len((t or "").split())
    both = {"rows": mixing.mix(df).collect(), "sizes": mixing.mix_sizes(df).collect(), "taken": mixing.mix(df, taken_only=True).filter("copies > 0").collect()}
    assert len(both["rows"]) == len(both["sizes"]) == len(rows)
    assert sorted(map(repr, ((r.doc_id, r.text, r.source, r.lang) for r in both["rows"]))) == sorted(map(repr, ((i, t, s, x) for i, t, s, x, _ in rows)))
    assert all(r["size"] == size(r.text) and r.taken == r.copies * r["size"] for r in both["rows"])
    sums = {}
    for name, got in both.items():
        for r in got:
            sums.setdefault(name, {}).setdefault(r.source, [0, 0.0, 0])
            sums[name][r.source][0] += r.copies
            sums[name][r.source][1] = r.target
            sums[name][r.source][2] += r.taken
    assert sums["rows"] == sums["sizes"]
    assert {s: v for s, v in sums["rows"].items() if v[0]} == sums.get("taken", {})
    return sums["rows"]


@pytest.mark.parametrize("block", [4, 2048])
def test_rows_that_share_everything(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", block)
    rows = [(None, None, None, "x", -1.0)] * 40 + [(None, "a b c", "one", "x", -1.0)] * 40 + [(7, "a b", "one", str(k % 9), -1.0) for k in range(40)]
    rows += [(i, "w " * (i % 13), "two" if i % 3 else "one", "y", -1.0) for i in range(100, 200)]
    got = check(spark, rows)
    # Null stands last, so the sources weigh 5, 2 and 1; the one without words takes none.
    assert got[None][1] == 0 and abs(got["one"][2] - got["one"][1]) <= 15 and abs(got["two"][2] - got["two"][1]) <= 15


def test_no_words_one_source_and_nulls_only(spark):
    assert check(spark, [(i, None if i % 2 else "", "s", "x", -1.0) for i in range(9)])["s"][1:] == [0.0, 0]
    one = check(spark, [(i, "a " * i, "s", "x", -1.0) for i in range(30)])["s"]
    assert one == [30, 435.0, 435]
    nulls = check(spark, [(i, "a " * i, None, "x", -1.0) for i in range(30)])[None]
    assert nulls == [30, 435.0, 435]


def test_a_filter_on_the_score_computes_each_count_once(spark):
    df = spark.createDataFrame([(i, f"{'Some words here.' if i % 2 else 'XX!! YY!!'} {i}", int(i % 2)) for i in range(400)], "doc_id long, text string, quality int")
    model = quality.fit(df, df.select("doc_id", "quality"))
    assert model.rules
    plan = quality.score(df, model).filter("predicted = 1").select("doc_id", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == len(quality.COUNTS) and "Generate" in plan
    assert quality.score(df, model).filter("predicted = 1").count() == quality.score(df, model).filter(F.col("predicted") == 1).count() > 0


def test_texts_are_counted_once_and_move_once(spark):
    df = spark.createDataFrame([(i, "a b " * i, "s") for i in range(50)], "doc_id long, text string, source string")
    plan = mixing.mix(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("regexp") == 0
