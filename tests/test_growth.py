"""What queries exchange and what one task reads stay in proportion to the input; results equal DuckDB on odd rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from plumbline.operators import documents, profile, quantiles
from plumbline.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.01"


def stages(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {(found.apply(i).stageId(), found.apply(i).attemptId()): found.apply(i) for i in range(found.size())}


def measured(spark, run):
    """Result of ``run`` and the stages it added."""
    before = set(stages(spark))
    out = run()
    return out, [s for k, s in stages(spark).items() if k not in before]


def test_search_exchanges_less_than_its_texts_twice(spark):
    text = duckdb.sql(f"SELECT sum(strlen(text)) FROM '{SF}/documents.parquet'").fetchall()[0][0]
    rows, added = measured(spark, lambda: QUERIES["tfidf_search"](spark, SF).collect())
    assert len(rows) == 6
    assert sum(s.shuffleWriteBytes() for s in added) < 2 * text


@pytest.mark.parametrize("most", [1, 64, 1 << 19])
def test_search_on_odd_rows(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(documents, "COMMON_TERMS", most)
    rows = [(1, "the cat that sat"), (1, "the dog worthless dog"), (2, None), (None, "the that worthless"), (3, ""), (4, "THAT the-that é " + "x" * 99), (5, "worthless"), (6, "- a b"), (7, "dog cat"), (8, "The the THE that that"), (8, "x1 x2 that")]
    at = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(at)
    want = duckdb.sql(ORACLE["tfidf_search"].replace("FROM documents", f"FROM '{at}/*.parquet'")).fetchall()
    got = [tuple(r) for r in QUERIES["tfidf_search"](spark, str(tmp_path)).collect()]
    assert [g[0] for g in got] == [w[0] for w in want] and len(got) == 4
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=2e-6)


def test_one_task_reads_few_of_the_distinct_values(spark, tmp_path):
    at = str(tmp_path / "wide")
    spark.range(0, 400_000, 1, 16).select(F.rand(5).alias("x")).write.parquet(at)
    df = spark.read.parquet(at)
    got, added = measured(spark, lambda: profile.numeric_stats(df, ["x"]).first())
    want = duckdb.sql("SELECT " + ", ".join(f"quantile_cont(x, {p})" for p in profile.PERCENTILES) + f" FROM '{at}/*.parquet'").fetchall()[0]
    assert [got[n] for n in ("p05", "p25", "p50", "p75", "p95")] == pytest.approx(want, rel=1e-12)
    single = [s.shuffleReadBytes() for s in added if s.numTasks() == 1]
    assert max(single) < 8 * 400_000 / 4


@pytest.mark.parametrize("few", [0, quantiles.FEW])
def test_percentiles_of_odd_columns(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    ps = (0.0, 0.01, 0.05, 0.25, 0.5, 0.9, 0.999, 1.0)
    k = F.col("id")
    df = spark.range(0, 7001, 1, 5).select(k.alias("whole"), F.when(k % 3 == 0, k % 11).cast("double").alias("ties"), F.lit(None).cast("double").alias("none"), F.when(k == 5, 2.5).alias("one"), F.when(k < 2, k * 1e300).alias("two"), F.pow(F.lit(10.0), k % 600 - 300).alias("far"), F.lit(-7.0).alias("same"), F.when(k % 50 == 0, float("nan")).otherwise(k - 3500).alias("nan"))
    got, others = quantiles.percentiles(df, {c: (F.col(c), ps) for c in df.columns}, F.count(F.lit(1)).alias("n"))
    want = df.agg(*[F.percentile(c, F.array(*map(F.lit, ps))).alias(c) for c in df.columns]).first()
    assert others["n"] == 7001
    for c in df.columns:
        assert list(map(repr, got[c])) == list(map(repr, want[c] or [None] * len(ps))), c
