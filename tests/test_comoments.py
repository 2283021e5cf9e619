"""Pairwise co-moments in one scan against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kiln.operators import outliers
from kiln.operators.corr import correlation_matrix
from kiln.plans import comoments


def table(spark, x):
    rows = [[None if np.isnan(v) else float(v) for v in r] for r in x]
    return spark.createDataFrame(rows, ", ".join(f"c{k} double" for k in range(x.shape[1])))


def expected(x, i, j):
    both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
    a, b = x[both, i] - x[both, i].mean(), x[both, j] - x[both, j].mean()
    return (a @ b) / np.sqrt((a @ a) * (b @ b))


@pytest.mark.parametrize("group", [32, 2])
def test_pearson_with_nulls_and_a_large_mean(spark, monkeypatch, group):
    monkeypatch.setattr(comoments, "GROUP", group)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 5)) @ rng.normal(size=(5, 5)) * 1e-2 + 1e9  # a variance of squares would have no digit left
    x[rng.random(x.shape) < 0.2] = np.nan
    df = table(spark, x).repartition(7)
    got = {(r["pos_a"], r["pos_b"]): r["r"] for r in correlation_matrix(df).collect()}
    assert len(got) == 25
    for (i, j), r in got.items():
        assert r == pytest.approx(1.0 if i == j else expected(x, i, j), abs=1e-6)


def test_pearson_edges(spark):
    df = spark.createDataFrame([(1.0, 5.0, None, 1.0), (2.0, 5.0, None, float("nan")), (4.0, 5.0, 3.0, 2.0)],
                               "a double, b double, c double, d double")
    got = {(r["column_a"], r["column_b"]): r["r"] for r in correlation_matrix(df).collect()}
    assert got["a", "a"] == 1.0 and got["b", "b"] is None and got["a", "b"] is None and got["a", "c"] is None
    assert np.isnan(got["a", "d"])
    assert correlation_matrix(df.select("a")) is None
    assert [r["r"] for r in correlation_matrix(df.limit(0)).collect()] == [None] * 16


def test_one_scan_whatever_the_number_of_columns(spark):
    df = spark.range(100).select(*[(F.col("id") * k % 17).alias(f"c{k}") for k in range(1, 41)])
    out = correlation_matrix(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 1600 and plan.count("Range (") == 1


def test_clip_keeps_fractions_of_whole_numbers(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 2, 3, 4, 4, 5, 7, 100, None)], "x long")
    flagged, _ = outliers.detect_outliers(df, ["x"], "iqr", 1.5)
    got = sorted(r["x"] for r in outliers.treat_outliers(flagged, ["x"], "clip").collect() if r["x"] is not None)
    assert got == [1, 2, 2, 3, 4, 4, 5, 7, 9.5]
