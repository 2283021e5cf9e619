"""Boosted trees on the cells of their bins are those on the rows."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor

from kiln.operators import boosted, ml


def features(spark, n, classes):
    rng = np.random.default_rng(8)
    a, b, c = rng.integers(0, 12, n), rng.normal(size=n), np.full(n, 3.0)
    y = a * 2.0 + b * b + rng.normal(size=n) * .1
    y = (y > np.median(y)).astype(float) if classes else y
    return spark.createDataFrame([(float(p), float(q), float(r), float(v)) for p, q, r, v in zip(a, b, c, y)],
                                 "a double, b double, c double, label double").coalesce(1).cache()


@pytest.mark.parametrize("classes", [False, True])
def test_boosted_trees_on_cells_are_those_on_rows(spark, classes):
    df = features(spark, 3000, classes)
    make = lambda: (GBTClassifier if classes else GBTRegressor)(maxIter=6, maxDepth=4, stepSize=0.3, seed=1)
    stages = [VectorAssembler(inputCols=list("abc"), outputCol="features")]
    plain = Pipeline(stages=[*stages, make()]).fit(df)
    cells = boosted.fit(df, list("abc"), Pipeline(stages=stages).fit(df), make(), 3000, classes)
    one = lambda m: np.array([r["prediction"] for r in m.transform(df).select("prediction").collect()])
    assert np.mean(np.abs(one(plain) - one(cells)) > 1e-6) < 0.01        # equal gains may fall either way
    assert np.allclose(plain.stages[-1].featureImportances.toArray(), cells.stages[-1].featureImportances.toArray(), atol=0.01)


def test_cells_do_not_follow_the_rows(spark, monkeypatch):
    made, cells = [], boosted.cells
    monkeypatch.setattr(ml, "BOOSTED_ROUNDS", 3)
    monkeypatch.setattr(boosted, "cells", lambda *a: made.append(cells(*a)) or made[-1])
    df = spark.range(30_000).selectExpr("cast(id as double) x", "cast(hash(id) % 50 as double) z", "cast(id % 11 as double) y")
    res = ml.train_model(df, "y", "XGBoost Regressor", problem_type=ml.REGRESSION, cv_folds=0)
    assert max(c.count() for c in made) <= 32 * 32                      # 24,000 rows in every round before
    assert sum(r[boosted.WEIGHT] for r in made[0].collect()) == 24_000 == res.extra["train"].count()


def test_bin_ends_and_constant_features(spark, monkeypatch):
    monkeypatch.setattr(ml, "BOOSTED_ROUNDS", 3)
    assert boosted.bin_ends(np.array([1., 1., 2., 5.]), 31).tolist() == [1.5, 3.5]
    assert len(boosted.bin_ends(np.arange(1000.0), 31)) == 31
    df = spark.createDataFrame([(1.0, float(i % 2)) for i in range(40)], "c double, y double")
    res = ml.train_model(df, "y", "XGBoost Regressor", problem_type=ml.REGRESSION, cv_folds=2)
    assert {r["metric"] for r in res.metrics.collect()} == {"RMSE", "MAE", "R2"}
