"""The node table of a forest against the model it came from, and against a walk in plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kiln.operators import forest, ml


def data(spark, n=300):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 3))
    y = x[:, 0] * 2 + (x[:, 1] > 0.3)
    return spark.createDataFrame([(int(i), *map(float, v), float(t), f"c{int(t > 0) + int(t > 1.5)}", i % 3 == 0)
                                  for i, (v, t) in enumerate(zip(x, y))],
                                 "id long, a double, b double, c double, y double, k string, t boolean")


def fitted(spark, target, name):
    df = data(spark).select("a", "b", "c", target, "t")
    res = ml.train_model(df, target, name, ["a", "b", "c"], test_flag="t", cv_folds=0, tree_depth=6, scale_features=False)
    rows = res.predictions.withColumn("row", F.monotonically_increasing_id()).checkpoint()
    return res, forest.node_table(res.model).checkpoint(), rows


def plain_leaf(nodes, tree, x):
    at = 0
    while nodes[tree, at]["left"] is not None:
        n = nodes[tree, at]
        at = n["left"] if x[n["feature"]] <= n["threshold"] else n["right"]
    return nodes[tree, at]["stats"]


@pytest.mark.parametrize("broadcast", [True, False])
def test_regression(spark, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(forest, "BROADCAST_NODES", 0)
    res, nodes, rows = fitted(spark, "y", "Random Forest Regressor")
    levels = forest.depth(res.model)
    assert 1 <= levels <= 6
    small = rows.limit(20).checkpoint()
    got = {r["row"]: r["prediction"] for r in forest.predict_regression(
        small, nodes, res.features, levels, "row").collect()}
    table = {(r["tree"], r["node"]): r for r in nodes.collect()}
    trees = {t for t, _ in table}
    assert len(got) == 20
    for r in small.collect():
        leaf = [plain_leaf(table, t, [r["a"], r["b"], r["c"]]) for t in trees]
        assert got[r["row"]] == pytest.approx(r["prediction"])
        assert got[r["row"]] == pytest.approx(np.mean([s[1] / s[0] for s in leaf]))


def test_votes(spark):
    res, nodes, rows = fitted(spark, "k", "Random Forest Classifier")
    share = forest.votes(rows, nodes, res.features, forest.depth(res.model), "row").collect()
    by_row = {}
    for r in share:
        by_row.setdefault(r["row"], {})[r["class"]] = r["share"]
    assert len(by_row) == rows.count()
    for r in rows.collect():
        mine = by_row[r["row"]]
        assert sum(mine.values()) == pytest.approx(1)
        for c, p in enumerate(r["probability"]):
            assert mine.get(c, 0.0) == pytest.approx(p)
        assert mine[int(r["prediction"])] == pytest.approx(max(mine.values()))


@pytest.mark.parametrize("target,name,kind", [("y", "Random Forest Regressor", forest.VARIANCE),
                                              ("k", "Random Forest Classifier", forest.GINI)])
def test_gains_and_importance(spark, target, name, kind):
    res, nodes, _ = fitted(spark, target, name)
    gains = forest.split_gains(nodes, kind).collect()
    assert len(gains) == nodes.filter("left is not null").count() > 0
    assert all(g["gain"] == pytest.approx(g["model_gain"], abs=1e-9) for g in gains)
    got = {r["feature"]: r["importance"] for r in forest.impurity_importance(nodes, res.features, kind).collect()}
    want = {r["feature"]: r["importance"] for r in res.importance.collect()}
    assert got == {f: pytest.approx(v) for f, v in want.items()}
    assert sum(got.values()) == pytest.approx(1)


def test_trees_without_a_split(spark):
    df = spark.createDataFrame([(1.0, 5.0, i == 0) for i in range(6)], "a double, y double, t boolean")
    res = ml.train_model(df, "y", "Random Forest Regressor", ["a"], test_flag="t", cv_folds=0, problem_type=ml.REGRESSION)
    nodes = forest.node_table(res.model)
    rows = res.predictions.withColumn("row", F.lit(1))
    assert forest.depth(res.model) == 0
    assert [r["prediction"] for r in forest.predict_regression(rows, nodes, ["a"], 0, "row").collect()] == [5.0]
    assert [r["importance"] for r in forest.impurity_importance(nodes, ["a"], forest.VARIANCE).collect()] == [0.0]
    assert res.cv_scores.count() == 0


def test_trees_in_groups_that_are_broadcast(spark, monkeypatch):
    """A node table beyond the bound is taken a few trees at a time; no level shuffles the rows."""
    res, nodes, rows = fitted(spark, "y", "Random Forest Regressor")
    levels = forest.depth(res.model)
    monkeypatch.setattr(forest, "BROADCAST_NODES", nodes.count() // 2)
    ends = forest.leaves(rows, nodes, res.features, levels, "row")
    plan = ends._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join" in x]
    assert len(joins) > 2 * levels and all("broadcast" in x for x in joins if "LeftOuter" in x)
    assert ends.count() == rows.count() * ml.FOREST_TREES


@pytest.mark.parametrize("name", ["Random Forest Regressor", "Random Forest Classifier"])
def test_one_forest_at_a_time(spark, name, monkeypatch):
    """Folds' forests follow one another, and a row keeps its node of every tree between levels."""
    from concurrent.futures import ThreadPoolExecutor
    monkeypatch.setattr(ml, "FOREST_TREES", 3)
    seen = []

    def pool(max_workers):
        seen.append(max_workers)
        return ThreadPoolExecutor(max_workers=max_workers)

    monkeypatch.setattr(ml, "ThreadPoolExecutor", pool)
    kind, target = (ml.REGRESSION, "y") if "Regressor" in name else (ml.CLASSIFICATION, "k")
    res = ml.train_model(data(spark, 120).select("a", "b", target), target, name, problem_type=kind, cv_folds=2, tree_depth=3)
    assert seen == [1]
    assert res.cv_scores.count() == 2
    assert ml.get_estimator(name, kind).getCacheNodeIds()
