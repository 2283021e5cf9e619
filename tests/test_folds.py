"""Contiguous folds, linear fits that leave a fold out, the logistic certificate, the predictions sink."""

import numpy as np
import pytest

from kiln.operators import certificate, ml
from kiln.plans import folds as P7
from kiln.sources import io


def stratified(labels, k):
    """The rule written plainly: places of the sorted labels dealt in turn, runs per label."""
    seen = list(dict.fromkeys(labels))
    ranked = sorted(seen.index(v) for v in labels)
    out, runs = [], {}
    for c, v in enumerate(seen):
        share = [sum(1 for p in range(f, len(labels), k) if ranked[p] == c) for f in range(k)]
        runs[v] = iter([f for f in range(k) for _ in range(share[f])])
    for v in labels:
        out.append(next(runs[v]))
    return out


@pytest.mark.parametrize("n,k", [(0, 3), (2, 5), (5, 5), (23, 5), (100, 7)])
def test_plain_folds_are_runs(spark, n, k):
    df = spark.range(n).selectExpr("id", "cast(id * 7 % 5 as int) as x")
    got = [r["fold"] for r in P7.contiguous_folds(df, k, ["id"]).orderBy("id").collect()]
    want = [f for f, part in enumerate(np.array_split(np.arange(n), k)) for _ in part]
    assert got == want


@pytest.mark.parametrize("k", [2, 5])
def test_stratified_folds_follow_the_rule(spark, k):
    rng = np.random.default_rng(3)
    labels = [["b", "a", None, "c"][i] for i in rng.choice(4, 157, p=[.6, .25, .1, .05])]
    df = spark.createDataFrame(list(enumerate(labels)), "id long, label string").repartition(5)
    got = [r["fold"] for r in P7.contiguous_folds(df, k, ["id"], "label").orderBy("id").collect()]
    assert got == stratified(labels, k)


def frame(spark, n=400, shift=0.0):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 2)) * [1.0, 50.0] + shift
    cols = np.column_stack([x, x[:, 0] * 2 - 1, np.full(n, 7.0)])           # one dependent, one constant feature
    y = 3 + 2 * x[:, 0] - x[:, 1] + rng.normal(size=n)
    rows = [(int(i), *map(float, c), float(v)) for i, (c, v) in enumerate(zip(cols, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y double"), cols, y


@pytest.mark.parametrize("shift", [0.0, 1e7])
def test_leave_fold_out_fits_against_numpy(spark, shift):
    df, x, y = frame(spark, shift=shift)
    f = P7.contiguous_folds(df, 5, ["id"])
    names = list("abcd")
    fits = P7.leave_fold_out_ols(f, names, "y", "fold", 5)
    scores = {r["fold"]: r["score"] for r in P7.held_out_scores(f, fits, names, "y", "fold").collect()}
    for k, held in enumerate(np.array_split(np.arange(len(y)), 5)):
        rest = np.setdiff1d(np.arange(len(y)), held)
        mean, dev = x[rest].mean(0), x[rest].std(0)
        dev[dev == 0] = 1
        z = lambda r: np.column_stack([(x[r] - mean) / dev, np.ones(len(r))])
        b = np.linalg.lstsq(z(rest), y[rest], rcond=1e-8)[0]
        assert scores[k + 1] == pytest.approx(-np.mean((y[held] - z(held) @ b) ** 2), rel=1e-5)


def test_fits_of_folds_without_rows(spark):
    df, _, _ = frame(spark, 6)
    f = P7.contiguous_folds(df, 8, ["id"])
    fits = P7.leave_fold_out_ols(f, ["a"], "y", "fold", 8)
    assert fits.count() == 8
    assert P7.held_out_scores(f, fits, ["a"], "y", "fold").count() == 6


def test_cv_of_a_linear_model_is_one_of_contiguous_folds(spark):
    df, _, _ = frame(spark)
    flagged = df.selectExpr("*", "id % 4 = 0 as t")
    res = ml.train_model(flagged, "y", "Linear Regression", ["a", "b"], problem_type=ml.REGRESSION, test_flag="t",
                         order_by=["id"])
    train = P7.contiguous_folds(flagged.filter("not t"), 5, ["id"])
    fits = P7.leave_fold_out_ols(train, ["a", "b"], "y", "fold", 5)
    want = sorted(map(tuple, P7.held_out_scores(train, fits, ["a", "b"], "y", "fold").collect()))
    assert sorted(map(tuple, res.cv_scores.collect())) == [(f, pytest.approx(s)) for f, s in want]
    assert set(res.predictions.columns) >= {"a", "b", "label", "prediction"}
    assert not [c for c in res.predictions.columns if c.startswith("__")]


def numeric_gradient(x, y, w, b, reg, classes):
    def loss(v):
        wv, bv = v[:w.size].reshape(w.shape), v[w.size:]
        full, ints = (np.vstack([0 * wv, wv]), np.append(0 * bv, bv)) if len(w) == 1 else (wv, bv)
        m = x @ full.T + ints
        return np.mean(np.log(np.exp(m).sum(1)) - m[np.arange(len(y)), y]) + reg / 2 * (wv ** 2).sum()
    v = np.concatenate([w.ravel(), b])
    eye = np.eye(len(v)) * 1e-5
    return np.array([(loss(v + e) - loss(v - e)) / 2e-5 for e in eye]), loss(v)


@pytest.mark.parametrize("classes", [2, 3])
def test_logistic_gradient_against_differences(spark, classes):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(200, 2)), rng.integers(0, classes, 200)
    w = rng.normal(size=(1 if classes == 2 else classes, 2))
    b = rng.normal(size=len(w))
    df = spark.createDataFrame([(float(p), float(q), int(c)) for (p, q), c in zip(x, y)] + [(None, 1.0, 0)],
                               "p double, q double, y int").repartition(3)
    rows = certificate.logistic_gradient(df, ["p", "q"], "y", w, b, 0.3).collect()
    want, loss = numeric_gradient(x, y, w, b, 0.3, classes)
    first = 1 if classes == 2 else 0
    for r in rows:
        k = r["class"] - first
        at = w.size + k if r["feature"] == certificate.INTERCEPT else k * 2 + ["p", "q"].index(r["feature"])
        assert r["gradient"] == pytest.approx(want[at], abs=1e-6)
        assert r["loss"] == pytest.approx(loss)
    assert len(rows) == w.size + len(b)
    assert certificate.logistic_gradient(df.limit(0), ["p", "q"], "y", w, b, 0.3).count() == 0


@pytest.mark.parametrize("classes", [2, 3])
def test_certificate_holds_at_the_fit_and_not_beside_it(spark, classes):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 2)) * [1.0, 200.0]
    y = (x[:, 0] + rng.normal(size=300) > 0).astype(int) + (classes == 3) * (rng.random(300) < .3)
    df = spark.createDataFrame([(float(p), float(q), f"k{c}") for (p, q), c in zip(x, y)], "p double, q double, y string")
    res = ml.train_model(df, "y", "Logistic Regression", ["p", "q"], cv_folds=2)
    train = res.extra["train"]
    assert all(r["within"] for r in certificate.logistic_certificate(train, res.model, res.features).collect())
    m = res.model.stages[-1]
    off = certificate.logistic_gradient(train, res.features, "label", m.coefficientMatrix.toArray() * 2,
                                        m.interceptVector.toArray(), m.getRegParam())
    assert off.filter(f"abs(gradient) > {certificate.GRADIENT_BOUND} * scale").count() > 0


def test_predictions_sink_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.5, 2.25), (None, 0.5, -1.0)], "x double, label double, prediction double")
    path = str(tmp_path / "p")
    io.write_predictions(df, ["x"], path)
    back = io.read_csv(spark, path)
    assert back.columns == ["x", "y_actual", "y_predicted"]
    assert sorted(map(tuple, back.collect()), key=str) == sorted([(1.0, 2.5, 2.25), (None, 0.5, -1.0)], key=str)
