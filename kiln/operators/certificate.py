"""Optimality of a fitted logistic model, checked apart from its solver.

A minimum of the penalised mean log-loss has gradient zero.  ``logistic_gradient``
takes the gradient at given coefficients in one scan; ``logistic_certificate`` does so
at a fitted model's own and compares every term with a bound in the feature's scale.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# the functions below run in Python workers, which need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

INTERCEPT = "(intercept)"
#: Largest gradient of a term allowed, in units of the feature's root mean square.
GRADIENT_BOUND = 1e-3


def _sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Sums over rows of (p - [class]) x and of x squared (last term: 1), and of the log-loss."""
    margin = x @ w.T + b
    margin -= margin.max(1, keepdims=True)
    e = np.exp(margin)
    total = e.sum(1, keepdims=True)
    off = e / total
    at = np.arange(len(y))
    loss = (np.log(total[:, 0]) - margin[at, y]).sum()
    off[at, y] -= 1.0
    x1 = np.hstack([x, np.ones((len(x), 1))])
    return off.T @ x1, (x1 * x1).sum(0), float(loss)


def logistic_gradient(df: DataFrame, features: Sequence[str], label: str, coefficients: np.ndarray,
                      intercepts: np.ndarray, reg: float) -> DataFrame:
    """``class, feature, gradient, scale, loss``: the derivatives of the mean log-loss plus
    reg / 2 times the squared coefficients (no intercept), each feature's root mean square
    and the penalised loss itself, over rows whose label is the class number 0..classes-1.

    One row of ``coefficients`` stands for two classes and gives the terms of class 1.  One
    scan; classes x features sums a partition leave it.  Rows with a NULL are left out; no
    rows: no result rows.
    """
    w, b = np.atleast_2d(np.asarray(coefficients, float)), np.atleast_1d(np.asarray(intercepts, float))
    binary = len(w) == 1
    full, ints = (np.vstack([0 * w, w]), np.concatenate([0 * b, b])) if binary else (w, b)
    classes, d = full.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grad, square, loss, n = np.zeros((classes, d + 1)), np.zeros(d + 1), 0.0, 0
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            g, s, one = _sums(np.stack(cols[:-1], axis=1), cols[-1].astype(int), full, ints)
            grad, square, loss, n = grad + g, square + s, loss + one, n + len(cols[-1])
        if n:
            c, t = np.indices(grad.shape)
            size = grad.size
            yield pa.RecordBatch.from_pydict({
                "c": pa.array(c.ravel(), pa.int32()), "t": pa.array(t.ravel(), pa.int32()), "g": pa.array(grad.ravel()),
                "s": pa.array(np.tile(square, classes)), "l": pa.array([loss] * size), "n": pa.array([n] * size, pa.int64())})

    names = [*features, INTERCEPT]
    penalty = np.hstack([reg * full, np.zeros((classes, 1))])
    base = 0.5 * reg * float((w * w).sum())
    terms = df.sparkSession.createDataFrame(
        [(c, t, names[t], float(penalty[c, t])) for c in range(int(binary), classes) for t in range(d + 1)],
        "c int, t int, feature string, penalty double")
    x = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(features)],
                  F.col(f"`{label}`").cast("double").alias("y")).dropna()
    sums = x.mapInArrow(partial, "c int, t int, g double, s double, l double, n long").groupBy("c", "t").agg(
        *[F.sum(v).alias(v) for v in "gsln"])
    return sums.join(F.broadcast(terms), ["c", "t"]).select(            # classes x terms rows
        F.col("c").alias("class"), "feature", (F.col("g") / F.col("n") + F.col("penalty")).alias("gradient"),
        F.sqrt(F.col("s") / F.col("n")).alias("scale"), (F.col("l") / F.col("n") + base).alias("loss"))


def logistic_certificate(train: DataFrame, model: PipelineModel, features: Sequence[str], label: str = "label",
                         bound: float = GRADIENT_BOUND) -> DataFrame:
    """``logistic_gradient`` at the fitted model's coefficients on its training rows, with
    ``within``: |gradient| <= bound * scale."""
    m = model.stages[-1]
    out = logistic_gradient(train, features, label, m.coefficientMatrix.toArray(), m.interceptVector.toArray(),
                            m.getRegParam())
    return out.withColumn("within", F.abs("gradient") <= bound * F.col("scale"))
