"""Contiguous folds, and linear fits that leave one fold out from one scan.

Folds are runs of consecutive rows in a given order (per label where stratified, the
labels taking turns so that folds differ by one row at most).  Co-moments are taken
per fold in one scan; the fit without a fold merges the moments of the other folds,
so nothing is subtracted, and only matrices of the number of columns squared reach
the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kiln.core import join_small
from kiln.plans.comoments import comoments
from kiln.plans.ordering import hash_places, ordered_index

#: Directions of the scaled features with a singular value below this share of the largest are left out.
RANK_TOLERANCE = 1e-10


def fold_bounds(sizes: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """Adds ``__b0``, ``__b1``, ...: the positions within a label at which its folds end, to one
    row a label (``__c`` rows, ``__first`` the order key of the first one)."""
    end = F.sum("__c").over(Window.orderBy("__first", by)) if by else F.col("__c")
    sizes = sizes.withColumn("__e", end).withColumn("__s", F.col("__e") - F.col("__c"))
    upto, bounds = F.lit(0).cast("long"), {}
    for f in range(k):
        upto = upto + F.ceil((F.col("__e") - f) / k) - F.ceil((F.col("__s") - f) / k)
        bounds[f"__b{f}"] = upto
    return sizes.withColumns(bounds).drop("__e", "__s")


def contiguous_folds(df: DataFrame, k: int, order_by: Sequence[str], by: str | None = None,
                     hashed: bool = False) -> DataFrame:
    """Adds ``fold`` in 0..k-1: unshuffled folds along ``order_by`` (a total order).

    Without ``by`` the first n % k folds hold one row more.  With ``by`` every label is
    cut into runs of its own: the labels stand one after another in the order of their
    first rows, and a fold gets as many rows of a label as places of it leave the fold's
    number when divided by k.  A NULL label is a label.  One row a label is broadcast or
    joined by size; rows are numbered in ranges, never in one task.  ``hashed``: the first
    column of the order is a 64-bit hash of the row and its label, and only rows near the
    ends of folds are numbered.
    """
    keys = [by] if by else []
    if hashed:
        return hash_places(df, order_by, lambda sizes: fold_bounds(sizes, k, by), k, keys, "fold")
    rows = ordered_index(df, list(order_by), by=keys, idx_col="__i")
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__c"),
                                    F.min(F.struct(*[F.col(f"`{c}`") for c in order_by])).alias("__first"))
    # one row a label
    sizes = fold_bounds(sizes, k, by).select(*keys, F.array(*[f"__b{f}" for f in range(k)]).alias("__bounds"))
    return join_small(rows, sizes, keys).withColumn(
        "fold", F.size(F.filter("__bounds", lambda b: b <= F.col("__i"))).cast("int")).drop("__i", "__bounds")


def fold_moments(df: DataFrame, columns: Sequence[str], fold: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, means and centred products of the columns (without NULLs) in each fold: arrays of
    k, (k, columns) and (k, columns, columns).  A NaN or an infinity makes its fold's products NaN."""
    d = len(columns)
    n, mean, prod = np.zeros(k), np.zeros((k, d)), np.zeros((k, d, d))
    for r in comoments(df, columns, by=fold).collect():     # columns squared times k rows
        f, i, j = r["by"], r["i"], r["j"]
        n[f] = max(n[f], r["n"])
        if i == j:
            mean[f, i] = r["mx"]
        prod[f, i, j] = prod[f, j, i] = np.nan if r["bad"] else r["sxy"]
    return n, mean, prod


def pooled(n: np.ndarray, mean: np.ndarray, prod: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Moments of several folds taken together."""
    total = n.sum()
    m = (n[:, None] * mean).sum(0) / max(total, 1)
    off = mean - m
    return total, m, prod.sum(0) + (n[:, None, None] * off[:, :, None] * off[:, None, :]).sum(0)


def ols(mean: np.ndarray, prod: np.ndarray) -> tuple[float, np.ndarray]:
    """(intercept, coefficients) of the last column on the others; the least-norm solution in
    scaled features where they depend on each other, 0 for a constant feature."""
    sxx, sxy = prod[:-1, :-1], prod[:-1, -1]
    if not np.isfinite(prod).all():
        return float("nan"), np.full(len(sxy), np.nan)
    s = np.sqrt(np.diag(sxx))
    inv = np.divide(1.0, s, out=np.zeros_like(s), where=s > 0)
    b = np.linalg.lstsq(sxx * inv[:, None] * inv, sxy * inv, rcond=RANK_TOLERANCE)[0] * inv
    return float(mean[-1] - b @ mean[:-1]), b


def leave_fold_out_ols(df: DataFrame, features: Sequence[str], label: str, fold: str, k: int) -> DataFrame:
    """``fold, intercept, coefficients`` (in the order of ``features``) of the least-squares fit
    on all rows outside the fold; all k from one scan.  NULLs must have been dropped."""
    n, mean, prod = fold_moments(df, [*features, label], fold, k)
    rows = []
    for f in range(k):
        rest = np.arange(k) != f
        _, m, p = pooled(n[rest], mean[rest], prod[rest])
        b0, b = ols(m, p)
        rows.append((f, b0, b.tolist()))
    return df.sparkSession.createDataFrame(rows, "fold int, intercept double, coefficients array<double>")


def held_out_scores(df: DataFrame, fits: DataFrame, features: Sequence[str], label: str, fold: str) -> DataFrame:
    """``fold`` (from 1), ``score``: minus the mean squared error of every fold's rows under the
    fit without it; one scan.  A fold without rows has no row."""
    fits = fits.select(F.col("fold").alias("__f"), F.col("intercept").alias("__b0"), F.col("coefficients").alias("__b"))
    x = F.array(*[F.col(f"`{c}`").cast("double") for c in features])
    fitted = F.col("__b0") + F.aggregate(F.zip_with(x, "__b", lambda v, b: v * b), F.lit(0.0), lambda a, v: a + v)
    err = F.col(f"`{label}`").cast("double") - fitted
    return df.join(F.broadcast(fits), df[fold] == F.col("__f")).groupBy("__f").agg(           # k rows
        (-F.avg(err * err)).alias("score")).select((F.col("__f") + 1).alias("fold"), "score")
