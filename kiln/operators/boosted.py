"""Boosted trees fitted on the cells of their bins.

Spark bins every feature once (``maxBins``) and its trees see nothing but the bins.  Rows
in the same bins of all features, and of the same class, thus get the same prediction and
gradient in every round: they are one row with their number as its weight and, for
regression, their mean label (the gradient of the squared error is linear in the label,
and the variance inside a cell leaves every gain as it is).  The rounds, some hundreds of
small jobs a fit, then run over the cells, at most bins ** features and never more than
rows; the rows are read twice, for the bins and for the cells.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.core import materialize

#: Values of a feature from which its bins are made: evenly spaced order statistics of all rows
#: (as many as the rows that Spark would draw at random).
BIN_POINTS = 10_000
CELLS_PER_PARTITION = 50_000
BINS, WEIGHT = "__bins", "__weight"


def bin_ends(points: np.ndarray, most: int) -> np.ndarray:
    """Spark's split candidates of a feature, at most ``most``: halfway between all
    neighbours if they are few, else where the count comes nearest to equal steps."""
    values, counts = np.unique(points, return_counts=True)
    middle = (values[:-1] + values[1:]) / 2
    if len(middle) <= most:
        return middle
    upto, step, target, out = np.cumsum(counts), len(points) / (most + 1), len(points) / (most + 1), []
    for i in range(1, len(values)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            out.append(middle[i - 1])
            target += step
    return np.array(out)


def binner(df: DataFrame, features: Sequence[str], n: int, max_bins: int) -> list:
    """Stages that add BINS, the vector of the bins of ``features``, by the ``n`` rows of ``df``."""
    m = max(1, min(n, BIN_POINTS))
    places = F.split(F.lit(",".join(map(repr, ((np.arange(m) + 0.5) / m).tolist()))), ",").cast("array<double>")
    points = df.agg(*[F.percentile_approx(f"`{c}`", places, BIN_POINTS).alias(f"p{i}") for i, c in enumerate(features)]).first()
    ends = [np.unique(np.nextafter(bin_ends(np.array(p or [0.0]), min(max_bins, max(n, 1)) - 1), np.inf)) for p in points]
    # a value at an end belongs to the lower bin, as in a tree; a constant feature has one bin
    splits = [[-np.inf, *(e.tolist() or [np.nextafter(p[0] if p else 0.0, np.inf)]), np.inf] for e, p in zip(ends, points)]
    names = [f"__bin{i}" for i in range(len(features))]
    return [Bucketizer(splitsArray=splits, inputCols=list(features), outputCols=names),
            VectorAssembler(inputCols=names, outputCol=BINS)]


def cells(binned: DataFrame, n_features: int, label: str, classes: bool) -> DataFrame:
    """One row a cell of bins (and class): the bins, the label or mean label, WEIGHT; written."""
    names = [f"__bin{i}" for i in range(n_features)]
    n = F.count(F.lit(1)).cast("double").alias(WEIGHT)
    rows = binned.groupBy(*names, label).agg(n) if classes else binned.groupBy(*names).agg(n, F.avg(label).alias(label))
    # without the mark of a category that bins carry: they are places in an order
    rows = materialize(rows.select(*[F.col(c).alias(c, metadata={}) for c in names], label, WEIGHT))
    return rows.coalesce(max(1, -(-rows.count() // CELLS_PER_PARTITION)))


def fit(df: DataFrame, features: Sequence[str], prepare: PipelineModel, estimator, n: int, classes: bool,
        label: str = "label") -> PipelineModel:
    """``prepare`` followed by the bins and ``estimator`` (boosted trees, or one against the rest of
    them) as fitted on the ``n`` rows of ``df``."""
    trees = estimator.getClassifier() if hasattr(estimator, "getClassifier") else estimator
    bucketizer, assembler = binner(df, features, n, trees.getMaxBins())
    rows = assembler.transform(cells(bucketizer.transform(df), len(features), label, classes))
    for e in (trees, estimator):
        e.setFeaturesCol(BINS).setWeightCol(WEIGHT)
    return PipelineModel([*prepare.stages, bucketizer, assembler, estimator.fit(rows.select(BINS, label, WEIGHT))])
