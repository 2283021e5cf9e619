"""Split and folds by counts of hash cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kiln.operators import ml
from kiln.plans import folds as P7
from kiln.plans import ordering


def labelled(spark, n, spread, seed=3):
    rng = np.random.default_rng(seed)
    c = rng.choice(4, n, p=[.6, .25, .1, .05])
    labels = [["b", "a", None, "c"][i] for i in c]
    h = rng.integers(-(1 << 63), (1 << 63) - 1, spread)[rng.integers(0, spread, n)] ^ c     # a hash is of one label
    return spark.createDataFrame([(int(x), i, v) for i, (x, v) in enumerate(zip(h, labels))],
                                 "h long, id long, label string").repartition(5)


@pytest.mark.parametrize("n,spread", [(0, 1), (3, 3), (700, 1), (700, 7), (2000, 2000)])
@pytest.mark.parametrize("by", [None, "label"])
def test_hashed_folds_are_the_ordered_ones(spark, n, spread, by):
    df = labelled(spark, n, max(spread, 1))
    want = P7.contiguous_folds(df, 5, ["h", "id"], by)
    got = P7.contiguous_folds(df, 5, ["h", "id"], by, hashed=True)
    assert got.columns == want.columns and got.schema["fold"].dataType == want.schema["fold"].dataType
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("key", [None, ["id"]])
@pytest.mark.parametrize("by", [True, False])
def test_split_takes_the_rows_of_the_ranked_one(spark, key, by):
    df = labelled(spark, 1500, 1500)
    split = lambda ranked: sorted(map(str, ml.split(df, 0.2, 42, by, key=key, ranked=ranked).collect()))
    assert split(False) == split(True)


def test_only_rows_near_a_bound_are_ordered(spark, monkeypatch):
    seen = []
    ordered = ordering.assign_buckets
    monkeypatch.setattr(ordering, "assign_buckets", lambda df, *a, **k: seen.append(df.count()) or ordered(df, *a, **k))
    rows = spark.range(40_000).withColumn("label", (F.col("id") % 3).cast("string"))
    rows = rows.withColumn("x", (F.col("id") % 97).cast("double")).drop("id")
    res = ml.train_model(rows, "label", "Logistic Regression", cv_folds=2)
    assert seen and sum(seen) < 8_000                      # two global orders of all rows before
    n = {r["label"]: r["count"] for r in res.extra["train"].groupBy("label").count().collect()}
    assert n == {0.0: 10667, 1.0: 10666, 2.0: 10666}
